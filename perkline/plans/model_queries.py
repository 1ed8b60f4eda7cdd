"""Scaling, model data, training and evaluation queries."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from perkline.operators import features, modeling, quality, scaling
from perkline.plans.fairness_queries import MODEL_BIAS
from perkline.plans.registry import query
from perkline.sources import sinks

R = lambda c, n=8: F.round(c, n).alias(c)
PLAN = scaling.Plan(standard=["monthly_budget"], minmax=["num", "flat"], onehot=["location_type"], label=["archetype"])
SRC = "u AS (SELECT user_id, monthly_budget, ord % 17 AS num, 5.0::DOUBLE AS flat, location_type, archetype FROM users)"


def _src(t):
    return t("users").select("user_id", "monthly_budget", (F.col("ord") % 17).alias("num"), F.lit(5.0).alias("flat"), "location_type", "archetype")


@query(
    "scaled_features",
    "NRM1 NRM2 NRM3 NRM4",
    f"""WITH {SRC}, s AS (SELECT avg(monthly_budget) AS m, stddev_pop(monthly_budget) AS sd, min(num) AS lo, max(num) AS hi FROM u),
    c AS (SELECT archetype, row_number() OVER (ORDER BY archetype) - 1 AS code FROM (SELECT DISTINCT archetype FROM u))
    SELECT user_id, round((monthly_budget - m) / sd, 8) AS monthly_budget, round((num - lo) / (hi - lo), 8) AS num, 0.0::DOUBLE AS flat, CASE WHEN location_type IS NULL THEN 1 ELSE 0 END AS missing, CASE WHEN location_type = 'rural' THEN 1 ELSE 0 END AS rural,
      c.code::INT AS archetype FROM u CROSS JOIN s JOIN c ON c.archetype = u.archetype""",
    "users",
)
def scaled_features(t):
    d = _src(t)
    params = scaling.fit(d, PLAN, "users")
    out = scaling.label_join(scaling.transform(d, scaling.collect_params(params, "users")), params, "users", "archetype")
    return out.select("user_id", R("monthly_budget"), R("num"), "flat", F.col("location_type_<MISSING>").alias("missing"), F.col("location_type_rural").alias("rural"), "archetype")


@query(
    "onehot_positions",
    "NRM3",
    """WITH l AS (SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE 'part ' || l_partkey END AS part, l_quantity FROM lineitem), c AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i FROM (SELECT DISTINCT coalesce(part, '<MISSING>') AS x FROM l WHERE l_quantity < 10))
    SELECT part, (SELECT count(*) FROM c) AS size, c.i AS position, count(*) AS n FROM l LEFT JOIN c ON c.x = coalesce(part, '<MISSING>') GROUP BY 1, 2, 3""",
)
def onehot_positions(t):
    """One-hot codes of a column with many categories in sparse form, fitted on a part of the table."""
    part = F.when(F.col("l_linenumber") != 7, F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    d = t("lineitem").select(part.alias("part"), "l_quantity")
    params = scaling.fit(d.where("l_quantity < 10"), scaling.Plan(onehot=["part"]), "lines")
    out = scaling.onehot_sparse(d, params, "lines", "part", "code")
    return out.groupBy("part", F.col("code.size").alias("size"), F.col("code.position").cast("long").alias("position")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scaling_parameters",
    "NRM5",
    f"""WITH {SRC} SELECT 'monthly_budget' AS "column", 'standard' AS method, 0 AS position, NULL AS text, round(avg(monthly_budget), 6) AS num FROM u UNION ALL SELECT 'monthly_budget', 'standard', 1, NULL, round(stddev_pop(monthly_budget), 6) FROM u
     UNION ALL SELECT 'num', 'minmax', 0, NULL, min(num) FROM u UNION ALL SELECT 'num', 'minmax', 1, NULL, max(num) FROM u UNION ALL SELECT 'flat', 'minmax', 0, NULL, 5 UNION ALL SELECT 'flat', 'minmax', 1, NULL, 5
     UNION ALL SELECT 'location_type', 'onehot', (row_number() OVER (ORDER BY x) - 1)::INT, x, NULL FROM (SELECT DISTINCT coalesce(location_type, '<MISSING>') AS x FROM u)
     UNION ALL SELECT 'archetype', 'label', (row_number() OVER (ORDER BY x) - 1)::INT, x, NULL FROM (SELECT DISTINCT archetype AS x FROM u)""",
    "users",
)
def scaling_parameters(t):
    return scaling.fit(_src(t), PLAN, "users").select("column", "method", "position", "text", R("num", 6))


@query(
    "label_codes",
    "NRM4",
    f"""WITH {SRC}, c AS (SELECT archetype, row_number() OVER (ORDER BY archetype) - 1 AS code FROM (SELECT DISTINCT archetype FROM u WHERE num < 3 AND archetype <> 'high_roller'))
     SELECT u.user_id, coalesce(c.code, -1)::INT AS code, coalesce(c.archetype, '<UNKNOWN>') AS back FROM u LEFT JOIN c ON c.archetype = u.archetype""",
    "users",
)
def label_codes(t):
    """Classes fitted on one part of the table, applied to all of it."""
    d = _src(t)
    known = d.where("num < 3 AND archetype <> 'high_roller'")
    params = scaling.fit(known, scaling.Plan(label=["archetype"]), "users")
    out = scaling.label_join(d, params, "users", "archetype").select("user_id", F.col("archetype").alias("code"))
    return scaling.inverse_label(out, params, "users", "archetype", "code", "back")


def _frame(t, folder=None):
    txns = t("transactions") if folder is None else modeling.written(t("transactions"), f"{folder}-purchases")
    txf = features.user_features(txns, order=("txn_date", "transaction_id", "tie_break"))
    return modeling.dataset(features.profile_features(t("users").drop("ord")), txf, folder=folder)


@query(
    "model_frame",
    "JON1 MLD2 MLD3 MAT3 MAT4 DQ12",
    """WITH a AS (SELECT user_id, avg(amount) AS av, stddev_samp(amount) AS sd, median(amount) AS med FROM transactions GROUP BY 1)
    SELECT 0 AS n_warnings, u.user_id, round(u.monthly_budget, 6) AS monthly_budget, round(med, 6) AS median_transaction_amount, round(coalesce(coalesce(sd, (SELECT median(sd) FROM a JOIN users USING (user_id))) / nullif(av, 0), 0), 4) AS spending_velocity FROM users u JOIN a ON a.user_id = u.user_id""",
    "transactions users",
)
def model_frame(t):
    d, _ = _frame(t, sinks.work_folder(t.spark, "frame"))
    quality.require_columns(d, ["user_id", modeling.TARGET, *modeling.NUMERIC_FEATURES], "model frame")
    warnings = modeling.completeness(d)
    return d.select(F.lit(len(warnings)).alias("n_warnings"), "user_id", R("monthly_budget", 6), R("median_transaction_amount", 6), "spending_velocity")


NULLED = "x AS (SELECT user_id, CASE WHEN ord % 5 = 0 THEN NULL ELSE monthly_budget END AS monthly_budget, CASE WHEN ord % 7 = 0 THEN NULL ELSE ord % 3 END AS num_cards, CASE WHEN ord % 2 = 0 THEN NULL ELSE 1 END AS age_x FROM users)"


def _nulled(t):
    o = F.col("ord")
    return t("users").select(
        "user_id", F.when(o % 5 != 0, F.col("monthly_budget")).alias("monthly_budget"), F.when(o % 7 != 0, o % 3).alias("num_cards"), F.when(o % 2 != 0, 1).alias("age_x")
    )


@query(
    "imputed_features",
    "MLD1",
    f"WITH {NULLED} SELECT user_id, round(coalesce(monthly_budget, (SELECT median(monthly_budget) FROM x)), 8) AS monthly_budget, coalesce(num_cards, (SELECT median(num_cards) FROM x))::DOUBLE AS num_cards, coalesce(age_x, 0) AS age_x FROM x",
    "users",
)
def imputed_features(t):
    return modeling.impute(_nulled(t)).select("user_id", R("monthly_budget"), "num_cards", "age_x")


@query(
    "imputed_counts",
    "MLD1",
    f"WITH {NULLED} SELECT 'monthly_budget' AS \"column\", count(*) FILTER (monthly_budget IS NULL) AS filled FROM x UNION ALL SELECT 'num_cards', count(*) FILTER (num_cards IS NULL) FROM x UNION ALL SELECT 'age_x', count(*) FILTER (age_x IS NULL) FROM x",
    "users",
)
def imputed_counts(t):
    return modeling.imputed_counts(_nulled(t))


@query(
    "stratified_split",
    "MLD4",
    """WITH q AS (SELECT quantile_cont(monthly_budget, 0.25) AS a, quantile_cont(monthly_budget, 0.5) AS b, quantile_cont(monthly_budget, 0.75) AS c FROM users), s AS (SELECT CASE WHEN monthly_budget <= a THEN '0' WHEN monthly_budget <= b THEN '1' WHEN monthly_budget <= c THEN '2' ELSE '3' END AS stratum FROM users CROSS JOIN q),
    i AS (SELECT stratum, (row_number() OVER (PARTITION BY stratum) - 0.5) / count(*) OVER (PARTITION BY stratum) AS p FROM s)
    SELECT stratum, CASE WHEN p < 0.7::DOUBLE THEN 'train' WHEN p < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split, count(*) AS n FROM i GROUP BY 1, 2""",
    "users",
)
def stratified_split(t):
    """Sizes only: which row falls where depends on the hash order."""
    return modeling.split(t("users"), "monthly_budget", "user_id", discrete=False).groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "segment_members",
    "MLD5",
    """WITH a AS (SELECT user_id, sum(amount) AS ts, count(DISTINCT card_used) AS nc FROM transactions GROUP BY 1), d AS (SELECT u.user_id, u.archetype, u.location_type, round(ts, 4) AS ts, nc FROM users u JOIN a ON a.user_id = u.user_id)
    SELECT segment, count(*) AS n FROM (SELECT CASE WHEN ts >= (SELECT median(ts) FROM d) THEN 'spending_tier::high_spender' ELSE 'spending_tier::low_spender' END AS segment FROM d
      UNION ALL SELECT CASE WHEN nc = 1 THEN 'card_count::single_card' ELSE 'card_count::multi_card' END FROM d UNION ALL SELECT 'archetype::' || archetype FROM d UNION ALL SELECT 'location_type::' || location_type FROM d WHERE location_type IS NOT NULL) GROUP BY 1""",
    "transactions users",
)
def segment_members(t):
    a = t("transactions").groupBy("user_id").agg(F.round(F.sum("amount"), 4).alias("total_spending"), F.count_distinct("card_used").alias("num_cards"))
    d = modeling.join_users(t("users"), a)
    return modeling.segment_flags(d, ["archetype", "location_type"]).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@query(
    "regression_metrics",
    "EVA1 MDL1",
    """SELECT count(*) AS n, round(sqrt(avg(pow(target - score, 2))), 8) AS rmse, round(avg(abs(target - score)), 8) AS mae, round(1 - sum(pow(target - score, 2)) / (sum(target * target) - sum(target) * sum(target) / count(*)), 6) AS r2 FROM predictions""",
    "predictions",
)
def regression_metrics(t):
    return modeling.regression_metrics(t("predictions"), "target", "score").select("n", R("rmse"), R("mae"), R("r2", 6))


@query(
    "segment_regression_metrics",
    "EVA3",
    " UNION ALL ".join(
        f"SELECT '{c}' AS dimension, {c} AS segment, count(*) AS n, round(sqrt(avg(pow(target - score, 2))), 8) AS rmse, round(avg(abs(target - score)), 8) AS mae FROM predictions GROUP BY 2 HAVING count(*) >= 2"
        for c in ["segment", "source"]
    ),
    "predictions",
)
def segment_regression_metrics(t):
    return modeling.segment_metrics(t("predictions"), ["segment", "source"], "target", "score").select("dimension", "segment", "n", R("rmse"), R("mae"))


@query(
    "ranking_metrics",
    "EVA2",
    """WITH r AS (SELECT *, row_number() OVER (ORDER BY target DESC, item_id DESC) AS rt, row_number() OVER (ORDER BY score DESC, item_id DESC) AS rp FROM predictions),
    h AS (SELECT rp, row_number() OVER (ORDER BY rp) AS h FROM r WHERE rp <= 10 AND rt <= 10)
    SELECT round((SELECT sum(1 / log2(rp + 1)) FROM h) / (SELECT sum(1 / log2(i + 1)) FROM range(1, 11) t(i)), 4) AS ndcg_at_k, round((SELECT sum(h / rp) FROM h) / 10, 4) AS map_at_k, round((SELECT count(*) FROM h) / 10, 4) AS precision_at_k,
      round((SELECT count(*) FROM h) / 10, 4) AS recall_at_k, round(1 / (SELECT min(rp) FROM r WHERE rt <= 10), 4) AS mrr, 10::BIGINT AS k""",
    "predictions",
)
def ranking_metrics(t):
    return modeling.ranking_metrics(t("predictions"), "target", "score", "item_id", 10)


def _met(where: str) -> str:
    return f"(SELECT sqrt(avg(pow(target - score, 2))) AS rmse, 1 - sum(pow(target - score, 2)) / (sum(target * target) - sum(target) * sum(target) / count(*)) AS r2 FROM predictions WHERE {where})"


@query(
    "holdout_verdict",
    "EVA4 EVA5",
    f"""WITH o AS (SELECT v.rmse, v.r2, round(v.rmse - t.rmse, 6) AS rmse_gap, (v.rmse - t.rmse > 0.3) OR (t.r2 - v.r2 > 0.15) AS ov FROM {_met('item_id % 3 = 0')} v CROSS JOIN {_met('item_id % 3 <> 0')} t),
    p AS (SELECT *, concat_ws('; ', CASE WHEN rmse > 0.01 THEN printf('Test RMSE %.6f > threshold 0.01', rmse) END, CASE WHEN r2 < 0.3 THEN printf('Test R² %.4f < threshold 0.3', r2) END, CASE WHEN ov THEN printf('Overfitting detected: RMSE gap=%.6f', rmse_gap) END) AS r FROM o)
    SELECT r = '' AS passed, CASE WHEN r = '' THEN 'All checks passed' ELSE r END AS reason, rmse_gap FROM p""",
    "predictions",
)
def holdout_verdict(t):
    p = t("predictions")
    val = modeling.regression_metrics(p.where("item_id % 3 = 0"), "target", "score")
    train = modeling.regression_metrics(p.where("item_id % 3 <> 0"), "target", "score")
    over = modeling.overfit_check(train, val)
    v = modeling.holdout_verdict(val, over)
    return v.withColumn("rmse_gap", over.select("rmse_gap").scalar())


@query(
    "classes_kept",
    "EVA6",
    """WITH c AS (SELECT user_id, category, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, category) AS k FROM transactions GROUP BY 1, 2), t AS (SELECT user_id, category AS top_category FROM c WHERE k = 1),
    n AS (SELECT top_category, count(*) AS n FROM t GROUP BY 1) SELECT top_category, n FROM n WHERE n >= 60""",
    "transactions",
)
def classes_kept(t):
    d = modeling.without_rare(modeling.top_category(t("transactions")), "top_category", 60)
    return d.groupBy("top_category").agg(F.count(F.lit(1)).alias("n"))


@query(
    "trained_models",
    "MDL1 MDL2 MDL3 MDL4 MDL6 TOP8",
    """WITH u AS (SELECT CASE redemption_preference WHEN 'travel_portal' THEN 0.015 WHEN 'travel_transfer' THEN 0.02 WHEN 'gift_cards' THEN 0.009 WHEN 'merchandise' THEN 0.008 ELSE 0.01 END::DOUBLE AS y FROM users WHERE user_id IN (SELECT user_id FROM transactions)),
    q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.5) AS b, quantile_cont(y, 0.75) AS c FROM u), s AS (SELECT CASE WHEN y <= a THEN 0 WHEN y <= b THEN 1 WHEN y <= c THEN 2 ELSE 3 END AS st FROM u CROSS JOIN q),
    p AS (SELECT (row_number() OVER (PARTITION BY st) - 0.5) / count(*) OVER (PARTITION BY st) AS p FROM s), n AS (SELECT count(*) FILTER (p >= 0.7::DOUBLE AND p < 0.7::DOUBLE + 0.15::DOUBLE) AS n FROM p)
    SELECT m AS model, n, true AS within_baseline FROM n CROSS JOIN (VALUES ('mean_baseline'), ('random_forest'), ('gradient_boosting')) t(m)""",
    "users transactions",
)
def trained_models(t):
    """Leaderboard on the user feature frame, as sizes and a comparison with the mean model."""
    base = sinks.work_folder(t("users").sparkSession, "training")
    d, cols = _frame(t, base + "-frame")
    s = modeling.split(d, modeling.TARGET, "user_id", discrete=False).select(*cols, modeling.TARGET, "split")
    s = modeling.written(s, base + "-split")
    models = modeling.candidates(modeling.TARGET)
    board, _ = modeling.train_all(s.where("split = 'train'"), s.where("split = 'val'"), cols, modeling.TARGET, models)
    mean = board.where("model = 'mean_baseline'").select("rmse").scalar()
    return board.withColumn("b", mean).select("model", "n", (F.col("rmse") <= F.col("b")).alias("within_baseline"))


@query("tuned_forest", "MDL5", "SELECT count(*) AS n, 4 AS grid_points, true AS within_5_percent_of_mean FROM embeddings WHERE vec_id % 5 = 0")
def tuned_forest(t):
    """Grid search by three-fold error over all embedding values; the refitted best model on held-out rows."""
    size = 64
    d = t("embeddings").select("vec_id", F.col("label").cast("double").alias("y"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(size)])
    train, held = d.where("vec_id % 5 <> 0"), d.where("vec_id % 5 = 0")
    cv = modeling.tune(train, [f"e{i}" for i in range(size)], "y", {"maxDepth": [2, 4], "numTrees": [20, 50]}, folds=3)
    mean = modeling.regression_metrics(modeling.mean_baseline(train, "y")(held), "y", "prediction").select("rmse").scalar()
    m = modeling.regression_metrics(cv.transform(held), "y", "prediction").withColumn("mean_rmse", mean)
    return m.select("n", F.lit(len(cv.avgMetrics)).alias("grid_points"), (F.col("rmse") <= 1.05 * F.col("mean_rmse")).alias("within_5_percent_of_mean"))


def _stump(name: str, rows: str) -> str:
    """CTEs that fit a tree with one split per group ``g`` to ``rows`` (g, x, y): table ``name`` (g, cut, lo, hi)."""
    return f"""{name}_v AS (SELECT g, x, count(*) AS n, sum(y) AS s FROM {rows} GROUP BY 1, 2),
    {name}_c AS (SELECT g, x, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(n) OVER (PARTITION BY g) AS tn, sum(s) OVER (PARTITION BY g) AS ts FROM {name}_v WINDOW w AS (PARTITION BY g ORDER BY x)),
    {name} AS (SELECT g, x AS cut, s / n AS lo, (ts - s) / (tn - n) AS hi FROM {name}_c WHERE n < tn QUALIFY row_number() OVER (PARTITION BY g ORDER BY s * s / n + (ts - s) * (ts - s) / (tn - n) DESC, x) = 1)"""


def _lines(t):
    """Price by quantity; every fifth order is held out, the others lie in three folds."""
    k = F.col("l_orderkey")
    return t("lineitem").select(F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"), (k % 5 == 0).alias("held"), (k % 3).cast("int").alias("fold"))


LINES = "d AS (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, l_orderkey % 5 = 0 AS held, l_orderkey % 3 AS fold FROM lineitem)"
WHOLE = {"maxDepth": 1, "maxBins": 64, "subsamplingRate": 1.0, "seed": 42}


@query(
    "tree_models",
    "MDL1 MDL2 MDL3 MDL4",
    f"""WITH {LINES}, a AS (SELECT 0 AS g, x, y FROM d WHERE NOT held), {_stump('t1', 'a')},
    r AS (SELECT 0 AS g, x, 2 * (y - CASE WHEN x <= cut THEN lo ELSE hi END) AS y FROM a CROSS JOIN (SELECT cut, lo, hi FROM t1)), {_stump('t2', 'r')},
    p AS (SELECT y, (SELECT avg(y) FROM a) AS m, CASE WHEN x <= t1.cut THEN t1.lo ELSE t1.hi END AS f, CASE WHEN x <= t1.cut THEN t1.lo ELSE t1.hi END + 0.1::DOUBLE * CASE WHEN x <= t2.cut THEN t2.lo ELSE t2.hi END AS b FROM d CROSS JOIN t1 CROSS JOIN t2 WHERE held),
    l AS (SELECT 'mean_baseline' AS model, y, m AS p FROM p UNION ALL SELECT 'random_forest', y, f FROM p UNION ALL SELECT 'gradient_boosting', y, b FROM p)
    SELECT model, count(*) AS n, round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(1 - sum(pow(y - p, 2)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2 FROM l GROUP BY 1""",
)
def tree_models(t):
    """The training and its leaderboard with trees small enough to be told in SQL: no resampling, one split a tree."""
    d = _lines(t)
    models = {
        "random_forest": RandomForestRegressor(labelCol="y", numTrees=3, bootstrap=False, featureSubsetStrategy="all", **WHOLE),
        "gradient_boosting": GBTRegressor(labelCol="y", maxIter=2, stepSize=0.1, featureSubsetStrategy="all", **WHOLE),
    }
    board, _ = modeling.train_all(d.where("NOT held"), d.where("held"), ["x"], "y", models)
    return board.select("model", "n", R("rmse", 4), R("mae", 4), R("r2", 6))


@query(
    "tuned_depth",
    "MDL5",
    f"""WITH {LINES}, a AS (SELECT f.g, x, y FROM d CROSS JOIN (VALUES (0), (1), (2), (9)) f(g) WHERE NOT held AND fold <> f.g), {_stump('t1', 'a')}, m AS (SELECT g, avg(y) AS m FROM a GROUP BY 1),
    e AS (SELECT g, sqrt(avg(pow(y - m.m, 2))) AS e0, sqrt(avg(pow(y - CASE WHEN x <= cut THEN lo ELSE hi END, 2))) AS e1 FROM d JOIN t1 ON (held AND t1.g = 9) OR (NOT held AND t1.g = fold) JOIN m USING (g) GROUP BY 1),
    c AS (SELECT 0 AS max_depth, avg(e0) AS cv_rmse, (SELECT e0 FROM e WHERE g = 9) AS held FROM e WHERE g < 9 UNION ALL SELECT 1, avg(e1), (SELECT e1 FROM e WHERE g = 9) FROM e WHERE g < 9)
    SELECT max_depth, round(cv_rmse, 4) AS cv_rmse, cv_rmse = min(cv_rmse) OVER () AS chosen, round(arg_min(held, cv_rmse) OVER (), 4) AS held_out_rmse FROM c""",
)
def tuned_depth(t):
    """Grid search over named folds: mean error of each grid point, the one chosen, and the refitted model's error on held-out rows."""
    d = _lines(t)
    forest = RandomForestRegressor(labelCol="y", numTrees=1, bootstrap=False, featureSubsetStrategy="all", **WHOLE)
    cv = modeling.tune(d.where("NOT held"), ["x"], "y", {"maxDepth": [0, 1]}, folds=3, forest=forest, fold="fold")
    held = modeling.regression_metrics(cv.transform(d.where("held")), "y", "prediction").first()["rmse"]
    best = min(cv.avgMetrics)
    rows = [(depth, float(e), bool(e == best), held) for depth, e in zip([0, 1], cv.avgMetrics)]
    out = t.spark.createDataFrame(rows, "max_depth int, cv_rmse double, chosen boolean, held_out_rmse double")
    return out.select("max_depth", R("cv_rmse", 4), "chosen", R("held_out_rmse", 4))


_RMSE, _R2 = "sqrt(avg(pow(target - score, 2)))", "1 - sum(pow(target - score, 2)) / (sum(target * target) - sum(target) * sum(target) / count(*))"


@query(
    "training_job",
    "MDL6 MDL4 EVA3 EVA5 FAI12",
    f"""WITH h AS (SELECT *, CASE WHEN target <= a THEN 0 WHEN target <= b THEN 1 WHEN target <= c THEN 2 ELSE 3 END AS st FROM predictions CROSS JOIN (SELECT quantile_cont(target, 0.25) AS a, quantile_cont(target, 0.5) AS b, quantile_cont(target, 0.75) AS c FROM predictions)),
    p AS (SELECT item_id, segment, source, target, score AS x, (row_number() OVER (PARTITION BY st ORDER BY substr(md5(item_id::VARCHAR), 1, 15), item_id) - 0.5) / count(*) OVER (PARTITION BY st) AS place FROM h),
    s AS (SELECT *, CASE WHEN place < 0.7::DOUBLE THEN 'train' WHEN place < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM p),
    e AS (SELECT s.*, m, ic + sl * x AS lin FROM s CROSS JOIN (SELECT avg(target) AS m, regr_slope(target, x) AS sl, regr_intercept(target, x) AS ic FROM s WHERE split = 'train')),
    b AS (SELECT 'mean_baseline' AS model, sqrt(avg(pow(target - m, 2))) AS rmse FROM e WHERE split = 'val' UNION ALL SELECT 'linear', sqrt(avg(pow(target - lin, 2))) FROM e WHERE split = 'val'),
    v AS (SELECT item_id, segment, source, split, target, CASE (SELECT model FROM b ORDER BY rmse, model LIMIT 1) WHEN 'linear' THEN lin ELSE m END AS score FROM e),
    g AS (SELECT split, {_RMSE} AS rmse, {_R2} AS r2 FROM v GROUP BY 1),
    o AS (SELECT t.rmse, t.r2, w.rmse - a.rmse AS gap, (w.rmse - a.rmse > 0.3) OR (a.r2 - w.r2 > 0.15) AS ov FROM g t CROSS JOIN g w CROSS JOIN g a WHERE t.split = 'test' AND w.split = 'val' AND a.split = 'train'),
    y AS (SELECT concat_ws('; ', CASE WHEN rmse > 0.01 THEN printf('Test RMSE %.6f > threshold 0.01', rmse) END, CASE WHEN r2 < 0.3 THEN printf('Test R² %.4f < threshold 0.3', r2) END, CASE WHEN ov THEN printf('Overfitting detected: RMSE gap=%.6f', gap) END) AS r FROM o)
    SELECT 'model' AS part, model AS name, round(rmse, 8) AS value FROM b UNION ALL SELECT 'rmse', split, round(rmse, 8) FROM g UNION ALL SELECT 'r2', split, round(r2, 6) FROM g
    UNION ALL SELECT 'segment', 'segment=' || segment, round({_RMSE}, 8) FROM v WHERE split = 'val' GROUP BY segment HAVING count(*) >= 2 UNION ALL SELECT 'segment', 'source=' || source, round({_RMSE}, 8) FROM v WHERE split = 'val' GROUP BY source HAVING count(*) >= 2
    UNION ALL SELECT 'bias', name || ' ' || feature || CASE WHEN is_biased THEN ' biased' ELSE '' END, round(value, 8) FROM (WITH predictions AS (SELECT * FROM v WHERE split = 'val') SELECT * FROM ({MODEL_BIAS}))
    UNION ALL SELECT 'verdict', CASE WHEN r = '' THEN 'All checks passed' ELSE r END, CASE WHEN r = '' THEN 1 ELSE 0 END FROM y""",
    "predictions",
)
def training_job(t):
    """The whole job with a line and the mean as candidates; all its reports in one long table."""
    d = t("predictions").select("item_id", "segment", "source", "target", F.col("score").alias("x"))
    order = F.conv(F.substring(F.md5(F.col("item_id").cast("string")), 1, 15), 16, 10).cast("long")
    d = modeling.split(d, "target", "item_id", discrete=False, order=order)
    run = modeling.training_job(d, ["x"], "target", "item_id", ["segment", "source", "age_group"], sinks.work_folder(t.spark, "job"), {"linear": modeling.linear("target")})
    named = lambda part, name, value, n=8: [F.lit(part).alias("part"), name.alias("name"), F.round(value.cast("double"), n).alias("value")]
    flag = F.when(F.col("is_biased"), F.lit(" biased")).otherwise(F.lit(""))
    parts = [
        run.board.select(*named("model", F.col("model"), F.col("rmse"))),
        run.metrics.select(*named("rmse", F.col("split"), F.col("rmse"))),
        run.metrics.select(*named("r2", F.col("split"), F.col("r2"), 6)),
        run.segments.select(*named("segment", F.concat("dimension", F.lit("="), "segment"), F.col("rmse"))),
        run.bias.select(*named("bias", F.concat("name", F.lit(" "), "feature", flag), F.col("value"))),
        run.verdict.select(*named("verdict", F.col("reason"), F.col("passed").cast("int"))),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out
