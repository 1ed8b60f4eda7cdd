"""Slicing, fairness, mitigation and counterfactual queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline.operators import fairness as fa
from perkline.operators import modeling
from perkline.plans.registry import query

R = lambda c, n=8: F.round(c, n).alias(c)


def _slice_sql(col: str, name: str, table: str) -> str:
    return f"""SELECT '{name}' AS slice_column, CAST({col} AS VARCHAR) AS slice_value, count(*) AS "count", round(avg(monthly_budget), 8) AS budget_mean, round(stddev_samp(monthly_budget), 6) AS budget_std,
      round(median(monthly_budget), 8) AS budget_median, round(count(*) / sum(count(*)) OVER (), 8) AS fraction, round(max(count(*)) OVER () / min(count(*)) OVER (), 8) AS imbalance FROM {table} GROUP BY {col}"""


def _named(d):
    return d.select(
        "slice_column", "slice_value", "count", F.round("monthly_budget_mean", 8).alias("budget_mean"), F.round("monthly_budget_std", 6).alias("budget_std"),
        F.round("monthly_budget_median", 8).alias("budget_median"), R("fraction"), R("imbalance"),
    )


@query(
    "slices_by_column",
    "FAI1 FAI3",
    " UNION ALL ".join(_slice_sql(c, c, "users") for c in ["archetype", "age_group", "location_type"]),
    "users",
)
def slices_by_column(t):
    return _named(fa.slices(t("users"), ["archetype", "age_group", "location_type"], ["monthly_budget"]))


@query(
    "slices_by_quantile_and_bin",
    "FAI2",
    "WITH q AS (SELECT users.*, CASE WHEN monthly_budget <= q1 THEN 'Q1' WHEN monthly_budget <= q2 THEN 'Q2' WHEN monthly_budget <= q3 THEN 'Q3' ELSE 'Q4' END AS qq, "
    "CASE WHEN monthly_budget >= 0 AND monthly_budget <= 1000 THEN 'low' WHEN monthly_budget > 1000 AND monthly_budget <= 5000 THEN 'mid' END AS bb FROM users CROSS JOIN "
    "(SELECT quantile_cont(monthly_budget, 0.25) AS q1, quantile_cont(monthly_budget, 0.5) AS q2, quantile_cont(monthly_budget, 0.75) AS q3 FROM users)) "
    + _slice_sql("qq", "monthly_budget_quantile", "q") + " UNION ALL " + _slice_sql("bb", "monthly_budget_binned", "q"),
    "users",
)
def slices_by_quantile_and_bin(t):
    a = fa.quantile_slices(t("users"), "monthly_budget", ["monthly_budget"])
    b = fa.bin_slices(t("users"), "monthly_budget", [0, 1000, 5000], ["low", "mid"], ["monthly_budget"])
    return _named(a).unionByName(_named(b))


def _row(name, feature, value, limit, detail="''", biased=None):
    b = biased or f"coalesce({value} > {limit}, false)"
    return f"'{name}' AS name, '{feature}' AS feature, {detail} AS detail, round(({value})::DOUBLE, 8) AS value, {limit}::DOUBLE AS threshold, {b} AS is_biased"


def _scan_sql(f: str) -> str:
    return f"""
  SELECT {_row('underrepresentation', f, 'n / t', 0.05, 'g', 'true')} FROM (SELECT {f} AS g, count(*) AS n, sum(count(*)) OVER () AS t FROM users WHERE {f} IS NOT NULL GROUP BY 1) WHERE n / t < 0.05
  UNION ALL SELECT {_row('representation_imbalance', f, 'max(n) / min(n)', 2.0)} FROM (SELECT count(*) AS n FROM users WHERE {f} IS NOT NULL GROUP BY {f})
  UNION ALL SELECT {_row('outcome_disparity', f, "CASE WHEN min(m) > 0 THEN max(m) / min(m) ELSE CASE WHEN max(m) > 0 THEN 'inf'::DOUBLE ELSE 1 END END", 2.0, "'monthly_budget: ' || max_by(g, m) || ' vs ' || min_by(g, m)")} FROM (SELECT {f} AS g, avg(monthly_budget) AS m FROM users WHERE {f} IS NOT NULL GROUP BY 1)
  UNION ALL SELECT {_row('group_metric_difference', f, 'max(d)', 0.2, "'monthly_budget: ' || max_by(g, d)")} FROM (SELECT g, abs(m - o) / greatest(abs(o), 1e-10) AS d FROM (SELECT {f} AS g, avg(monthly_budget) AS m FROM users WHERE {f} IS NOT NULL GROUP BY 1) CROSS JOIN (SELECT avg(monthly_budget) AS o FROM users))"""


@query("data_bias_scan", "FAI4 FAI5 FAI6 FAI10 UDF1 MAT5 RSH8", " UNION ALL ".join(_scan_sql(f) for f in ["archetype", "age_group", "location_type"]), "users")
def data_bias_scan(t):
    return fa.data_bias_scan(t("users"), ["archetype", "age_group", "location_type"], ["monthly_budget"]).withColumn("value", F.round("value", 8))


def _model_sql(f: str) -> str:
    return f"""
  SELECT {_row('demographic_parity_difference', f, 'max(rate) - min(rate)', 0.1)} FROM g_{f}
  UNION ALL SELECT {_row('equalized_odds_difference', f, 'greatest(coalesce(max(tpr) - min(tpr), 0), coalesce(max(fpr) - min(fpr), 0))', 0.1)} FROM g_{f}
  UNION ALL SELECT {_row('accuracy_difference', f, 'max(acc) - min(acc)', 0.1, "''", 'false')} FROM g_{f}
  UNION ALL SELECT {_row('accuracy_ratio', f, 'min(acc) / max(acc)', 0.1, "''", 'false')} FROM g_{f}
  UNION ALL SELECT {_row('performance_disparity', f, 'max(abs(e - o) / o)', 0.1, "printf('ratio %.4f', max(e) / min(e))")} FROM (SELECT avg(abs(target - score)) AS e, count(*) AS n FROM predictions GROUP BY {f}) CROSS JOIN (SELECT avg(abs(target - score)) AS o FROM predictions) WHERE n >= 10 HAVING count(*) > 0"""


def _group_sql(f: str) -> str:
    return f"g_{f} AS (SELECT {f}, avg(p) AS rate, avg(p) FILTER (y = 1) AS tpr, avg(p) FILTER (y = 0) AS fpr, avg(CASE WHEN p = y THEN 1 ELSE 0 END) AS acc FROM b GROUP BY 1)"


MODEL_BIAS = (
    "WITH b AS (SELECT *, CASE WHEN score >= (SELECT median(score) FROM predictions) THEN 1 ELSE 0 END AS p, CASE WHEN target > 0 THEN 1 ELSE 0 END AS y FROM predictions), "
    + _group_sql("segment") + ", " + _group_sql("source") + _model_sql("segment") + " UNION ALL " + _model_sql("source")
)


@query("model_bias", "FAI7 FAI8 FAI9 FAI11 FAI12 UDF2", MODEL_BIAS, "predictions")
def model_bias(t):
    return fa.model_bias(t("predictions"), ["segment", "source"], "target", "score").withColumn("value", F.round("value", 8))


@query(
    "bias_gate",
    "FAI25",
    f"SELECT count(*) FILTER (is_biased AND value > 0.1) AS blocking, count(*) FILTER (is_biased AND value > 0.1) = 0 AS passed FROM ({MODEL_BIAS})",
    "predictions",
)
def bias_gate(t):
    return fa.bias_gate(fa.model_bias(t("predictions"), ["segment", "source"], "target", "score"))


@query(
    "metric_gate",
    "FAI25",
    """WITH m AS (SELECT sqrt(avg(pow(target - score, 2))) AS rmse, 1 - sum(pow(target - score, 2)) / (sum(target * target) - sum(target) * sum(target) / count(*)) AS r2 FROM predictions)
    SELECT 'low' AS bar, r2 >= -1000 AND rmse >= 0 AS passed FROM m UNION ALL SELECT 'high', r2 >= 0.999999 FROM m UNION ALL SELECT 'missing', false""",
    "predictions",
)
def metric_gate(t):
    """Named metrics against their minimums, one that is not reported counting as 0."""
    m = modeling.regression_metrics(t("predictions"), "target", "score")
    long = m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("rmse", "r2")])).alias("x")).select("x.*")
    bars = {"low": {"r2": -1000.0, "rmse": 0.0}, "high": {"r2": 0.999999}, "missing": {"ndcg": 0.7}}
    out = None
    for name, minimums in bars.items():
        one = fa.metric_gate(long, minimums).select(F.lit(name).alias("bar"), "passed")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "group_rates",
    "FAI7 FAI9",
    """SELECT segment AS "group", count(*) AS n, round(avg(y_pred), 8) AS selection_rate, round(avg(CASE WHEN y_pred = y_true THEN 1 ELSE 0 END), 8) AS accuracy FROM predictions GROUP BY 1""",
    "predictions",
)
def group_rates(t):
    return fa.group_rates(t("predictions"), "segment", "y_true", "y_pred").select("group", "n", R("selection_rate"), R("accuracy"))


@query(
    "ranking_by_slice",
    "FAI13",
    """WITH lg AS (SELECT 'overall' AS feature, 'all' AS slice, y_true::DOUBLE AS y, score AS p, item_id AS i FROM predictions UNION ALL SELECT 'segment', segment, y_true, score, item_id FROM predictions UNION ALL SELECT 'source', source, y_true, score, item_id FROM predictions),
   rp AS (SELECT *, row_number() OVER (PARTITION BY feature, slice ORDER BY p DESC, i) AS r, row_number() OVER (PARTITION BY feature, slice ORDER BY y DESC, i) AS rt FROM lg),
   m AS (SELECT feature, slice, count(*) AS "count", sum(CASE WHEN r <= 5 THEN y / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rt <= 5 THEN y / log2(rt + 1) ELSE 0 END) AS idcg,
      avg(CASE WHEN y > 0 THEN 1 ELSE 0 END) FILTER (r <= 5) AS prec, count(*) FILTER (r <= 5 AND y > 0) AS hits, count(*) FILTER (y > 0) AS rel FROM rp GROUP BY 1, 2),
   l AS (SELECT feature, slice, "count", 'ndcg' AS metric, CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END AS value FROM m UNION ALL SELECT feature, slice, "count", 'precision', prec FROM m UNION ALL SELECT feature, slice, "count", 'recall', CASE WHEN rel = 0 THEN 0 ELSE hits / rel END FROM m),
   o AS (SELECT metric, value AS overall FROM l WHERE feature = 'overall')
   SELECT l.feature, l.slice, "count", l.metric, round(value, 8) AS value, round(CASE WHEN overall <> 0 THEN abs(value - overall) / abs(overall) END, 8) AS deviation, coalesce(CASE WHEN overall <> 0 THEN abs(value - overall) / abs(overall) END > 0.1, false) AS disparity FROM l JOIN o ON o.metric = l.metric""",
    "predictions",
)
def ranking_by_slice(t):
    d = fa.ranking_by_slice(t("predictions"), ["segment", "source"], "y_true", "score", "item_id")
    return d.select("feature", "slice", "count", "metric", R("value"), R("deviation"), "disparity")


@query(
    "recommendation_diversity",
    "FAI14",
    "SELECT round(count(DISTINCT issuer) / count(*), 10) AS diversity FROM recommendations",
    "recommendations",
)
def recommendation_diversity(t):
    return fa.recommendation_diversity(t("recommendations"), "issuer").select(R("diversity", 10))


ISSUER_SQL = """SELECT 'issuer_disparity' AS name, 'segment' AS feature, issuer AS detail, round(max(s) - CASE WHEN count(*) < (SELECT count(DISTINCT segment) FROM recommendations) THEN 0 ELSE min(s) END, 10) AS value,
   0.003::DOUBLE AS threshold, max(s) - CASE WHEN count(*) < (SELECT count(DISTINCT segment) FROM recommendations) THEN 0 ELSE min(s) END > 0.003 AS is_biased, round(max(s), 10) AS max_rate
   FROM (SELECT segment, issuer, count(*) / sum(count(*)) OVER (PARTITION BY segment) AS s FROM recommendations GROUP BY 1, 2) GROUP BY issuer"""


@query("issuer_bias", "FAI15", ISSUER_SQL, "recommendations")
def issuer_bias(t):
    return fa.issuer_bias(t("recommendations"), "segment", "issuer", 0.003).withColumns({"value": F.round("value", 10), "max_rate": F.round("max_rate", 10)})


@query("issuer_caps", "FAI23", f"SELECT detail AS issuer, round(max_rate - 0.05, 8) AS cap FROM ({ISSUER_SQL}) WHERE is_biased", "recommendations")
def issuer_caps(t):
    bias = fa.issuer_bias(t("recommendations"), "segment", "issuer", 0.003).withColumn("max_rate", F.round("max_rate", 10))
    return fa.issuer_caps(bias).select("issuer", R("cap"))


@query(
    "premium_bias",
    "FAI16",
    f"SELECT {_row('premium_card_disparity', 'segment', 'max(m) - min(m)', 0.15)} FROM (SELECT avg(CASE WHEN lower(card_type) IN ('premium', 'luxury', 'platinum', 'reserve') THEN 1 ELSE 0 END) AS m FROM recommendations GROUP BY segment)",
    "recommendations",
)
def premium_bias(t):
    return fa.premium_bias(t("recommendations"), "segment", "card_type").withColumn("value", F.round("value", 8))


EXPL = r"""WITH w AS (SELECT segment, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM explanations),
   m AS (SELECT segment, length(text) AS len, len(w) AS nw, 0.39 * (greatest(len(w), 1) / greatest(len(regexp_extract_all(text, '[.!?]')), 1)) + 11.8 * (coalesce(list_sum(list_transform(w, lambda x: greatest(length(regexp_replace(lower(x), '[^aeiou]', '', 'g')), 1))), 0) / greatest(len(w), 1)) - 15.59 AS gr FROM w),
   g AS (SELECT segment, avg(len) AS len, avg(gr) AS gr, avg(nw) AS nw FROM m GROUP BY 1), o AS (SELECT avg(len) AS ol, avg(gr) AS og, avg(nw) AS ow FROM m)
   SELECT 'explanation_length_disparity' AS name, 'segment' AS feature, '' AS detail, round(max(abs(len - ol) / ol), 8) AS value, 0.2::DOUBLE AS threshold, max(abs(len - ol) / ol) > 0.2 AS is_biased FROM g CROSS JOIN o
   UNION ALL SELECT 'readability_disparity', 'segment', '', round(max(abs(gr - og) / abs(og)), 8), 0.15, max(abs(gr - og) / abs(og)) > 0.15 FROM g CROSS JOIN o
   UNION ALL SELECT 'detail_level_disparity', 'segment', '', round(max(abs(nw - ow) / ow), 8), 0.2, max(abs(nw - ow) / ow) > 0.2 FROM g CROSS JOIN o"""


@query("explanation_bias", "FAI17 TXT1", EXPL, "explanations")
def explanation_bias(t):
    return fa.explanation_bias(t("explanations"), "segment", "text").withColumn("value", F.round("value", 8))


@query(
    "prompt_advice",
    "FAI23",
    f"""SELECT name, CASE WHEN name LIKE '%length%' THEN 'Add explicit length guidance to prompts: ''Provide explanations of 50-100 words regardless of user profile.''' WHEN name LIKE '%readability%' THEN
     'Add readability constraint: ''Write at an 8th-grade reading level for all users.''' ELSE 'Standardize detail level: ''Include exactly 3 key factors in every explanation.''' END AS suggestion FROM ({EXPL}) WHERE is_biased""",
    "explanations",
)
def prompt_advice(t):
    return fa.prompt_advice(fa.explanation_bias(t("explanations"), "segment", "text"))


@query(
    "oversampled_groups",
    "FAI18 SET5",
    """WITH s AS (SELECT segment, count(*) AS n FROM predictions GROUP BY 1)
    SELECT segment, max(n) OVER () AS n, n AS distinct_items FROM s""",
    "predictions",
)
def oversampled_groups(t):
    """Counts only: which rows repeat depends on the hash order."""
    d = fa.oversample(t("predictions"), "segment", F.col("item_id"))
    per = d.groupBy("segment", "item_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("segment").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_items"))


@query(
    "undersampled_groups",
    "FAI19",
    """WITH s AS (SELECT segment, count(*) AS n FROM predictions GROUP BY 1) SELECT segment, min(n) OVER () AS n, min(n) OVER () AS distinct_items FROM s""",
    "predictions",
)
def undersampled_groups(t):
    d = fa.undersample(t("predictions"), "segment", F.col("item_id"))
    per = d.groupBy("segment", "item_id").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy("segment").agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("distinct_items"))


@query(
    "sample_weights",
    "FAI20",
    """WITH s AS (SELECT segment, count(*) AS n, sum(count(*)) OVER () AS t, count(*) OVER () AS k FROM predictions GROUP BY 1)
    SELECT p.item_id, round(s.t / (s.k * s.n), 9) AS weight FROM predictions p JOIN s ON s.segment = p.segment""",
    "predictions",
)
def sample_weights(t):
    return fa.sample_weights(t("predictions"), "segment").select("item_id", R("weight", 9))


@query(
    "group_thresholds",
    "FAI21",
    """SELECT segment, round(avg(CASE WHEN score >= t THEN 1 ELSE 0 END), 8) AS rate_before, round(t, 8) AS overall_threshold, round(quantile_cont(score, 0.7), 8) AS threshold
     FROM predictions CROSS JOIN (SELECT quantile_cont(score, 0.7) AS t FROM predictions) GROUP BY segment, t""",
    "predictions",
)
def group_thresholds(t):
    return fa.thresholds(t("predictions"), "segment", "score", 0.3).select("segment", R("rate_before"), R("overall_threshold"), R("threshold"))


@query(
    "mitigation_strategies",
    "FAI22",
    """WITH s AS (SELECT count(*) AS n FROM predictions GROUP BY segment), a AS (SELECT sum(n)::BIGINT AS t, count(*) AS k, max(n) AS hi, min(n) AS lo FROM s)
    SELECT 'oversample' AS strategy, t AS rows_before, hi * k AS rows_after, round(hi / lo, 8) AS imbalance_before, 1.0::DOUBLE AS imbalance_after FROM a UNION ALL SELECT 'undersample', t, lo * k, round(hi / lo, 8), 1.0 FROM a
    UNION ALL SELECT 'sample_weights', t, t, round(hi / lo, 8), 1.0 FROM a UNION ALL SELECT 'threshold_adjustment', t, t, round(hi / lo, 8), 1.0 FROM a""",
    "predictions",
)
def mitigation_strategies(t):
    return fa.strategies(t("predictions"), "segment").withColumn("imbalance_before", F.round("imbalance_before", 8))


def _predict(d):
    value = F.col("score") + F.when(F.col("segment") == "fr", 0.2).when(F.col("segment") == "de", 0.04).otherwise(0.0) + F.when(F.col("source") == "src1", 0.03).otherwise(0.0)
    return d.withColumn("prediction", value)


@query(
    "counterfactual_sensitivity",
    "RSH7 FAI24 UDF3",
    """WITH e AS (SELECT segment, CASE segment WHEN 'fr' THEN 0.2 WHEN 'de' THEN 0.04 ELSE 0.0 END::DOUBLE AS w FROM predictions GROUP BY 1), s AS (SELECT source, CASE source WHEN 'src1' THEN 0.03 ELSE 0.0 END::DOUBLE AS w FROM predictions GROUP BY 1),
    f AS (SELECT p.item_id, 'segment' AS feature, abs(a.w - b.w) AS d FROM predictions p JOIN e b ON b.segment = p.segment JOIN e a ON a.segment <> p.segment
      UNION ALL SELECT p.item_id, 'source', abs(a.w - b.w) FROM predictions p JOIN s b ON b.source = p.source JOIN s a ON a.source <> p.source)
    SELECT feature, sum(CASE WHEN d > 0.05 THEN 1 ELSE 0 END)::BIGINT AS flips, round(sum(CASE WHEN d > 0.05 THEN 1 ELSE 0 END) / (SELECT count(*) FROM predictions), 8) AS sensitivity FROM f GROUP BY 1
    UNION ALL SELECT 'any', count(*), round(count(*) / (SELECT count(*) FROM predictions), 8) FROM (SELECT item_id FROM f GROUP BY 1 HAVING max(d) > 0.05)""",
    "predictions",
)
def counterfactual_sensitivity(t):
    p = t("predictions")
    _, share = fa.counterfactual_sensitivity(p, "item_id", ("segment", "source"), _predict)
    return share.select("feature", "flips", R("sensitivity"))
