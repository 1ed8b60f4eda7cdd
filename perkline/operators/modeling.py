"""Model data, training, selection and evaluation on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.operators import fairness, features, ordered
from perkline.operators.quality import numeric_columns

TARGET = "estimated_point_value"
# Numeric model features in order.
NUMERIC_FEATURES = [
    "monthly_budget", "annual_budget", "num_cards", "monthly_budget_log", "age_group_ordinal",
    "total_spending", "total_transactions", "avg_transaction_amount", "median_transaction_amount",
    "transaction_amount_std", "spending_diversity", "weekend_spending_ratio", "card_switch_rate",
    "num_cards_used", "num_unique_mccs", "num_unique_merchants", "repeat_merchant_ratio",
    "peak_spending_day", "peak_spending_month", "spending_velocity", "category_affinity_score",
]
ONEHOT_PREFIXES = ["archetype_", "age_", "location_", "redemption_", "budget_"]


# ---------------------------------------------------------------------------- the data


def join_users(users: DataFrame, txn_features: DataFrame, check: bool = False) -> DataFrame:
    """Profiles with transaction features; ``check`` raises when nothing matches."""
    d = users.join(txn_features, "user_id", "inner")
    if check and not d.limit(1).count():
        raise ValueError("no user has both a profile and transactions")
    return d


def onehot_columns(df: DataFrame) -> list[str]:
    nums = set(numeric_columns(df))
    return sorted(c for c in df.columns if c in nums and any(c.startswith(p) for p in ONEHOT_PREFIXES))


def feature_columns(df: DataFrame) -> list[str]:
    have = [c for c in NUMERIC_FEATURES if c in df.columns]
    return have + [c for c in onehot_columns(df) if c not in have]


def completeness(df: DataFrame, target: str = TARGET) -> list[str]:
    """Warnings about a feature frame, from its schema."""
    out = []
    if target not in df.columns:
        out.append(f"target column {target} is missing")
    missing = [c for c in NUMERIC_FEATURES if c not in df.columns]
    if missing:
        out.append("missing numeric features: " + ", ".join(missing))
    if not onehot_columns(df):
        out.append("no one-hot columns")
    return out


def derived(df: DataFrame) -> DataFrame:
    """Spending velocity and category affinity where absent, peak columns default to 0."""
    d = df
    if "spending_velocity" not in d.columns:
        if {"avg_transaction_amount", "transaction_amount_std"} <= set(d.columns):
            v = F.round(features.safe_ratio(F.col("transaction_amount_std"), F.col("avg_transaction_amount")), 4)
        else:
            v = F.lit(0.0)
        d = d.withColumn("spending_velocity", v)
    if "category_affinity_score" not in d.columns:
        if "spending_diversity" in d.columns:
            share = F.col("spending_diversity") / math.log2(7)
            a = F.round(F.coalesce(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)), 4)
        else:
            a = F.lit(0.0)
        d = d.withColumn("category_affinity_score", a)
    for c in ("peak_spending_day", "peak_spending_month"):
        if c not in d.columns:
            d = d.withColumn(c, F.lit(0))
    return d


def impute(df: DataFrame) -> DataFrame:
    """Numeric features take their median, one-hot columns 0."""
    nums = [c for c in NUMERIC_FEATURES if c in df.columns]
    d = df
    if nums:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in nums]).unpivot([], nums, "column", "value")
        med = ordered.quantiles(long, ["column"], "value", {"m": 0.5})
        book = med.agg(F.map_from_entries(F.collect_list(F.struct("column", "m")))).scalar()
        d = d.withColumn("__med", book)
        for c in nums:
            d = d.withColumn(c, F.coalesce(F.col(c).cast("double"), F.try_element_at("__med", F.lit(c))))
        d = d.drop("__med")
    return d.na.fill(0, [c for c in onehot_columns(df) if c not in nums])


def imputed_counts(df: DataFrame) -> DataFrame:
    cols = feature_columns(df)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column", "filled").where("filled > 0")


def written(df: DataFrame, folder: str | None) -> DataFrame:
    """The frame written to a shared folder and read back, or as it is without one.

    Training reads its frame many times; a written table runs the aggregation over all
    transactions once, keeps later plans short, and survives a lost executor.
    """
    if folder is None:
        return df
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.parquet(folder)


def dataset(users: DataFrame, txn_features: DataFrame, target: str = TARGET, folder: str | None = None) -> tuple[DataFrame, list[str]]:
    """Joined, imputed and derived frame with its feature columns as doubles."""
    joined = written(join_users(users, txn_features), folder)
    d = derived(impute(joined))
    if target not in d.columns:
        raise ValueError(f"target column {target} is missing after the join")
    cols = feature_columns(d)
    if not cols:
        raise ValueError("no feature columns")
    return d.withColumns({c: F.col(c).cast("double") for c in [*cols, target]}), cols


def strata(df: DataFrame, target: str, bins: int = 4, discrete: bool | None = None) -> DataFrame:
    """Stratum per row: target quartile, or the raw value for few distinct values."""
    if discrete is None:
        discrete = df.select(target).distinct().limit(bins + 1).count() <= bins
    if discrete:
        return df.withColumn("stratum", F.col(target).cast("string"))
    return features.quantile_label(df, target, "stratum", [str(i) for i in range(bins)])


def split(
    df: DataFrame, target: str, key: str, train: float = 0.70, val: float = 0.15, test: float = 0.15, seed: int = 42, discrete: bool | None = None,
    order: Column | None = None,
) -> DataFrame:
    """``split`` column per row, stratified, from the position in a seeded hash order or in that of the long ``order``."""
    if abs(train + val + test - 1.0) > 0.02:
        raise ValueError("split ratios must sum to 1")
    d = strata(df, target, discrete=discrete).withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)) if order is None else order)
    n = d.groupBy("stratum").agg(F.count(F.lit(1)).alias("__n"))
    d = ordered.row_index(d, ["stratum"], ordered.hash_chunk(F.col("__h")), [F.col("__h"), F.col(key)], "__i")
    d = ordered.null_safe_join(d, n, ["stratum"])
    place = (F.col("__i") - 0.5) / F.col("__n")
    return d.withColumn(
        "split", F.when(place < train, F.lit("train")).when(place < train + val, F.lit("val")).otherwise(F.lit("test"))
    ).drop("__h", "__i", "__n")


def segment_flags(df: DataFrame, categorical: Sequence[str] = ("archetype", "age_group", "budget_quartile", "location_type")) -> DataFrame:
    """(user_id, segment) pairs: spending tier, card count and each categorical value."""
    med = ordered.quantiles(df, [], "total_spending", {"m": 0.5}).select("m").scalar()
    d = df.withColumn("__m", med)
    parts = [
        F.when(F.col("total_spending") >= F.col("__m"), F.lit("spending_tier::high_spender")).when(F.col("total_spending") < F.col("__m"), F.lit("spending_tier::low_spender")),
        F.when(F.col("num_cards") == 1, F.lit("card_count::single_card")).when(F.col("num_cards") > 1, F.lit("card_count::multi_card")),
    ]
    parts += [F.concat(F.lit(f"{c}::"), F.col(c)) for c in categorical if c in df.columns]
    return d.select("user_id", F.explode(F.array_compact(F.array(*parts))).alias("segment"))


def without_rare(df: DataFrame, target: str, least: int = 2) -> DataFrame:
    """Rows whose class has at least ``least`` members."""
    n = df.groupBy(target).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    return df.join(n.select(target), target, "left_semi")


def top_category(txns: DataFrame) -> DataFrame:
    """Most frequent category per user, equal counts by name."""
    n = txns.groupBy("user_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "category")).alias("t")).select("user_id", F.col("t.category").alias("top_category"))


# ------------------------------------------------------------------------ the learners


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="keep")


def mean_baseline(train: DataFrame, target: str):
    """A predictor that always returns the training mean, with the same call as a model."""
    mean = train.agg(F.avg(target)).first()[0]

    def predict(df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(float(mean)))

    return predict


def candidates(target: str, trees: int = 100, rounds: int = 100, seed: int = 42) -> dict[str, object]:
    return {
        "random_forest": RandomForestRegressor(labelCol=target, numTrees=trees, maxDepth=10, seed=seed),
        "gradient_boosting": GBTRegressor(labelCol=target, maxIter=rounds, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=seed),
    }


def train_all(
    train: DataFrame, val: DataFrame, columns: Sequence[str], target: str, models: Mapping[str, object]
) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit every candidate and the mean baseline, a tree without a split; leaderboard by validation RMSE."""
    train, val = train.persist(StorageLevel.MEMORY_AND_DISK), val.persist(StorageLevel.MEMORY_AND_DISK)
    entrants = {"mean_baseline": DecisionTreeRegressor(labelCol=target, maxDepth=0), **models}
    fitted = {name: Pipeline(stages=[assembler(columns), est]).fit(train) for name, est in entrants.items()}
    scored = [(name, *regression_metrics(model.transform(val), target, "prediction").first()) for name, model in fitted.items()]
    train.unpersist()
    val.unpersist()
    board = train.sparkSession.createDataFrame(scored, "model string, n long, rmse double, mae double, r2 double")
    return board.orderBy("rmse", "model"), fitted


@dataclass(frozen=True)
class TrainingRun:
    """The model chosen and the tables of a training job, read back from ``folder``.

    ``board`` has the candidates, ``metrics`` a row per split, ``ranking`` the first ten of
    the validation rows, ``segments`` and ``bias`` are of the validation rows, ``verdict``
    is that on the test rows.
    """

    best: str
    folder: str
    board: DataFrame
    metrics: DataFrame
    ranking: DataFrame
    segments: DataFrame
    bias: DataFrame
    verdict: DataFrame


def training_job(
    frame: DataFrame, columns: Sequence[str], target: str, key: str, sensitive: Sequence[str], folder: str, models: Mapping[str, object] | None = None
) -> TrainingRun:
    """Train on a frame with a ``split`` column, choose by validation RMSE, and report.

    Rows, predictions, reports and the fitted pipeline of the best model are written below
    the shared ``folder``; the model is applied once, every report reads its predictions.
    Columns of ``sensitive`` that the frame lacks are left out.  A split without rows is an
    error.
    """
    rows = written(frame, f"{folder}/rows")
    have = {r["split"] for r in rows.select("split").distinct().limit(4).collect()}
    if have != {"train", "val", "test"}:
        raise ValueError(f"splits with rows: {sorted(str(s) for s in have)}")
    board, fitted = train_all(rows.where("split = 'train'"), rows.where("split = 'val'"), columns, target, models if models is not None else candidates(target))
    board = written(board.coalesce(1), f"{folder}/board")
    best = board.orderBy("rmse", "model").first()["model"]
    fitted[best].write().overwrite().save(f"{folder}/model")
    predicted = written(fitted[best].transform(rows).drop("features"), f"{folder}/predictions")
    val = predicted.where("split = 'val'")
    groups = [c for c in sensitive if c in rows.columns]

    def report(name: str, df: DataFrame) -> DataFrame:
        return written(df, f"{folder}/{name}")

    metrics = report("metrics", predicted.groupBy("split").agg(*_errors(F.col(target).cast("double"), F.col("prediction"))))
    overfit = overfit_check(metrics.where("split = 'train'"), metrics.where("split = 'val'"))
    bias_schema = "name string, feature string, detail string, value double, threshold double, is_biased boolean"
    segment_schema = "dimension string, segment string, n long, rmse double, mae double, r2 double"
    none = rows.sparkSession.createDataFrame
    return TrainingRun(
        best, folder, board, metrics,
        report("ranking", ranking_metrics(val, target, "prediction", key, 10)),
        report("segments", segment_metrics(val, groups, target, "prediction") if groups else none([], segment_schema)),
        report("bias", fairness.model_bias(val, groups, target, "prediction") if groups else none([], bias_schema)),
        report("verdict", holdout_verdict(metrics.where("split = 'test'"), overfit)),
    )


def tune(
    train: DataFrame, columns: Sequence[str], target: str, grid: Mapping[str, Sequence], folds: int = 3, parallelism: int = 4, seed: int = 42,
    forest: RandomForestRegressor | None = None, fold: str = "",
):
    """Grid search of a random forest by k-fold RMSE; returns the refitted best model.

    ``forest`` gives settings outside the grid, ``fold`` names a column with the number of
    each row's fold in place of a drawn one.
    """
    rf = forest if forest is not None else RandomForestRegressor(labelCol=target, seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(getattr(rf, name), list(values))
    pipe = Pipeline(stages=[assembler(columns), rf])
    cv = CrossValidator(
        estimator=pipe, estimatorParamMaps=builder.build(), evaluator=RegressionEvaluator(labelCol=target, metricName="rmse"),
        numFolds=folds, parallelism=parallelism, seed=seed, foldCol=fold,
    )
    return cv.fit(train)


def linear(target: str) -> LinearRegression:
    """Ordinary least squares in closed form: one pass over the rows, the same result every time."""
    return LinearRegression(labelCol=target, solver="normal", regParam=0.0)


def train_point_value(frame: DataFrame, columns: Sequence[str], folder: str, model=None, target: str = "point_value") -> str:
    """Fit a pipeline on the rows with a target and save it in a shared ``folder``; a random forest unless given."""
    est = model if model is not None else candidates(target)["random_forest"]
    Pipeline(stages=[assembler(columns), est]).fit(frame.where(F.col(target).isNotNull())).write().overwrite().save(folder)
    return folder


def predicted_point_values(frame: DataFrame, folder: str, key: str = "user_id") -> DataFrame:
    """``key`` and point_value, as the pipeline saved in ``folder`` predicts it.

    The frame may lack columns that the pipeline was fitted on, which count as 0, and may
    have more than those.
    """
    model = PipelineModel.load(folder)
    wanted = model.stages[0].getInputCols()
    aligned = frame.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in frame.columns else F.lit(0.0) for c in wanted})
    return model.transform(aligned).select(key, F.col("prediction").alias("point_value"))


# --------------------------------------------------------------------- the evaluation


def _errors(y: Column, p: Column) -> list[Column]:
    n = F.count(F.lit(1))
    sse = F.sum((y - p) * (y - p))
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    return [
        n.alias("n"),
        F.sqrt(sse / n).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.when(sst > 0, 1 - sse / sst).otherwise(F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("r2"),
    ]


def regression_metrics(df: DataFrame, target: str, prediction: str) -> DataFrame:
    return df.agg(*_errors(F.col(target).cast("double"), F.col(prediction).cast("double")))


def segment_metrics(df: DataFrame, segments: Sequence[str], target: str, prediction: str) -> DataFrame:
    """Regression metrics per segment value, groups of at least two rows."""
    dims = F.explode(F.array(*[F.struct(F.lit(s).alias("dimension"), F.col(s).cast("string").alias("segment")) for s in segments]))
    long = df.select(dims.alias("d"), F.col(target).cast("double").alias("y"), F.col(prediction).cast("double").alias("p")).where("d.segment IS NOT NULL")
    return long.groupBy("d.dimension", "d.segment").agg(*_errors(F.col("y"), F.col("p"))).where("n >= 2")


def ranking_metrics(df: DataFrame, target: str, prediction: str, key: str, k: int = 5) -> DataFrame:
    """NDCG, MAP, precision, recall at k and MRR, the true top k being relevant.

    Equal scores order by key descending.  Both top lists are k rows; the rank of the
    first relevant row is found by counting the rows ahead of it.
    """
    true_top = df.orderBy(F.col(target).desc(), F.col(key).desc()).limit(k).select(key)
    pred = df.orderBy(F.col(prediction).desc(), F.col(key).desc()).limit(k).select(key, prediction)
    w = W.partitionBy(F.lit(0)).orderBy(F.col(prediction).desc(), F.col(key).desc())
    hits = pred.withColumn("r", F.row_number().over(w)).join(true_top, key, "left_semi")
    hits = hits.withColumn("h", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("r")))
    rel = df.join(true_top, key, "left_semi").agg(F.max(F.struct(F.col(prediction).alias("p"), F.col(key).alias("i"))).alias("b"))
    lead = df.withColumn("__b", rel.scalar()).agg(
        F.count(F.when((F.col(prediction) > F.col("__b.p")) | ((F.col(prediction) == F.col("__b.p")) & (F.col(key) > F.col("__b.i"))), 1)).alias("ahead"),
        F.least(F.count(F.lit(1)), F.lit(k)).alias("k"),
    ).select(F.struct("ahead", "k").alias("x")).scalar()
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("x.k").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    a = hits.agg(
        F.coalesce(F.sum(1 / F.log2(F.col("r") + 1)), F.lit(0.0)).alias("dcg"), F.coalesce(F.sum(F.col("h") / F.col("r")), F.lit(0.0)).alias("ap"), F.count(F.lit(1)).alias("h")
    ).withColumn("x", lead)
    kk = F.col("x.k")
    return a.select(
        F.round(F.col("dcg") / ideal, 4).alias("ndcg_at_k"), F.round(F.col("ap") / kk, 4).alias("map_at_k"), F.round(F.col("h") / kk, 4).alias("precision_at_k"),
        F.round(F.col("h") / kk, 4).alias("recall_at_k"), F.round(1 / (F.col("x.ahead") + 1), 4).alias("mrr"), kk.alias("k"),
    )


def overfit_check(train: DataFrame, val: DataFrame, rmse_gap: float = 0.3, r2_gap: float = 0.15) -> DataFrame:
    """Gaps between two one-row metric frames and the overfit flag."""
    t = train.select(F.struct("rmse", "r2").alias("t")).scalar()
    d = val.withColumn("t", t)
    g1, g2 = F.col("rmse") - F.col("t.rmse"), F.col("t.r2") - F.col("r2")
    return d.select(F.round(g1, 6).alias("rmse_gap"), F.round(g2, 6).alias("r2_gap"), ((g1 > rmse_gap) | (g2 > r2_gap)).alias("is_overfit"))


def holdout_verdict(metrics: DataFrame, overfit: DataFrame, max_rmse: float = 0.01, min_r2: float = 0.30) -> DataFrame:
    """Pass flag and the reasons against it."""
    d = metrics.withColumn("o", overfit.select(F.struct("rmse_gap", "is_overfit").alias("o")).scalar())
    reasons = F.concat_ws(
        "; ",
        F.when(F.col("rmse") > max_rmse, F.format_string(f"Test RMSE %.6f > threshold {max_rmse}", "rmse")),
        F.when(F.col("r2") < min_r2, F.format_string(f"Test R² %.4f < threshold {min_r2}", "r2")),
        F.when(F.col("o.is_overfit"), F.format_string("Overfitting detected: RMSE gap=%.6f", "o.rmse_gap")),
    )
    return d.select((reasons == "").alias("passed"), F.when(reasons == "", F.lit("All checks passed")).otherwise(reasons).alias("reason"))
