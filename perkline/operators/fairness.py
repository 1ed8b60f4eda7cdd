"""Slices, fairness metrics, mitigation and counterfactual sensitivity.

Metric rows share one shape: name, feature, detail, value, threshold, is_biased.
Group tables are small (one row per group); every pass over the data is a plain
aggregate that combines map-side, so one dominant group costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.functions import text
from perkline import dims
from perkline.operators import features, ordered


def metric_row(name: str, feature: str, value: Column, threshold: float, detail: Column | None = None, biased: Column | None = None) -> list[Column]:
    return [
        F.lit(name).alias("name"),
        F.lit(feature).alias("feature"),
        (detail if detail is not None else F.lit("")).alias("detail"),
        value.cast("double").alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        F.coalesce(biased if biased is not None else value > threshold, F.lit(False)).alias("is_biased"),
    ]


# ------------------------------------------------------------------------------ slices


def slices(df: DataFrame, columns: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Size, share and mean/std/median of each metric per slice, nulls a slice of their own.

    All dimensions go through one aggregate.
    """
    dims = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]))
    long = df.select(dims.alias("d"), *[F.col(m).cast("double").alias(m) for m in metrics]).select(
        F.col("d.c").alias("slice_column"), F.col("d.v").alias("slice_value"), *metrics
    )
    keys = ["slice_column", "slice_value"]
    out = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        *[x for m in metrics for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std"))],
    )
    for m in metrics:
        q = ordered.quantiles(long, keys, m, {f"{m}_median": 0.5}).drop("n_values")
        out = ordered.null_safe_join(out, q, keys, "left")
    totals = out.groupBy("slice_column").agg(
        F.sum("count").alias("__t"), (F.max("count") / F.min("count")).alias("imbalance")
    )
    return out.join(totals, "slice_column").withColumn("fraction", F.col("count") / F.col("__t")).drop("__t")


def quantile_slices(df: DataFrame, column: str, metrics: Sequence[str], n: int = 4) -> DataFrame:
    d = features.quantile_label(df, column, f"{column}_quantile", [f"Q{i + 1}" for i in range(n)])
    return slices(d, [f"{column}_quantile"], metrics)


def bin_slices(df: DataFrame, column: str, edges: Sequence[float], labels: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Custom bins, right-closed with the lowest edge included; outside values are null."""
    v = F.col(column)
    label = None
    for i, lab in enumerate(labels):
        low = (v >= edges[i]) if i == 0 else (v > edges[i])
        arm = low & (v <= edges[i + 1])
        label = F.when(arm, F.lit(lab)) if label is None else label.when(arm, F.lit(lab))
    return slices(df.withColumn(f"{column}_binned", label), [f"{column}_binned"], metrics)


# ------------------------------------------------------------------------ data fairness


def representation(df: DataFrame, feature: str, min_share: float = 0.05, max_ratio: float = 2.0) -> DataFrame:
    """Groups under the minimum share, and the largest-to-smallest ratio; nulls left out."""
    g = df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    total = g.agg(F.sum("n")).scalar()
    small = g.withColumn("share", F.col("n") / total).where(F.col("share") < min_share)
    a = small.select(*metric_row("underrepresentation", feature, F.col("share"), min_share, F.col("g"), F.lit(True)))
    r = g.agg((F.max("n") / F.min("n")).alias("r"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return a.unionByName(r.select(*metric_row("representation_imbalance", feature, F.col("r"), max_ratio)))


def _group_means(df: DataFrame, feature: str, expr: Column) -> DataFrame:
    return df.where(F.col(feature).isNotNull()).groupBy(F.col(feature).cast("string").alias("g")).agg(expr.alias("m"))


def outcome_disparity(df: DataFrame, feature: str, outcome: str, limit: float = 2.0) -> DataFrame:
    """Highest over lowest group mean, with the best and worst group named."""
    m = _group_means(df, feature, F.avg(outcome)).agg(
        F.max("m").alias("hi"), F.min("m").alias("lo"), F.count(F.lit(1)).alias("k"),
        F.max_by("g", F.struct("m", "g")).alias("best"), F.min_by("g", F.struct("m", "g")).alias("worst"),
    ).where("k >= 2")
    ratio = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).when(F.col("hi") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return m.select(*metric_row("outcome_disparity", feature, ratio, limit, F.concat(F.lit(f"{outcome}: "), "best", F.lit(" vs "), "worst")))


def group_difference(
    df: DataFrame, feature: str, column: str, metric: Callable[[Column], Column] = F.avg, limit: float = 0.20
) -> DataFrame:
    """Largest relative deviation of a group's metric from the overall one.

    ``metric`` builds an aggregate column, so a custom metric stays inside Spark.
    """
    overall = df.agg(metric(F.col(column))).scalar()
    g = _group_means(df, feature, metric(F.col(column))).withColumn("o", overall)
    g = g.withColumn("d", F.abs(F.col("m") - F.col("o")) / F.greatest(F.abs("o"), F.lit(1e-10)))
    worst = g.agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("k"), F.max_by("g", F.struct("d", "g")).alias("w")).where("k >= 2")
    return worst.select(*metric_row("group_metric_difference", feature, F.col("d"), limit, F.concat(F.lit(f"{column}: "), "w")))


def data_bias_scan(df: DataFrame, features_: Sequence[str], outcomes: Sequence[str]) -> DataFrame:
    out = None
    for f in features_:
        parts = [representation(df, f)]
        for o in outcomes:
            parts += [outcome_disparity(df, f, o), group_difference(df, f, o)]
        for p in parts:
            out = p if out is None else out.unionByName(p)
    return out


# ----------------------------------------------------------------------- model fairness


def binarize(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Real predictions split at their median, real truth at zero."""
    d = df
    if df.schema[y_pred].dataType.typeName() in ("double", "float"):
        cut = ordered.quantiles(df, [], y_pred, {"m": 0.5}).select("m").scalar()
        d = d.withColumn("__cut", cut).withColumn("__yp", (F.col(y_pred) >= F.col("__cut")).cast("int")).drop("__cut")
    else:
        d = d.withColumn("__yp", F.col(y_pred))
    truth = (F.col(y_true) > 0).cast("int") if df.schema[y_true].dataType.typeName() in ("double", "float") else F.col(y_true)
    return d.withColumn("__yt", truth)


def classification_fairness(df: DataFrame, feature: str, y_true: str, y_pred: str, limit: float = 0.10) -> DataFrame:
    """Demographic parity, equalized odds, and accuracy gap and ratio between groups."""
    b = binarize(df, y_true, y_pred)
    p, y = F.col("__yp"), F.col("__yt")
    g = b.where(F.col(feature).isNotNull()).groupBy(F.col(feature).alias("g")).agg(
        F.avg(p).alias("rate"),
        F.avg(F.when(y == 1, p)).alias("tpr"),
        F.avg(F.when(y == 0, p)).alias("fpr"),
        F.avg((p == y).cast("double")).alias("acc"),
    )
    gap = lambda c: F.max(c) - F.min(c)
    m = g.agg(
        gap("rate").alias("dp"), F.greatest(F.coalesce(gap("tpr"), F.lit(0.0)), F.coalesce(gap("fpr"), F.lit(0.0))).alias("eo"),
        gap("acc").alias("ad"), (F.min("acc") / F.max("acc")).alias("ar"),
    )
    rows = [
        ("demographic_parity_difference", F.col("dp"), F.col("dp") > limit),
        ("equalized_odds_difference", F.col("eo"), F.col("eo") > limit),
        ("accuracy_difference", F.col("ad"), F.lit(False)),
        ("accuracy_ratio", F.col("ar"), F.lit(False)),
    ]
    packed = F.array(*[F.struct(*metric_row(n, feature, v, limit, None, bi)) for n, v, bi in rows])
    return m.select(F.inline(packed))


def group_rates(df: DataFrame, feature: str, y_true: str, y_pred: str) -> DataFrame:
    b = binarize(df, y_true, y_pred)
    return b.groupBy(F.col(feature).alias("group")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__yp").alias("selection_rate"),
        F.avg((F.col("__yp") == F.col("__yt")).cast("double")).alias("accuracy"),
    )


def performance_disparity(
    df: DataFrame, feature: str, error: Column, min_size: int = 10, limit: float = 0.10, name: str = "performance_disparity"
) -> DataFrame:
    """Largest relative deviation of a group's mean error; small groups are left out.

    ``error`` is a row-level expression, e.g. ``F.abs(y - p)``; a custom metric is
    another expression under another ``name``.
    """
    overall = df.agg(F.avg(error)).scalar()
    g = df.groupBy(F.col(feature).cast("string").alias("g")).agg(F.avg(error).alias("m"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_size)
    g = g.withColumn("o", overall).where(F.col("o") != 0)
    m = g.agg(F.max(F.abs(F.col("m") - F.col("o")) / F.col("o")).alias("d"), F.max("m").alias("hi"), F.min("m").alias("lo")).where("d IS NOT NULL")
    ratio = F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")).when(F.col("hi") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
    return m.select(*metric_row(name, feature, F.col("d"), limit, F.format_string("ratio %.4f", ratio)))


def model_bias(df: DataFrame, features_: Sequence[str], y_true: str, y_pred: str, min_size: int = 10) -> DataFrame:
    """Every model fairness metric for every sensitive feature."""
    out = None
    err = F.abs(F.col(y_true) - F.col(y_pred))
    for f in features_:
        part = classification_fairness(df, f, y_true, y_pred).unionByName(performance_disparity(df, f, err, min_size))
        out = part if out is None else out.unionByName(part)
    return out


def ranking_by_slice(
    df: DataFrame, slice_columns: Sequence[str], y_true: str, y_pred: str, item: str, k: int = 5, limit: float = 0.10
) -> DataFrame:
    """NDCG, precision and recall at k per slice and overall, with the disparity flag.

    Both orderings only need the first k rows of a slice, which Spark limits before
    the shuffle, so a dominant slice sends k rows per task.
    """
    dims = [F.struct(F.lit("overall").alias("c"), F.lit("all").alias("v"))]
    dims += [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in slice_columns]
    long = df.select(F.explode(F.array(*dims)).alias("d"), F.col(y_true).cast("double").alias("y"), F.col(y_pred).cast("double").alias("p"), F.col(item).alias("i"))
    long = long.select(F.col("d.c").alias("feature"), F.col("d.v").alias("slice"), "y", "p", "i").where(F.col("slice").isNotNull())
    keys = ["feature", "slice"]
    def top(order: Column) -> DataFrame:
        w = W.partitionBy(*keys).orderBy(order, F.col("i"))
        return long.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)

    gain = F.sum(F.col("y") / F.log2(F.col("r") + 1))
    by_pred = top(F.col("p").desc()).groupBy(*keys).agg(
        gain.alias("dcg"), F.avg((F.col("y") > 0).cast("double")).alias("precision"), F.sum((F.col("y") > 0).cast("long")).alias("hits")
    )
    by_true = top(F.col("y").desc()).groupBy(*keys).agg(gain.alias("idcg"))
    size = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum((F.col("y") > 0).cast("long")).alias("relevant"))
    d = size.join(by_pred, keys).join(by_true, keys)
    d = d.select(
        *keys, "count",
        F.when(F.col("idcg") == 0, 0.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"),
        "precision",
        F.when(F.col("relevant") == 0, 0.0).otherwise(F.col("hits") / F.col("relevant")).alias("recall"),
    )
    long_m = d.unpivot([*keys, "count"], ["ndcg", "precision", "recall"], "metric", "value")
    base = long_m.where("feature = 'overall'").select("metric", F.col("value").alias("overall"))
    j = long_m.join(base, "metric")
    dev = F.when(F.col("overall") != 0, F.abs(F.col("value") - F.col("overall")) / F.abs("overall"))
    return j.withColumn("deviation", dev).withColumn("disparity", F.coalesce(F.col("deviation") > limit, F.lit(False)))


def recommendation_diversity(df: DataFrame, column: str) -> DataFrame:
    per = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per.agg((F.count(F.lit(1)) / F.sum("n")).alias("diversity"))


# ------------------------------------------------------------------- component fairness


def issuer_bias(df: DataFrame, segment: str, issuer: str, limit: float = 0.15) -> DataFrame:
    """Spread of each issuer's share over segments; an absent issuer has share zero.

    Only the (segment, issuer) pairs that occur are counted; absence is seen from the
    number of segments.
    """
    pairs = df.where(F.col(segment).isNotNull() & F.col(issuer).isNotNull()).groupBy(
        F.col(segment).alias("s"), F.col(issuer).alias("i")
    ).agg(F.count(F.lit(1)).alias("n"))
    per_seg = pairs.groupBy("s").agg(F.sum("n").alias("t"))
    k = per_seg.agg(F.count(F.lit(1))).scalar()
    shares = pairs.join(per_seg, "s").withColumn("share", F.col("n") / F.col("t"))
    g = shares.groupBy("i").agg(F.max("share").alias("hi"), F.min("share").alias("lo"), F.count(F.lit(1)).alias("k"))
    low = F.when(F.col("k") < F.col("segments"), F.lit(0.0)).otherwise(F.col("lo"))
    g = g.withColumn("segments", k)
    return g.select(*metric_row("issuer_disparity", segment, F.col("hi") - low, limit, F.col("i")), F.col("hi").alias("max_rate"))


def premium_bias(df: DataFrame, segment: str, card_type: str, limit: float = 0.15) -> DataFrame:
    """Gap between segments in the share of premium recommendations."""
    premium = F.coalesce(F.lower(card_type).isin("premium", "luxury", "platinum", "reserve"), F.lit(False)).cast("double")
    g = _group_means(df, segment, F.avg(premium))
    m = g.agg((F.max("m") - F.min("m")).alias("d"), F.count(F.lit(1)).alias("k")).where("k >= 2")
    return m.select(*metric_row("premium_card_disparity", segment, F.col("d"), limit))


def explanation_bias(
    df: DataFrame, segment: str, body: str, length_limit: float = 0.20, grade_limit: float = 0.15
) -> DataFrame:
    """Largest deviation of a segment's mean length, reading grade and word count."""
    d = df.select(F.col(segment).alias("s"), text.text_measures(F.col(body)).alias("m")).select("s", "m.length", "m.grade", "m.words")
    cols = ["length", "grade", "words"]
    g = d.groupBy("s").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in cols])
    overall = g.agg(F.struct(*[(F.sum(c) / F.sum("n")).alias(c) for c in cols]).alias("o")).scalar()
    g = g.where(F.col("s").isNotNull()).withColumn("o", overall)
    worst = g.agg(*[F.max(F.abs(F.col(c) / F.col("n") - F.col(f"o.{c}")) / F.abs(F.col(f"o.{c}"))).alias(c) for c in cols])
    rows = [("explanation_length_disparity", "length", length_limit), ("readability_disparity", "grade", grade_limit), ("detail_level_disparity", "words", length_limit)]
    packed = F.array(*[F.struct(*metric_row(n, segment, F.col(c), lim)) for n, c, lim in rows])
    return worst.select(F.inline(packed))


# --------------------------------------------------------------------------- mitigation


COPIES_PER_BLOCK = 10_000


def _sizes(df: DataFrame, group: str) -> DataFrame:
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("__n"))


def oversample(df: DataFrame, group: str, key: Column, ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Repeat rows of smaller groups until each reaches the target size exactly.

    Every row keeps its original and takes an equal number of copies; a hash order
    decides who takes one more.  A row with very many copies is cut into blocks that
    spread over the cluster before they are written out.
    """
    sizes = _sizes(df, group)
    target = sizes.agg(F.floor(F.max("__n") * (ratio if ratio is not None else 1.0)).cast("long")).scalar()
    d = df.join(sizes, group).withColumn("__target", target)
    big = d.where(F.col("__n") >= F.col("__target")).select(*df.columns)
    h = F.xxhash64(key, F.lit(seed))
    small = ordered.row_index(
        d.where(F.col("__n") < F.col("__target")).withColumn("__h", h), [group], ordered.hash_chunk(F.col("__h")), [F.col("__h"), key], "__i"
    )
    copies = F.floor(F.col("__target") / F.col("__n")) + (F.col("__i") <= F.col("__target") % F.col("__n")).cast("long")
    blocks = small.withColumn("__copies", copies).withColumn(
        "__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / COPIES_PER_BLOCK)))
    )
    blocks = blocks.repartition("__h", "__block")
    left = F.least(F.col("__copies") - F.col("__block") * COPIES_PER_BLOCK, F.lit(COPIES_PER_BLOCK).cast("long"))
    grown = blocks.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
    return big.unionByName(grown.select(*df.columns))


def undersample(df: DataFrame, group: str, key: Column, ratio: float | None = None, seed: int = 42) -> DataFrame:
    """Keep the target number of rows per group, the first in a seeded hash order."""
    sizes = _sizes(df, group)
    target = sizes.agg(F.greatest(F.floor(F.min("__n") * (ratio if ratio is not None else 1.0)), F.lit(1)).cast("long")).scalar()
    d = df.where(F.col(group).isNotNull()).withColumn("__h", F.xxhash64(key, F.lit(seed)))
    d = ordered.row_index(d, [group], ordered.hash_chunk(F.col("__h")), [F.col("__h"), key], "__i")
    return d.withColumn("__target", target).where(F.col("__i") <= F.col("__target")).select(*df.columns)


def sample_weights(df: DataFrame, group: str) -> DataFrame:
    """Inverse-frequency weight per row with mean 1."""
    sizes = _sizes(df, group)
    k = sizes.agg(F.struct(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    w = sizes.withColumn("__t", k).select(group, (F.col("__t.n") / (F.col("__t.k") * F.col("__n"))).alias("weight"))
    return df.join(w, group, "left")


def thresholds(df: DataFrame, group: str, score: str, target_rate: float = 0.5) -> DataFrame:
    """Per-group score threshold for the target rate, and the rate at the overall one."""
    p = 1 - target_rate
    overall = ordered.quantiles(df, [], score, {"t": p}).select("t").scalar()
    rates = (
        df.withColumn("__t", overall)
        .groupBy(group)
        .agg(F.avg((F.col(score) >= F.col("__t")).cast("double")).alias("rate_before"), F.max("__t").alias("overall_threshold"))
    )
    per = ordered.quantiles(df, [group], score, {"threshold": p}).drop("n_values")
    return rates.join(per, group)


def imbalance(sizes: DataFrame, n: str = "__n") -> Column:
    return F.when(F.count(F.lit(1)) >= 2, F.max(n) / F.min(n)).otherwise(F.lit(1.0))


def strategies(df: DataFrame, group: str) -> DataFrame:
    """Rows and imbalance before and after each mitigation, from group sizes alone."""
    sizes = _sizes(df, group)
    s = sizes.agg(
        F.sum("__n").alias("rows_before"), F.count(F.lit(1)).alias("k"), F.max("__n").alias("hi"), F.min("__n").alias("lo"),
        imbalance(sizes).alias("before"),
    )
    rows = [
        ("oversample", F.col("hi") * F.col("k"), F.lit(1.0)),
        ("undersample", F.col("lo") * F.col("k"), F.lit(1.0)),
        ("sample_weights", F.col("rows_before"), F.lit(1.0)),
        ("threshold_adjustment", F.col("rows_before"), F.lit(1.0)),
    ]
    packed = F.array(
        *[
            F.struct(
                F.lit(n).alias("strategy"), F.col("rows_before").alias("rows_before"), after.cast("long").alias("rows_after"),
                F.col("before").alias("imbalance_before"), ia.alias("imbalance_after"),
            )
            for n, after, ia in rows
        ]
    )
    return s.select(F.inline(packed))


def issuer_caps(bias: DataFrame, step: float = 0.05) -> DataFrame:
    """Suggested cap for each issuer flagged by :func:`issuer_bias`."""
    return bias.where("is_biased").select(F.col("detail").alias("issuer"), (F.col("max_rate") - step).alias("cap"))


def prompt_advice(bias: DataFrame) -> DataFrame:
    """Advice on the prompt for each biased measure of the explanations."""
    advice = F.coalesce(*[F.when(F.col("name").contains(part), F.lit(text)) for part, text in dims.PROMPT_ADVICE])
    return bias.where("is_biased").select("name", advice.alias("suggestion")).where("suggestion IS NOT NULL")


def bias_gate(metrics: DataFrame, limit: float = 0.10) -> DataFrame:
    """One row: whether no biased metric exceeds the limit."""
    bad = F.sum((F.col("is_biased") & (F.col("value") > limit)).cast("long"))
    return metrics.agg(F.coalesce(bad, F.lit(0)).alias("blocking")).withColumn("passed", F.col("blocking") == 0)


def metric_gate(metrics: DataFrame, minimums: Mapping[str, float]) -> DataFrame:
    """One row: whether every named metric reaches its minimum; a missing one counts as 0."""
    aggs = [F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0)).alias(m) for m in minimums]
    ok = F.lit(True)
    for m, lo in minimums.items():
        ok = ok & (F.col(m) >= lo)
    return metrics.agg(*aggs).select(ok.alias("passed"))


# ----------------------------------------------------------------------- counterfactual


VALUES_PER_CHUNK = 256


def counterfactuals(df: DataFrame, columns: Sequence[str], per_chunk: int = VALUES_PER_CHUNK) -> DataFrame:
    """Each row once per other value of each sensitive column.

    The values are a table of chunks of about ``per_chunk``, as many as there are values;
    a row asks for each chunk by its number and is then exploded by that chunk alone, so no
    row and no task ever holds all values of a column.
    """
    out = None
    for c in columns:
        values = df.where(F.col(c).isNotNull()).select(F.col(c).alias("__alt")).distinct()
        chunks = values.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_chunk)).cast("int").alias("n")).select("n").scalar()
        held = values.withColumn("__chunk", F.pmod(F.xxhash64("__alt"), chunks).cast("int")).groupBy("__chunk").agg(F.collect_list("__alt").alias("__alts"))
        asked = df.withColumn("__chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        d = asked.join(held, "__chunk").drop("__chunk").withColumn("__alt", F.explode("__alts")).drop("__alts").where(~F.col("__alt").eqNullSafe(F.col(c)))
        d = d.withColumn("flipped", F.lit(c)).withColumn("original_value", F.col(c)).withColumn(c, F.col("__alt")).drop("__alt")
        out = d if out is None else out.unionByName(d)
    return out


def counterfactual_sensitivity(
    df: DataFrame, item: str, columns: Sequence[str], predict: Callable[[DataFrame], DataFrame], limit: float = 0.05
) -> tuple[DataFrame, DataFrame]:
    """Largest prediction change per row, and the share of sensitive rows per feature.

    ``predict`` adds a ``prediction`` column: a Spark ML model's ``transform``, an
    expression, or a ``mapInPandas`` wrapper around a foreign model.
    """
    base = predict(df).withColumnRenamed("prediction", "__base")
    flips = predict(counterfactuals(base, columns)).withColumn("__d", F.abs(F.col("prediction") - F.col("__base")))
    per_item = flips.groupBy(item).agg(F.max("__d").alias("max_change")).withColumn("is_sensitive", F.col("max_change") > limit)
    n = df.agg(F.count(F.lit(1))).scalar()
    per_feature = flips.groupBy(F.col("flipped").alias("feature")).agg(F.sum((F.col("__d") > limit).cast("long")).alias("flips")).withColumn(
        "sensitivity", F.col("flips") / n
    )
    overall = per_item.agg(F.sum(F.col("is_sensitive").cast("long")).alias("flips")).select(
        F.lit("any").alias("feature"), "flips", (F.col("flips") / n).alias("sensitivity")
    )
    return per_item, per_feature.unionByName(overall)
