"""Distribution comparison, correlation and trial statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline.operators import ordered


# ------------------------------------------------------------------------ two samples


def common_columns(a: DataFrame, b: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in a.columns if c in b.columns and c not in exclude]


def _tagged(reference: DataFrame, current: DataFrame, columns: Sequence[str], as_type: str) -> DataFrame:
    def part(df: DataFrame, ref: int) -> DataFrame:
        one = df.select(*[F.col(c).cast(as_type).alias(c) for c in columns])
        return one.unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull()).withColumn("ref", F.lit(ref))

    return part(reference, 1).unionByName(part(current, 0))


def kolmogorov_p(z: Column, terms: int = 100) -> Column:
    """Limiting probability of a Kolmogorov statistic at least ``z``."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * z * z),
    )
    return F.when(z < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0)))


def ks_test(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per column, with moments of both sides.

    Both samples shrink to counts per distinct value; the cumulative shares are built
    chunk by chunk, so no task sees a whole column.
    """
    long = _tagged(reference, current, columns, "double")
    moments = long.groupBy("column").agg(
        *[
            f(F.when(F.col("ref") == side, F.col("value"))).alias(f"{name}_{what}")
            for side, name in ((1, "ref"), (0, "cur"))
            for what, f in (("mean", F.avg), ("std", F.stddev_pop), ("count", F.count))
        ]
    )
    counts = long.groupBy("column", "value").agg(
        F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c")
    )
    cum = ordered.cumulative(counts, ["column"], "value", ["r", "c"])
    gap = F.abs(F.col("cum_r") / F.col("all_r") - F.col("cum_c") / F.col("all_c"))
    d = cum.groupBy("column").agg(F.max(gap).alias("ks_statistic")).join(moments, "column")
    d = d.where((F.col("ref_count") >= 2) & (F.col("cur_count") >= 2))
    en = F.col("ref_count") * F.col("cur_count") / (F.col("ref_count") + F.col("cur_count"))
    return d.withColumn("p_value", kolmogorov_p(F.sqrt(en) * F.col("ks_statistic")))


def chi2_p(statistic: str, dof: Column) -> Column:
    """Upper tail of the chi-square distribution; runs on one row per tested column.

    The helper is nested so that it travels to executors by value.
    """

    def tail(x: float, k: float) -> float:
        if x <= 0 or k <= 0:
            return 1.0
        a, h = k / 2.0, x / 2.0
        front = math.exp(-h + a * math.log(h) - math.lgamma(a))
        if h < a + 1:
            term = total = 1.0 / a
            n = a
            while term > total * 1e-15:
                n += 1
                term *= h / n
                total += term
            return max(0.0, 1.0 - total * front)
        value = 0.0
        for i in range(400, 0, -1):
            value = i * (a - i) / (h + 2 * i + 1 - a + value)
        return front / (h + 1 - a + value)

    def batch(x: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([tail(float(a), float(b)) for a, b in zip(x, k)])

    return F.pandas_udf(batch, "double")(F.col(statistic), dof)


def chi_square(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Chi-square statistic and degrees of freedom per categorical column.

    A column without values on one side can't be tested and has no row.
    """
    long = _tagged(reference, current, columns, "string")
    cells = long.groupBy("column", "value").agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"))
    totals = cells.groupBy("column").agg(F.sum("r").alias("nr"), F.sum("c").alias("nc"))
    d = cells.join(totals.where((F.col("nr") > 0) & (F.col("nc") > 0)), "column")
    n = F.col("nr") + F.col("nc")
    row = F.col("r") + F.col("c")
    er, ec = row * F.col("nr") / n, row * F.col("nc") / n
    part = (F.col("r") - er) ** 2 / er + (F.col("c") - ec) ** 2 / ec
    return d.groupBy("column").agg(F.sum(part).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


def dataset_drift(
    reference: DataFrame, current: DataFrame, numeric: Sequence[str], categorical: Sequence[str], alpha: float = 0.05, share: float = 0.3
) -> tuple[DataFrame, DataFrame]:
    """Per-column verdicts and one row saying whether the dataset drifted."""
    parts = []
    if numeric:
        ks = ks_test(reference, current, numeric)
        parts.append(ks.select("column", F.lit("ks").alias("test"), F.col("ks_statistic").alias("statistic"), "p_value"))
    if categorical:
        ch = chi_square(reference, current, categorical)
        parts.append(ch.select("column", F.lit("chi_square").alias("test"), F.col("chi2").alias("statistic"), chi2_p("chi2", F.col("dof").cast("double")).alias("p_value")))
    per = parts[0]
    for p in parts[1:]:
        per = per.unionByName(p)
    per = per.withColumn("drifted", F.col("p_value") < alpha)
    verdict = per.agg(
        F.sum(F.col("drifted").cast("long")).alias("drifted_columns"),
        F.count(F.lit(1)).alias("columns"),
        (F.avg(F.col("drifted").cast("double")) > share).alias("dataset_drift"),
    )
    return per, verdict


def binned_kl(reference: DataFrame, current: DataFrame, column: str, low: float, high: float, bins: int = 20) -> DataFrame:
    """Divergence of binned shares, with half a count added to every bin."""
    def side(df: DataFrame, name: str) -> DataFrame:
        b = F.least(F.greatest(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)), F.lit(0)), F.lit(bins + 1))
        return df.where(F.col(column).isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias(name))

    spine = reference.sparkSession.range(0, bins + 2).select(F.col("id").cast("int").alias("bin"))
    d = spine.join(side(reference, "r"), "bin", "left").join(side(current, "c"), "bin", "left")
    r = F.coalesce("r", F.lit(0)) + 0.5
    c = F.coalesce("c", F.lit(0)) + 0.5
    sums = d.agg(F.sum(r).alias("r"), F.sum(c).alias("c"), F.sum(c * F.log(c / r)).alias("x"))
    return sums.select((F.col("x") / F.col("c") + F.log(F.col("r") / F.col("c"))).alias("kl"))


# ----------------------------------------------------------------------- correlations


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"c{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return wide.select(F.inline(rows))


def with_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column's average rank as ``rank_<column>``; rank tables hold distinct values."""
    d = df
    for c in columns:
        ranks = ordered.average_ranks(df, c, f"rank_{c}")
        d = d.join(ranks, c, "left")
    return d


def spearman(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Rank correlation of each column with the target, strongest first.

    All columns are one long table of (column, value, target's value, rows), ranked in one
    cumulative pass; each pair of values asks for its two ranks by one join, whatever the
    number of columns, and the correlation comes from sums of products.  Ranks are taken
    from the middle, so the sums stay small.
    """
    y = F.col(target).cast("double")
    named = [F.struct(F.lit(f"c:{c}").alias("column"), F.col(c).cast("double").alias("v"), y.alias("t")) for c in columns]
    named.append(F.struct(F.lit("target").alias("column"), y.alias("v"), y.alias("t")))
    long = df.select(F.inline(F.array(*named))).groupBy("column", "v", "t").agg(F.count(F.lit(1)).alias("n"))
    values = long.where(F.col("v").isNotNull()).groupBy("column", "v").agg(F.sum("n").alias("n"))
    ranked = ordered.cumulative(values, ["column"], "v", ["n"])
    middle = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2 - (F.col("all_n") + 1) / 2
    ranks = ranked.select(F.col("column").alias("of"), F.col("v").alias("value"), middle.alias("r"))
    pairs = long.where(F.col("v").isNotNull() & F.col("t").isNotNull() & (F.col("column") != "target"))
    asked = F.array(F.struct(F.col("column").alias("of"), F.col("v").alias("value")), F.struct(F.lit("target").alias("of"), F.col("t").alias("value")))
    found = pairs.select("column", "v", "t", "n", F.inline(asked)).join(ranks, ["of", "value"])
    both = found.groupBy("column", "v", "t").agg(
        F.max("n").alias("n"), F.max(F.when(F.col("of") != "target", F.col("r"))).alias("a"), F.max(F.when(F.col("of") == "target", F.col("r"))).alias("b")
    )
    n, a, b = F.col("n"), F.col("a"), F.col("b")
    s = both.groupBy("column").agg(*[F.sum(x).alias(k) for k, x in {"rows": n, "sa": n * a, "sb": n * b, "saa": n * a * a, "sbb": n * b * b, "sab": n * a * b}.items()])
    rows = F.col("rows")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / rows, F.col("sbb") - F.col("sb") * F.col("sb") / rows
    corr = F.when((va > 0) & (vb > 0), (F.col("sab") - F.col("sa") * F.col("sb") / rows) / F.sqrt(va * vb))
    every = df.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    # One row per column, so that a column without a pair of values is named too.
    found = s.withColumn("correlation", corr).agg(F.map_from_entries(F.collect_list(F.struct("column", "correlation"))).alias("m"))
    rows = F.array(*[F.struct(F.lit(c).alias("parameter"), F.try_element_at("m", F.lit(f"c:{c}")).alias("correlation")) for c in columns])
    return found.select(F.inline(rows)).where(every >= 3).select("parameter", "correlation", F.abs("correlation").alias("importance"))


def interactions(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """How much the product of two parameters ranks with the target beyond either alone."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    d = df.select(*columns, target, *[(F.col(a) * F.col(b)).alias(f"{a}__x__{b}") for a, b in pairs])
    alls = [*columns, *[f"{a}__x__{b}" for a, b in pairs]]
    found = spearman(d, alls, target).agg(F.map_from_entries(F.collect_list(F.struct("parameter", "importance"))).alias("m"))
    of = {c: F.try_element_at("m", F.lit(c)) for c in alls}
    rows = [
        F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.greatest(of[f"{x}__x__{y}"] - F.greatest(of[x], of[y]), F.lit(0.0)).alias("interaction"), of[f"{x}__x__{y}"].alias("joint_correlation"))
        for x, y in pairs
    ]
    return found.where(F.size("m") > 0).select(F.inline(F.array(*rows)))


def safe_ranges(trials: DataFrame, columns: Sequence[str], metric: str, key: str) -> DataFrame:
    """10-90 % range of each parameter among the best quarter of trials, and the best value."""
    cut = ordered.quantiles(trials, [], metric, {"q": 0.25}).select("q").scalar()
    best = trials.withColumn("__cut", cut).where(F.col(metric) <= F.col("__cut"))
    long = best.select(*columns).unpivot([], list(columns), "parameter", "value")
    q = ordered.quantiles(long, ["parameter"], "value", {"low": 0.1, "high": 0.9}).drop("n_values")
    top = trials.agg(F.min(F.struct(metric, key, *columns)).alias("t")).select(*[F.col(f"t.{c}").alias(c) for c in columns])
    top = top.unpivot([], list(columns), "parameter", "best_value")
    return q.join(top, "parameter")


def rank_agreement(a: DataFrame, b: DataFrame, key: str = "feature", value: str = "importance", top: int = 5) -> DataFrame:
    """Rank correlation and top-k overlap of two importance tables joined on feature."""
    j = a.select(key, F.col(value).alias("va")).join(b.select(key, F.col(value).alias("vb")), key)
    corr = with_ranks(j, ["va", "vb"]).agg(F.corr("rank_va", "rank_vb").alias("spearman"))
    ta = a.orderBy(F.col(value).desc(), key).limit(top).select(key)
    tb = b.orderBy(F.col(value).desc(), key).limit(top).select(key)
    both = ta.join(tb, key, "left_semi").agg((F.count(F.lit(1)) / top * 100).alias("overlap_pct"))
    return corr.withColumn("overlap_pct", both.scalar())


def metric_drift(previous: DataFrame, current: DataFrame, keys: Sequence[str], value: str, limit: float = 0.05) -> DataFrame:
    """Outer join of two metric tables with absolute and relative change and a verdict.

    A metric missing on one side counts as zero; growth from zero is infinite.
    """
    p = previous.select(*keys, F.col(value).alias("before"))
    c = current.select(*keys, F.col(value).alias("after"))
    d = p.join(c, list(keys), "full_outer").select(
        *keys, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after")
    )
    change = F.col("after") - F.col("before")
    rel = (
        F.when(F.col("before") != 0, change / F.abs("before"))
        .when(F.col("after") == 0, F.lit(0.0))
        .otherwise(F.lit(float("inf")))
    )
    return d.withColumns({"change": change, "relative": rel}).withColumn(
        "verdict",
        F.when(F.col("relative") > limit, F.lit("regression")).when(F.col("relative") < -limit, F.lit("improvement")).otherwise(F.lit("stable")),
    )


def retrain_decision(signals: DataFrame, runs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Whether to retrain: drift or alerts, unless a run is active or recent.

    ``signals`` is one row (dataset_drift, alerts); ``runs`` has (status, started_at).
    """
    recent = runs.agg(
        F.coalesce(F.max(F.col("status") == "running"), F.lit(False)).alias("active"),
        F.coalesce(F.max(F.col("started_at") >= now - F.make_dt_interval(F.lit(0), F.lit(hours))), F.lit(False)).alias("recent"),
    ).select(F.struct("active", "recent").alias("r")).scalar()
    d = signals.withColumn("r", recent)
    reasons = F.concat_ws(", ", F.when(F.col("dataset_drift"), F.lit("drift")), F.when(F.col("alerts") > 0, F.lit("alerts")))
    return d.select(
        reasons.alias("reasons"),
        ((reasons != "") & ~F.col("r.active") & ~F.col("r.recent")).alias("retrain"),
        F.col("r.active").alias("run_active"),
        F.col("r.recent").alias("run_recent"),
    )
