"""Table profiles: descriptive statistics, histograms, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline.operators import ordered
from perkline.operators.quality import numeric_columns

TIDY = ["statistic", "item", "value"]


def _tidy(wide: DataFrame, item: str = "") -> DataFrame:
    d = wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns])
    return d.unpivot([], d.columns, "statistic", "value").select("statistic", F.lit(item).alias("item"), "value")


def distribution(df: DataFrame, column: str, statistic: str) -> DataFrame:
    """Row count per value as tidy rows."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("item"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
        .select(F.lit(statistic).alias("statistic"), "item", "value")
    )


def _quartiles(df: DataFrame, column: str, probs: dict[str, float]) -> DataFrame:
    return _tidy(ordered.quantiles(df, [], column, probs).drop("n_values"))


def distinct_count(df: DataFrame, column: str, name: str) -> DataFrame:
    """Exact distinct count as its own aggregate, so it does not expand the others."""
    return _tidy(df.where(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("x")).agg(F.count(F.lit(1)).alias(name)))


def card_statistics(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    fee = F.col("annual_fee").try_cast("double")
    rate = F.col("base_reward_rate")
    wide = df.agg(
        n.alias("total_cards"),
        F.avg(fee).alias("fee_mean"), F.min(fee).alias("fee_min"), F.max(fee).alias("fee_max"), F.stddev_samp(fee).alias("fee_std"),
        F.count(F.when(fee == 0, 1)).alias("no_fee_count"), (F.count(F.when(fee == 0, 1)) / n * 100).alias("no_fee_pct"),
        F.count(F.when(fee >= 450, 1)).alias("premium_count"), (F.count(F.when(fee >= 450, 1)) / n * 100).alias("premium_pct"),
        F.avg(rate).alias("rate_mean"), F.min(rate).alias("rate_min"), F.max(rate).alias("rate_max"),
        F.count(F.when(F.col("is_business") == 1, 1)).alias("business_count"), (F.count(F.when(F.col("is_business") == 1, 1)) / n * 100).alias("business_pct"),
        F.count(F.when(F.col("discontinued"), 1)).alias("discontinued_count"), (F.count(F.when(F.col("discontinued"), 1)) / n * 100).alias("discontinued_pct"),
    )
    d = df.withColumn("__fee", fee)
    return (
        _tidy(wide)
        .unionByName(_quartiles(d, "__fee", {"fee_median": 0.5}))
        .unionByName(_quartiles(d, "base_reward_rate", {"rate_median": 0.5}))
        .unionByName(distinct_count(df, "issuer", "unique_issuers"))
        .unionByName(distinct_count(df, "network", "unique_networks"))
        .unionByName(distribution(df, "currency", "currency_distribution"))
    )


def _counted(df: DataFrame) -> DataFrame:
    """Distinct users and merchants, merchants per user, and counts and sums per category, from one grouping."""
    d = df.select("category", "user_id", "merchant", "amount", F.col("merchant").isNotNull().cast("long").alias("__named"))
    sets = d.groupingSets([["category"], ["user_id"], ["merchant"], ["user_id", "merchant"]], "category", "user_id", "merchant").agg(
        F.grouping_id().alias("set"), F.count(F.lit(1)).cast("double").alias("n"), F.sum("amount").alias("total"), F.sum("__named").alias("named")
    )
    # The set is a bit per column, in order, one where the column is not part of it.
    category, user, merchant, pair = (F.col("set") == b for b in (0b011, 0b101, 0b110, 0b100))
    named = F.col("merchant").isNotNull()

    def part(where: Column, statistic: str, item: Column, over: Column, under: Column = F.lit(None)) -> Column:
        return F.when(where, F.struct(F.lit(statistic).alias("statistic"), item.cast("string").alias("item"), over.cast("double").alias("over"), under.cast("double").alias("under")))

    none, one, zero = F.lit(""), F.lit(1), F.lit(0)
    parts = [
        part(category & F.col("category").isNotNull(), "category_distribution", F.col("category"), F.col("n")),
        part(category, "category_spending", F.col("category"), F.col("total")),
        part(user & F.col("user_id").isNotNull(), "unique_users", none, one),
        part(user & (F.col("named") > 0), "avg_merchants_per_user", none, zero, one),
        part(merchant & named, "unique_merchants", none, one),
        part(pair & named, "avg_merchants_per_user", none, one, zero),
    ]
    always = [part(F.lit(True), name, none, zero, under) for name, under in [("unique_users", F.lit(None)), ("unique_merchants", F.lit(None)), ("avg_merchants_per_user", zero)]]
    rows = sets.select(F.explode(F.array_compact(F.array(*parts))).alias("p")).unionByName(df.sparkSession.range(1).select(F.explode(F.array(*always)).alias("p")))
    sums = rows.groupBy("p.statistic", "p.item").agg(F.sum("p.over").alias("over"), F.sum("p.under").alias("under"))
    return sums.select("statistic", "item", F.when(F.col("under").isNull(), F.col("over")).otherwise(F.try_divide("over", "under")).alias("value"))


def transaction_statistics(df: DataFrame, date: str = "txn_date") -> DataFrame:
    """Totals, quartiles, distinct counts and category shares as tidy rows; an empty table has counts of 0 and null averages."""
    a = F.col("amount")
    wide = df.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum(a).alias("amount_total"), F.avg(a).alias("amount_mean"), F.min(a).alias("amount_min"), F.max(a).alias("amount_max"),
        F.stddev_samp(a).alias("amount_std"), F.datediff(F.max(date), F.min(date)).alias("days_covered"),
        F.sum("suspicious").alias("suspicious_count"), (F.avg("suspicious") * 100).alias("suspicious_pct"),
    )
    return (
        _tidy(wide)
        .unionByName(_quartiles(df, "amount", {"amount_q25": 0.25, "amount_median": 0.5, "amount_q75": 0.75}))
        .unionByName(_counted(df))
    )


def user_statistics(df: DataFrame) -> DataFrame:
    b, k = F.col("monthly_budget"), F.col("num_cards")
    wide = df.agg(
        F.count(F.lit(1)).alias("total_users"), F.avg(b).alias("budget_mean"), F.min(b).alias("budget_min"), F.max(b).alias("budget_max"),
        F.stddev_samp(b).alias("budget_std"), (F.sum(b) * 12).alias("total_annual_budget"),
        F.avg(k).alias("cards_mean"), F.min(k).alias("cards_min"), F.max(k).alias("cards_max"),
    )
    out = _tidy(wide).unionByName(_quartiles(df, "monthly_budget", {"budget_median": 0.5})).unionByName(
        _quartiles(df, "num_cards", {"cards_median": 0.5})
    )
    for col, name in [
        ("archetype", "archetype_distribution"), ("age_group", "age_distribution"),
        ("location_type", "location_distribution"), ("redemption_preference", "redemption_distribution"),
    ]:
        out = out.unionByName(distribution(df, col, name))
    return out


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: count, missing, mean, std, min, quartiles, max."""
    cols = list(columns or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "value")
    base = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.sum(F.col("value").isNull().cast("long")).alias("missing"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = ordered.quantiles(long, ["column"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n_values")
    return base.join(q, "column", "left")


def describe_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column: count, missing, distinct, most frequent value and its count."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    return counts.groupBy("column").agg(
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.count(F.when(known, 1)).alias("distinct"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v")))).alias("t"),
    ).select("column", "count", "missing", "distinct", F.col("t.v").alias("top"), (-F.col("t.n")).alias("freq"))


def shape(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows, columns and fully repeated rows."""
    cols = list(keys or df.columns)
    per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("rows"), F.lit(len(df.columns)).alias("columns"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates")
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between minimum and maximum; the last bin is closed."""
    v = F.col(column).cast("double")
    edges = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).select(F.struct("lo", "hi").alias("e")).scalar()
    d = df.where(v.isNotNull()).select(v.alias("v")).withColumn("e", edges)
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("e.lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    return d.groupBy(b.cast("int").alias("bin"), F.col("e.lo").alias("lo"), width.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_start"), "n"
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """Most frequent values; equal counts in value order."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), column)
        .limit(k)
    )


def by_category(df: DataFrame, category: Column, amount: Column) -> DataFrame:
    return df.groupBy(category.alias("category")).agg(
        F.sum(amount).alias("total"), F.avg(amount).alias("mean"), F.count(amount).alias("n")
    )


def daily_trend(df: DataFrame, day: str, amount: str) -> DataFrame:
    return df.groupBy(F.col(day).cast("date").alias("day")).agg(F.sum(amount).alias("spend"), F.count(F.lit(1)).alias("n"))
