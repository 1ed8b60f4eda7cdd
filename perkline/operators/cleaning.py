"""Cleaning of card, transaction and user tables, with counts per rule."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline import dims
from perkline.functions import text
from perkline.operators import ordered


@dataclass(frozen=True)
class CleaningRules:
    """Thresholds of the cleaning steps; fees are kept in [min, max)."""

    min_annual_fee: float = 0.0
    max_annual_fee: float = 1000.0
    min_amount: float = 0.0
    high_amount: float = 10000.0
    old_after_days: int = 3650
    valid_mcc: Sequence[int] = field(default_factory=lambda: list(dims.VALID_MCC))
    issuer_aliases: dict = field(default_factory=lambda: dict(dims.ISSUER_ALIASES))
    archetypes: Sequence[str] = field(default_factory=lambda: list(dims.ARCHETYPES))


DEFAULT_RULES = CleaningRules()


# ------------------------------------------------------------------------------ cards


def standardize_cards(df: DataFrame, rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    """Clean names and issuers beside the originals, parsed bonus, activity flag."""
    if "card_name" not in df.columns and "name" in df.columns:
        df = df.withColumnRenamed("name", "card_name")
    if "card_name" in df.columns:
        df = df.withColumn("card_name_original", F.col("card_name")).withColumn(
            "card_name", text.clean_card_name(F.col("card_name"))
        )
    if "issuer" in df.columns:
        df = df.withColumn("issuer_original", F.col("issuer")).withColumn(
            "issuer", text.standard_issuer(F.col("issuer"), rules.issuer_aliases)
        )
    if "welcome_bonus" in df.columns and df.schema["welcome_bonus"].dataType.typeName() == "string":
        b = text.parse_welcome_bonus(F.col("welcome_bonus"))
        df = df.withColumn("__b", b)
        for src, dst in [
            ("amount", "welcome_bonus_amount"),
            ("unit", "welcome_bonus_unit"),
            ("spend_requirement", "welcome_bonus_spend"),
            ("time_days", "welcome_bonus_days"),
        ]:
            df = df.withColumn(dst, F.col(f"__b.{src}"))
        df = df.drop("__b")
    if "discontinued" in df.columns:
        df = df.withColumn("is_active", (~F.coalesce(F.col("discontinued"), F.lit(False))).cast("int"))
    return df


def has_repeated_ids(df: DataFrame, key: str = "card_id") -> bool:
    """Whether any id, null included, occurs twice.  Runs one small aggregate."""
    return bool(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count())


def dedupe_cards(df: DataFrame, order: Column, by_id: bool | None = None) -> DataFrame:
    """Earliest row per card id where ids repeat, else per normalised name and issuer."""
    if by_id is None:
        by_id = (
            "card_id" in df.columns
            and bool(df.where(F.col("card_id").isNotNull()).limit(1).count())
            and has_repeated_ids(df)
        )
    if by_id:
        return ordered.first_per_key(df, ["card_id"], [order])
    d = df.withColumn("__name", text.dedup_key(F.col("card_name")))
    return ordered.first_per_key(d, ["__name", "issuer"], [order]).drop("__name")


def no_rates(rates: Column, type_name: str) -> Column:
    empty = rates.isNull()
    return empty | (F.size(rates) == 0) if type_name == "map" else empty


def impute_reward_rates(df: DataFrame, column: str = "reward_rates") -> DataFrame:
    """Missing or empty rates become a 1 % base rate."""
    kind = df.schema[column].dataType.typeName()
    fill = F.create_map(F.lit("universal_base_rate"), F.lit(1.0)) if kind == "map" else F.lit('{"universal_base_rate":1.0}')
    return df.withColumn(column, F.when(no_rates(F.col(column), kind), fill).otherwise(F.col(column)))


def valid_fee(fee: Column, rules: CleaningRules = DEFAULT_RULES) -> Column:
    return F.coalesce((fee >= rules.min_annual_fee) & (fee < rules.max_annual_fee), F.lit(False))


def clean_cards(df: DataFrame, order: Column, rules: CleaningRules = DEFAULT_RULES, by_id: bool | None = None) -> DataFrame:
    d = dedupe_cards(standardize_cards(df, rules), order, by_id)
    if "reward_rates" in d.columns:
        d = impute_reward_rates(d)
    if "annual_fee" in d.columns:
        d = d.withColumn("annual_fee", F.col("annual_fee").try_cast("double")).where(valid_fee(F.col("annual_fee"), rules))
    return d


# ----------------------------------------------------------------------- transactions


def clean_transactions(
    df: DataFrame,
    as_of: str,
    rules: CleaningRules = DEFAULT_RULES,
    date: str = "date_text",
    mark_duplicates: bool = True,
    order: Sequence[str] = ("transaction_id",),
) -> DataFrame:
    """Drop negative amounts and bad or future dates, impute categories, set flags.

    Zero and missing amounts stay.  ``as_of`` stands for today.
    """
    d = flag_transactions(df, as_of, rules, date).where(F.col("__keep")).drop("__keep")
    d = d.withColumn("date", F.col("__ts").cast("date")).drop("__ts")
    if not mark_duplicates:
        return d
    return ordered.mark_repeats(
        d, ["user_id", "date", "amount", "merchant"], [F.col(c) for c in order], "is_potential_duplicate"
    )


def flag_transactions(df: DataFrame, as_of: str, rules: CleaningRules, date: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    amount = F.col("amount").try_cast("double")
    ts = F.try_to_timestamp(F.col(date).cast("string"))
    d = df.withColumn("amount", amount).withColumn("__ts", ts)
    category = F.trim(F.lower(F.coalesce(F.when(F.col("category") != "", F.col("category")), F.lit("unknown"))))
    return d.withColumns(
        {
            "__keep": ~F.coalesce(F.col("amount") < rules.min_amount, F.lit(False))
            & F.coalesce(F.col("__ts") <= now, F.lit(False)),
            "is_old_transaction": F.coalesce(
                F.col("__ts") < now - F.make_dt_interval(F.lit(rules.old_after_days)), F.lit(False)
            ).cast("int"),
            "category": category,
            "mcc_valid": F.coalesce(F.col("mcc_code").isin(list(rules.valid_mcc)), F.lit(False)),
            "suspicious_high_amount": F.coalesce(F.col("amount") > rules.high_amount, F.lit(False)).cast("int"),
            "is_round_amount": F.coalesce(F.col("amount") % 100 == 0, F.lit(False)).cast("int"),
            "suspicious": F.coalesce(F.col("amount") > rules.high_amount, F.lit(False)).cast("int"),
        }
    )


def transaction_report(df: DataFrame, as_of: str, rules: CleaningRules = DEFAULT_RULES, date: str = "date_text") -> DataFrame:
    """Counts per cleaning rule in one pass over the raw table, one row per rule."""
    now = F.lit(as_of).cast("timestamp")
    amount = F.col("amount").try_cast("double")
    ts = F.try_to_timestamp(F.col(date).cast("string"))
    neg = F.coalesce(amount < rules.min_amount, F.lit(False))
    bad = ts.isNull()
    future = F.coalesce(ts > now, F.lit(False))
    kept = ~neg & ~bad & ~future
    rule_flags = {
        "initial_count": F.lit(True),
        "negative_amounts": neg,
        "invalid_dates": ~neg & bad,
        "future_dates": ~neg & future,
        "missing_categories": kept & F.coalesce(F.col("category") == "", F.lit(True)),
        "invalid_mcc_codes": kept & ~F.coalesce(F.col("mcc_code").isin(list(rules.valid_mcc)), F.lit(False)),
        "suspicious_high_amounts": kept & F.coalesce(amount > rules.high_amount, F.lit(False)),
        "final_count": kept,
    }
    return tidy_counts(df, "transactions", rule_flags)


def card_report(df: DataFrame, order: Column, rules: CleaningRules = DEFAULT_RULES, by_id: bool | None = None) -> DataFrame:
    """Counts per cleaning rule; missing rates and missing-or-empty rates stay apart."""
    std = standardize_cards(df, rules)
    kept = dedupe_cards(std, order, by_id)
    kind = kept.schema["reward_rates"].dataType.typeName()
    fee_ok = valid_fee(F.col("annual_fee").try_cast("double"), rules)
    before = std.agg(F.count(F.lit(1)).alias("initial_count"), F.count_distinct("issuer").alias("unique_issuers"))
    after = kept.agg(
        F.count(F.lit(1)).alias("after_dedup"),
        F.sum(F.col("reward_rates").isNull().cast("long")).alias("missing_reward_rates"),
        F.sum(no_rates(F.col("reward_rates"), kind).cast("long")).alias("empty_reward_rates"),
        F.sum((~fee_ok).cast("long")).alias("annual_fee_removed"),
        F.sum((fee_ok & F.coalesce(F.col("discontinued"), F.lit(False))).cast("long")).alias("discontinued"),
        F.sum(fee_ok.cast("long")).alias("final_count"),
    )
    long = [_unpivot(x, "cards") for x in (before, after)]
    return long[0].unionByName(long[1])


def user_report(df: DataFrame, order: Column, rules: CleaningRules = DEFAULT_RULES) -> DataFrame:
    kept = ordered.first_per_key(df, ["user_id"], [order])
    budget = F.col("monthly_budget").try_cast("double")
    a = _unpivot(df.agg(F.count(F.lit(1)).alias("initial_count")), "users")
    b = _unpivot(
        kept.agg(
            F.count(F.lit(1)).alias("final_count"),
            F.sum(budget.isNull().cast("long")).alias("missing_budgets"),
            F.sum((~F.coalesce(F.col("archetype").isin(list(rules.archetypes)), F.lit(False))).cast("long")).alias(
                "invalid_archetypes"
            ),
        ),
        "users",
    )
    return a.unionByName(b)


def tidy_counts(df: DataFrame, dataset: str, flags: dict[str, Column]) -> DataFrame:
    wide = df.agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(k) for k, c in flags.items()])
    return _unpivot(wide, dataset)


def _unpivot(wide: DataFrame, dataset: str) -> DataFrame:
    return wide.unpivot([], wide.columns, "rule", "n").select(F.lit(dataset).alias("dataset"), "rule", F.col("n").cast("long").alias("n"))


# ------------------------------------------------------------------------------ users


def clean_users(df: DataFrame, order: Column) -> DataFrame:
    """Earliest row per user; a missing budget takes the median of the kept rows."""
    d = ordered.first_per_key(df, ["user_id"], [order]).withColumn(
        "monthly_budget", F.col("monthly_budget").try_cast("double")
    )
    median = ordered.quantiles(d, [], "monthly_budget", {"median": 0.5}).select("median")
    return d.withColumn("monthly_budget", F.coalesce(F.col("monthly_budget"), median.scalar()))


# ---------------------------------------------------------------------- offer payloads


def normalize_offers(df: DataFrame) -> DataFrame:
    """Snake-case offer columns; rows without a name or issuer are dropped.

    ``offers`` and ``historicalOffers`` are arrays of
    struct<spend, amount: array<struct<amount>>, days>.
    """
    from perkline.functions import nested

    rate = F.col("universalCashbackPercent")
    best = nested.best_offer(F.col("offers"), F.col("historicalOffers"))
    d = df.where((F.coalesce(F.col("name"), F.lit("")) != "") & (F.coalesce(F.col("issuer"), F.lit("")) != "")).withColumn("__best", best)
    return d.select(
        F.lit("creditcardbonuses").alias("source"),
        F.col("cardId").alias("card_id"),
        F.col("name").alias("card_name"),
        "issuer",
        F.col("annualFee").cast("double").alias("annual_fee"),
        F.when(rate > 0, F.create_map(F.lit("universal_base_rate"), rate.cast("double")))
        .otherwise(F.create_map().cast("map<string,double>"))
        .alias("reward_rates"),
        text.bonus_text(F.col("__best.amount"), F.col("__best.spend"), F.col("__best.days")).alias("welcome_bonus"),
        F.coalesce("offers", F.array().cast(df.schema["offers"].dataType)).alias("offers"),
    )
