"""Transaction ledger: entries, summaries, pages and export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.operators import ordered

# Flows a ledger entry may come from.
SOURCE_FLOWS = ["portfolio", "transaction", "quick_transaction", "manual"]
EXPORT_COLUMNS = [
    "id", "merchant", "amount", "category", "chosen_card_id", "chosen_card_name", "reward_earned",
    "estimated_savings", "source_flow", "card_was_saved", "timestamp",
]


def build_entries(requests: DataFrame, saved: DataFrame, opted_in: DataFrame | None = None) -> DataFrame:
    """Ledger rows: valid flows only, clean category, flag for a card in the wallet.

    With ``opted_in`` only users who allow logging get entries.
    """
    d = requests.where(F.col("source_flow").isin(SOURCE_FLOWS)).withColumn("category", F.trim(F.lower("category")))
    if opted_in is not None:
        d = d.join(opted_in.select("user_id"), "user_id", "left_semi")
    keys = saved.select("user_id", F.col("card_id").alias("chosen_card_id")).distinct().withColumn("__saved", F.lit(True))
    return d.join(keys, ["user_id", "chosen_card_id"], "left").withColumn("card_was_saved", F.coalesce("__saved", F.lit(False))).drop("__saved")


def _sums() -> list:
    return [
        F.round(F.sum("amount"), 2).alias("total_spend"),
        F.round(F.sum("reward_earned"), 2).alias("total_reward"),
        F.round(F.sum("estimated_savings"), 2).alias("total_savings"),
        F.count(F.lit(1)).alias("transaction_count"),
    ]


def by_category(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id", F.coalesce("category", F.lit("other")).alias("category")).agg(*_sums())


def by_card(ledger: DataFrame, *order: str) -> DataFrame:
    """Per card, with the card name of the last entry."""
    key = F.coalesce("chosen_card_id", F.lit("unknown"))
    d = ledger.withColumn("card_id", key).withColumn("__name", F.coalesce("chosen_card_name", key))
    return d.groupBy("user_id", "card_id").agg(F.max_by("__name", F.struct(*order)).alias("card_name"), *_sums())


def totals(ledger: DataFrame, card_fees: DataFrame) -> DataFrame:
    """Per user: totals, savings after the full fees of the cards used, effective rate.

    ``card_fees`` (card_id, annual_fee) joins on the few cards each user has used.
    """
    per_card = ledger.groupBy("user_id", F.col("chosen_card_id").alias("card_id")).agg(
        F.sum("amount").alias("a"), F.sum("reward_earned").alias("r"), F.sum("estimated_savings").alias("s"), F.count(F.lit(1)).alias("n")
    )
    d = per_card.join(card_fees, "card_id", "left")
    t = d.groupBy("user_id").agg(
        F.round(F.sum("a"), 2).alias("total_spend"), F.round(F.sum("r"), 2).alias("total_rewards"), F.round(F.sum("s"), 2).alias("total_savings"),
        F.coalesce(F.sum("annual_fee"), F.lit(0.0)).alias("__fees"), F.sum("n").alias("transaction_count"),
    )
    rate = F.when(F.col("total_rewards") > 0, F.when(F.col("total_spend") > 0, F.col("total_rewards") / F.col("total_spend") * 100).otherwise(F.lit(0.0)))
    return t.select(
        "user_id", "total_spend", "total_rewards", "total_savings", F.round(F.col("total_savings") - F.col("__fees"), 2).alias("fee_adjusted_savings"),
        "transaction_count", rate.alias("effective_rate"),
    )


def insights(ledger: DataFrame, card_fees: DataFrame, *order: str) -> DataFrame:
    """Top category, card with the most savings, count and rate as text per user."""
    cat = by_category(ledger).groupBy("user_id").agg(F.min(F.struct((-F.col("total_spend")).alias("v"), "category")).alias("c"))
    card = by_card(ledger, *order).groupBy("user_id").agg(F.min(F.struct((-F.col("total_savings")).alias("v"), "card_id", "card_name")).alias("k"))
    t = totals(ledger, card_fees)
    d = t.join(cat, "user_id").join(card, "user_id")
    return d.select(
        "user_id",
        F.concat(F.col("c.category"), F.lit(": $"), F.format_number(-F.col("c.v"), 2)).alias("top_category"),
        F.concat(F.col("k.card_name"), F.lit(": $"), F.format_number(-F.col("k.v"), 2)).alias("most_savings"),
        F.col("transaction_count").cast("string").alias("transactions"),
        F.when(F.col("effective_rate").isNotNull(), F.concat(F.format_number(F.col("effective_rate"), 2), F.lit("%"))).alias("rate"),
    )


def page(ledger: DataFrame, page_no: int = 1, size: int = 20, *ties: str, chunk_values: int = ordered.CHUNK_VALUES) -> DataFrame:
    """One page, newest first, with the total and whether another page follows.

    Times are cut into ranges of about equally many rows, whose counts tell which range the
    page starts in and ends in.  Only rows of those ranges are put in order, so a page costs
    the same however deep it is.  Rows without a time come last.
    """
    no = max(page_no, 1)
    n = min(size if size >= 1 else 20, 100)
    skip = (no - 1) * n
    total = ledger.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.round(F.sum("reward_earned"), 2).alias("r"), F.round(F.sum("estimated_savings"), 2).alias("s")).alias("t")
    ).scalar()
    cut = ordered.range_chunk(ledger, "ts", "__range", chunk_values).withColumn("__range", F.coalesce("__range", F.lit(-1)))
    counts = cut.groupBy("__range").agg(F.count(F.lit(1)).alias("k"))  # one row per range
    newest = F.sum("k").over(W.orderBy(F.desc("__range")))
    met = counts.withColumn("upto", newest).where((F.col("upto") > skip) & (F.col("upto") - F.col("k") < skip + n))
    where = met.agg(F.struct(F.min("__range").alias("low"), F.max("__range").alias("high"), F.min(F.col("upto") - F.col("k")).alias("before")).alias("w")).scalar()
    near = cut.withColumn("__w", where).where(F.col("__range").between(F.col("__w.low"), F.col("__w.high")))
    # The first rows of the first range that are still before the page; a range has at most a few hundred thousand.
    order = W.orderBy(F.desc("__range"), F.desc_nulls_last("ts"), *ties)
    rows = near.withColumn("__k", F.row_number().over(order) + F.col("__w.before")).where((F.col("__k") > skip) & (F.col("__k") <= skip + n))
    return rows.orderBy("__k").withColumn("__t", total).select(
        *ledger.columns, F.col("__t.n").alias("total"), (F.lit(skip + n) < F.col("__t.n")).alias("has_next"),
        F.col("__t.r").alias("total_rewards"), F.col("__t.s").alias("total_savings"),
    )


def page_after(ledger: DataFrame, last: Mapping[str, object], size: int, *ties: str) -> DataFrame:
    """The next ``size`` rows, newest first, after the row with the values ``last`` (ts and ties).

    The way to go deep: each task keeps ``size`` rows, however far back the page is.
    """
    later, level = F.lit(False), F.lit(True)
    for i, c in enumerate(["ts", *ties]):
        value = F.lit(last[c])
        later = later | (level & ((F.col(c) < value) if i == 0 else (F.col(c) > value)))
        level = level & (F.col(c) == value)
    return ledger.where(later).orderBy(F.col("ts").desc(), *ties).limit(min(max(size, 1), 100))


def export_rows(ledger: DataFrame, *ties: str) -> DataFrame:
    """The fixed export columns, newest first, missing cards as empty text."""
    d = ledger.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    for c in ("chosen_card_id", "chosen_card_name", "timestamp"):
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return d.orderBy(F.col("ts").desc(), *ties).select(*EXPORT_COLUMNS)
