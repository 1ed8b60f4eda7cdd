"""Card catalogue: merge of feeds, junk filters, overlay of curated cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkline import dims
from perkline.functions import text
from perkline.operators import ordered

FEED_PRIORITY = ["creditcardbonuses_api", "issuers", "nerdwallet"]


def is_listed_card(name: Column, has_rate: Column, prefixes: Sequence[str] = dims.MERGE_JUNK_PREFIXES) -> Column:
    """A named row that is no list heading and carries some reward rate."""
    key = text.merge_key(name)
    junk = F.lit(False)
    for p in prefixes:
        junk = junk | key.startswith(p)
    return (key != "") & ~junk & has_rate


def merge_feeds(feed: DataFrame, order: str = "ord", priority: Sequence[str] = FEED_PRIORITY) -> DataFrame:
    """One row per (name, issuer) over all feeds, the better source first.

    An aggregate keeps the winner, so copies of a popular card are dropped map-side.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(priority)], F.lit(len(priority)))
    d = feed.where(is_listed_card(F.col("name"), F.col("base_reward_rate").isNotNull()))
    d = d.withColumn("__name", text.merge_key(F.col("name"))).withColumn(
        "__issuer", text.merge_key(F.col("issuer"), F.col("source"))
    )
    return ordered.first_per_key(d, ["__name", "__issuer"], [rank, F.col(order)]).drop("__name", "__issuer")


def loadable_cards(merged: DataFrame, order: str = "ord") -> DataFrame:
    """Rows the catalogue accepts, one per card id with the highest base rate.

    A rate outside [0, 10] or unreadable drops the row; fees below zero become zero.
    """
    name = F.trim(F.col("name"))
    junk = F.lit(False)
    for p in dims.CATALOG_JUNK_PREFIXES:
        junk = junk | F.lower(name).startswith(p)
    d = merged.where((F.coalesce(name, F.lit("")) != "") & ~junk).select(
        text.slug(name).alias("card_id"),
        name.alias("card_name"),
        F.coalesce("issuer", F.lit("")).alias("issuer"),
        F.greatest(F.coalesce("annual_fee", F.lit(0.0)), F.lit(0.0)).alias("annual_fee"),
        text.parse_rate(F.col("base_reward_rate")).alias("base_rate"),
        F.col(order),
    )
    d = d.where(F.col("base_rate").isNotNull())
    return ordered.first_per_key(d, ["card_id"], [-F.col("base_rate"), F.col(order)])


GRAM = 3


def _grams(name: Column, size: Column | int) -> Column:
    """Distinct pieces of ``size`` characters; the whole name if it is shorter."""
    n = F.length(name)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(name, i, F.lit(size) if isinstance(size, int) else size)))


def without_shadowed(cards: DataFrame, curated: DataFrame, most: float = 0.85) -> DataFrame:
    """Drop cards that repeat a curated one.

    Same normalised issuer, and an equal name or one inside the curated name that is
    shorter than 85 % of it.  A name can only be inside another one that has all its
    trigrams, so each name looks at the curated names with the trigram that fewest curated
    names of the issuer have, and at no others.
    """
    left = cards.withColumns({"__i": text.dedup_key(F.col("issuer")), "__n": text.dedup_key(F.col("card_name"))})
    right = curated.select(text.dedup_key(F.col("issuer")).alias("__i"), text.dedup_key(F.col("card_name")).alias("__c")).where("__i <> '' AND __c <> ''").distinct()
    pieces = F.flatten(F.array(*[_grams(F.col("__c"), k) for k in range(1, GRAM + 1)]))
    posted = right.select("__i", "__c", F.explode(F.array_distinct(pieces)).alias("__g"))
    often = posted.groupBy("__i", "__g").agg(F.count(F.lit(1)).alias("__k"))
    names = left.where("__i <> '' AND __n <> ''").select("__i", "__n").distinct()
    asked = names.select("__i", "__n", F.explode(_grams(F.col("__n"), F.least(F.lit(GRAM), F.length("__n")))).alias("__g")).join(often, ["__i", "__g"], "left")
    rarest = asked.groupBy("__i", "__n").agg(F.min(F.struct(F.coalesce("__k", F.lit(0)).alias("k"), F.col("__g").alias("g"))).alias("__r"))
    met = rarest.where(F.col("__r.k") > 0).select("__i", "__n", F.col("__r.g").alias("__g")).join(posted, ["__i", "__g"])
    inside = F.col("__c").contains(F.col("__n")) & (F.length("__n") / F.length("__c") < most)
    shadowed = met.where((F.col("__n") == F.col("__c")) | inside).select("__i", "__n").distinct()
    return left.join(shadowed, ["__i", "__n"], "left_anti").select(*cards.columns)


def overlay(cards: DataFrame, curated: DataFrame) -> DataFrame:
    """Loaded cards without shadowed ones, then curated rows win by id."""
    kept = without_shadowed(cards, curated).join(curated.select("card_id"), "card_id", "left_anti")
    cols = [c for c in curated.columns if c in kept.columns]
    return kept.select(*cols).unionByName(curated.select(*cols))


def sanitize_rates(base_rate: Column, bonuses: Column) -> tuple[Column, Column]:
    """Base rate in (0, 10] and bonuses in (0, 20] of known categories."""
    from perkline.functions import nested

    return F.when((base_rate > 0) & (base_rate <= 10), base_rate), nested.known_rates(bonuses, dims.BONUS_CATEGORIES)
