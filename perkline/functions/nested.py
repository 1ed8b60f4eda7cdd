"""Arrays, maps and JSON of varying shape."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFERS_SCHEMA = "array<struct<spend:double,amount:array<struct<amount:double>>,days:int>>"
CREDITS_SCHEMA = "array<struct<description:string,value:double,weight:double>>"

# Keys that may hold the base rate, in order of preference.
BASE_RATE_KEYS = [
    "universal_base_rate", "universal_cashback_percent", "base", "base_rate", "default", "flat", "all", "everything_else",
]
NESTED_RATE_KEYS = ["rates", "reward_rates", "categories"]
ITEM_RATE_KEYS = ["universal_base_rate", "base", "rate", "value"]
FLAT_RATE_COLUMNS = [
    "reward_rates.universal_base_rate", "reward_rates_universal_base_rate", "reward_rates.base",
    "reward_rates_base", "universal_cashback_percent", "base_rate", "reward_rate",
]


def first_offer(offers: Column) -> Column:
    """struct(spend, amount, days) of the first offer, defaults 0, 0 and 90.

    ``offers`` is JSON text; anything but a non-empty list gives the defaults.
    """
    parsed = F.try_element_at(F.from_json(offers, OFFERS_SCHEMA), F.lit(1))
    return F.struct(
        F.coalesce(parsed["spend"], F.lit(0.0)).alias("spend"),
        F.coalesce(F.try_element_at(parsed["amount"], F.lit(1))["amount"], F.lit(0.0)).alias("amount"),
        F.coalesce(parsed["days"], F.lit(90)).alias("days"),
    )


def best_offer(offers: Column, fallback: Column) -> Column:
    """Highest amount per dollar of spend, then highest amount, then fewest days.

    Equal offers keep the earlier one.  ``fallback`` is used when ``offers`` is empty.
    """
    source = F.when(F.size(offers) > 0, offers).when(F.size(fallback) > 0, fallback)
    scored = F.transform(
        source,
        lambda o, i: F.struct(
            F.when(
                F.coalesce(o["spend"], F.lit(0.0)) > 0,
                F.coalesce(F.try_element_at(o["amount"], F.lit(1))["amount"], F.lit(0.0)) / o["spend"],
            )
            .otherwise(F.lit(0.0))
            .alias("ratio"),
            F.coalesce(F.try_element_at(o["amount"], F.lit(1))["amount"], F.lit(0.0)).cast("double").alias("amount"),
            (-F.coalesce(o["days"], F.lit(0))).cast("double").alias("neg_days"),
            (-i).alias("neg_place"),
            F.coalesce(o["spend"], F.lit(0.0)).cast("double").alias("spend"),
        ),
    )
    top = F.array_max(scored)
    return F.when(
        top.isNotNull(),
        F.struct(top["amount"].alias("amount"), top["spend"].alias("spend"), (-top["neg_days"]).alias("days")),
    )


def credit_totals(credits: Column) -> Column:
    """struct(value, count) over a JSON list of credits; a missing value counts as zero."""
    items = F.filter(F.from_json(credits, CREDITS_SCHEMA), lambda c: c.isNotNull())
    value = F.aggregate(items, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["value"], F.lit(0.0)))
    return F.struct(
        F.coalesce(value, F.lit(0.0)).alias("value"), F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0)).alias("count")
    )


def card_list(cards: Column) -> Column:
    """A list written as text, with or without brackets and quotes, as an array."""
    parts = F.split(F.regexp_replace(cards, r"[\[\]'\"]", ""), ",")
    found = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(found, F.array().cast("array<string>"))


def _as_rate(v: Column, path: str) -> Column:
    return F.coalesce(
        F.try_variant_get(v, path, "double"), F.try_variant_get(v, path, "string").try_cast("double")
    )


def base_rate_from_json(raw: Column) -> Column:
    """Base reward rate out of JSON of any of the known shapes, else null.

    An object gives its first known scalar key; else its nested list, or the value
    itself when it is a list, gives the largest number found.
    """
    v = F.try_parse_json(F.when(F.trim(raw) != "", raw))
    scalar = F.coalesce(*[_as_rate(v, f"$.{k}") for k in BASE_RATE_KEYS])
    nested = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in NESTED_RATE_KEYS])
    items = F.coalesce(nested, F.try_variant_get(v, "$", "array<variant>"))
    numbers = F.transform(
        items,
        lambda x: F.greatest(*[_as_rate(x, f"$.{k}") for k in ITEM_RATE_KEYS], _as_rate(x, "$")),
    )
    return F.coalesce(scalar, F.array_max(numbers))


def base_reward_rate(columns: Sequence[str], raw: str = "reward_rates") -> Column:
    """Rate from the first flattened column present, else from the JSON column, else 0."""
    if "base_reward_rate" in columns:
        return F.col("base_reward_rate")
    for c in FLAT_RATE_COLUMNS:
        if c in columns:
            return F.coalesce(F.col(f"`{c}`").try_cast("double"), F.lit(0.0))
    if raw not in columns:
        return F.lit(0.0)
    return F.coalesce(base_rate_from_json(F.col(raw)), F.lit(0.0))


def lookup(key: Column, table: Mapping, default) -> Column:
    """Value of a fixed table, case-sensitive, with a default."""
    book = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(book, key), F.lit(default))


def dominant_key(m: Column) -> Column:
    """Key with the largest value; equal values keep the smaller key."""
    top = F.array_min(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return top["k"]


def known_rates(bonuses: Column, categories: Sequence[str], top: float = 20.0) -> Column:
    """Bonus rates in (0, top] of known categories."""
    return F.map_filter(bonuses, lambda k, v: k.isin(list(categories)) & (v > 0) & (v <= top))


def flags_from_array(values: Column, names: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}": F.coalesce(F.array_contains(values, n), F.lit(False)).cast("int") for n in names}


def columns_from_map(m: Column, names: Sequence[str], prefix: str) -> dict[str, Column]:
    return {f"{prefix}{n}": F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(0.0)) for n in names}


def lower_keys(m: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.lower(k))


def lower_items(a: Column) -> Column:
    return F.transform(F.filter(a, lambda x: x.isNotNull()), lambda x: F.lower(F.trim(x)))


def canonical_json(*cells: tuple[str, Column]) -> Column:
    """JSON text of named cells in name order, for comparing rows."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(cells, key=lambda x: x[0])]))
