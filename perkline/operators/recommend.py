"""The best cards of a catalogue of any size, for users and for single purchases.

A reward is linear in what is spent per category, so a card that enough others beat in
every category, and in the fee, is in nobody's first ``k``.  The cards that are left, the
k-skyband of the catalogue, are found by rounds of local skybands: each task drops what
its own rows beat ``k`` times, and fewer, larger tasks go on with the rest.  Dropping is
always safe, so a catalogue that doesn't shrink is only slower, never wrong.

Scores are a product of two small matrices per Arrow batch, amounts by category times
rates by card, in blocks of ``BLOCK_CARDS`` cards; what leaves a task are ``k`` rows per
user and block.  There is no table of users times cards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline import dims
from perkline.functions import wording
from perkline.operators import scoring
from perkline.sources import sinks

TOP = 10
#: Categories with a rate of their own; ``""`` is any other one, where a card earns its base rate.
CATEGORIES = [*dims.SPENDING_CATEGORIES, *[c for c in dims.BONUS_CATEGORIES if c not in dims.SPENDING_CATEGORIES], ""]
#: Rows that one task takes in the last round, and cards that are sent out at once.
FINAL_ROWS, BLOCK_CARDS = 20_000, 8192
#: Users that are scored at once.
USERS = 512
#: A higher fee only counts as an advantage (where personas discount fees) from this much on.
FEE_STEP = 1.0
DEFAULT_AMOUNT = 100.0
DEFAULT_POINT_VALUE = 0.01
_CARD = "card_id string, card_name string, annual_fee double, base double, rates array<double>, strength array<double>"


def rate_table(cards: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """card_id, card_name, annual_fee, base, rates (one per category), strength (what more is better in).

    ``cards`` has card_id, annual_fee, base_rate, bonuses (category to rate) and may have
    card_name.  Strength is the rates here; a scorer that looks at more adds it.
    """
    base = F.coalesce(F.col("base_rate"), F.lit(scoring.DEFAULT_RATE)).cast("double")
    name = F.col("card_name") if "card_name" in cards.columns else F.col("card_id")
    d = cards.select("card_id", name.alias("card_name"), F.coalesce("annual_fee", F.lit(0.0)).cast("double").alias("annual_fee"), base.alias("base"), "bonuses")
    rates = F.array(*[F.coalesce(F.try_element_at("bonuses", F.lit(c)), F.col("base")) for c in categories])
    d = d.withColumn("rates", rates)
    return d.select("card_id", "card_name", "annual_fee", "base", "rates", F.col("rates").alias("strength"))


def with_uplifts(table: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """``rate_table`` with all that the blended score grows with as strength: rates, bonuses above base, travel, no fee."""
    up = F.transform("rates", lambda r: F.greatest(r - F.col("base"), F.lit(0.0)))
    travel = (F.get("rates", F.lit(list(categories).index("travel"))) > F.col("base")).cast("double")
    return table.withColumn("strength", F.concat("rates", up, F.array(travel, (F.col("annual_fee") <= 0).cast("double"))))


# ------------------------------------------------------------------------ the skyband


Points = tuple[np.ndarray, np.ndarray, np.ndarray]


def _beaten(by: Points, rows: Points, high: bool) -> np.ndarray:
    """rows x by: whether one of ``by`` (strength, fee, place among the ids) beats a row for everyone."""
    (a, fee_a, name_a), (b, fee_b, name_b) = by, rows
    fee_a, fee_b = fee_a[None, :], fee_b[:, None]
    out = (fee_a >= fee_b + FEE_STEP if high else fee_a < fee_b) | (fee_a == fee_b) & (name_a[None, :] < name_b[:, None])
    for column in range(a.shape[1]):
        out &= a[:, column][None, :] >= b[:, column][:, None]
    return out


def band(strength: np.ndarray, fee: np.ndarray, ids: Sequence[str], k: int, high: bool = False) -> np.ndarray:
    """Places of the rows that fewer than ``k`` others beat: as strong in everything, and first by fee, then id.

    With ``high`` a fee higher by ``FEE_STEP`` comes first.  Rows are taken strongest first,
    so what beats a row is before it, and a row beaten ``k`` times need not be compared with
    later ones: whatever it beats, those ``k`` beat too.
    """
    names = np.argsort(np.argsort(np.array(ids, object), kind="stable"), kind="stable")
    order = np.lexsort((names, -fee if high else fee, -strength.sum(axis=1)))
    kept = np.zeros(0, np.int64)
    for start in range(0, len(order), 256):
        block = order[start : start + 256]
        at = [(strength[x], fee[x], names[x]) for x in (kept, block)]
        times = _beaten(at[0], at[1], high).sum(axis=1) + _beaten(at[1], at[1], high).sum(axis=1)
        kept = np.concatenate([kept, block[times < k]])
    return np.sort(kept)


def skyband(table: DataFrame, k: int, high: bool = False, refunds: bool = False) -> DataFrame:
    """Cards of ``table`` (as ``rate_table``) that can be in a first ``k``, and maybe some more.

    ``high`` is for users whose personas discount fees, ``refunds`` for negative amounts.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            strength = both["strength"].combine_chunks().flatten().to_numpy().reshape(both.num_rows, -1)
            some = band(-strength if refunds else strength, both["annual_fee"].to_numpy(), both["card_id"].to_pylist(), k, high)
            held = both.take(pa.array(some)).combine_chunks().to_batches()[0]
        if held is not None:
            yield held

    columns = [c.split()[0] for c in _CARD.split(", ")]
    known = table.where("card_id IS NOT NULL").select(*columns)
    before = None
    while True:
        known = _stored(known.mapInArrow(local, _CARD), "skyband")
        rows = known.count()
        if rows <= FINAL_ROWS:
            return known.coalesce(1).mapInArrow(local, _CARD)
        if before is not None and rows > 0.8 * before:
            return known
        known, before = known.repartition(-(-rows // FINAL_ROWS)), rows


def _stored(df: DataFrame, name: str) -> DataFrame:
    folder = sinks.work_folder(df.sparkSession, name)
    df.write.mode("overwrite").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def offers(cards: DataFrame, k: int, refunds: bool = False, personas: bool = True) -> DataFrame:
    """The cards of ``cards`` (as ``rate_table``) that any user's or purchase's first ``k`` are among; stored."""
    ways = [(False, False), *([(True, False)] if personas else []), *([(False, True), *([(True, True)] if personas else [])] if refunds else [])]
    every = reduce(DataFrame.unionByName, [skyband(cards, k, high, back) for high, back in ways])
    return _stored(every.dropDuplicates(["card_id"]), "offers")


# ------------------------------------------------------------------------- the scorers


@dataclass
class Offers:
    """Cards as arrays, by fee and then id, which is the order of equal scores."""

    ids: np.ndarray
    fee: np.ndarray
    base: np.ndarray
    rates: np.ndarray
    strength: np.ndarray


Scorer = Callable[[dict[str, np.ndarray], Offers], tuple[np.ndarray, np.ndarray]]


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, whatever the last bits of a sum say."""
    return np.floor(x * 10.0**digits + (0.5 + 1e-6)) / 10.0**digits


def _rounded_column(x: Column, digits: int) -> Column:
    return F.floor(x * 10.0**digits + (0.5 + 1e-6)) / 10.0**digits


def persona_score(user: dict[str, np.ndarray], cards: Offers) -> tuple[np.ndarray, np.ndarray]:
    """Reward over all categories, and that after the personas' boost and fee penalty."""
    raw = user["amounts"] @ (cards.rates.T / 100)
    penalty = (user["fee_multiplier"] - 1.0)[:, None] * cards.fee[None, :] / 12.0
    adjusted = np.where(user["active"][:, None], _rounded(raw * user["boost"][:, None] - penalty, 4), _rounded(raw, 8))
    return raw, adjusted


def blended_score(user: dict[str, np.ndarray], cards: Offers, weight: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Reward of all purchases, and that blended with what the point value and the user's affinity make of it."""
    n = cards.rates.shape[1]
    raw = user["amounts"] @ (cards.rates.T / 100)
    up, travel, free = cards.strength[:, n : 2 * n], cards.strength[:, 2 * n], cards.strength[:, 2 * n + 1]
    total = user["spend"].sum(axis=1)
    share = user["spend"] / np.where(total > 0, total, 1.0)[:, None]
    affinity = 1.0 + (share @ up.T) * 0.75 + 0.15 * user["likes_travel"][:, None] * travel[None, :] + 0.1 * user["likes_cashback"][:, None] * free[None, :]
    affinity = np.where(total[:, None] > 0, np.maximum(affinity, 0.1), 1.0)
    blended = weight * raw + (1.0 - weight) * raw * user["factor"][:, None] * affinity
    return raw, _rounded(np.where(user["personal"][:, None], blended, raw), 7)


def best(users: DataFrame, cards: DataFrame, score: Scorer, key: Sequence[str], k: int = TOP, block_cards: int = BLOCK_CARDS) -> DataFrame:
    """``key`` columns, card_id, rank, raw_reward, score: the first ``k`` cards of every row of ``users``.

    ``users`` has the key, ``amounts`` (one per category), ``without`` (card ids not to
    offer, may be null) and the numeric columns that ``score`` reads; ``cards`` is a stored
    table as :func:`offers` gives it.
    """
    rows = cards.count()
    blocks = max(1, -(-rows // block_cards))
    parts = []
    for b in range(blocks):
        own = cards if blocks == 1 else cards.where(F.pmod(F.xxhash64("card_id"), F.lit(blocks)) == b)
        parts.append(_best_of_block(users, own, score, key, k))
    found = reduce(DataFrame.unionByName, parts)
    if blocks == 1:
        return found.drop("annual_fee")
    order = W.partitionBy(*key).orderBy(F.desc("score"), F.desc(_rounded_column(F.col("raw_reward"), 8)), "annual_fee", "card_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("annual_fee")


def _best_of_block(users: DataFrame, cards: DataFrame, score: Scorer, key: Sequence[str], k: int) -> DataFrame:
    local = cards.toArrow().sort_by([("annual_fee", "ascending"), ("card_id", "ascending")])  # at most about BLOCK_CARDS rows
    lists = {c: np.array(local[c].to_pylist(), float).reshape(local.num_rows, -1 if local.num_rows else 0) for c in ("rates", "strength")}
    ids = local["card_id"].combine_chunks()
    own = Offers(np.array(ids.to_pylist(), object), local["annual_fee"].to_numpy(), local["base"].to_numpy(), **lists)
    sent = users.sparkSession.sparkContext.broadcast((own, {c: i for i, c in enumerate(own.ids)}))
    numbers = [c for c in users.columns if c not in key and c != "without"]
    columns = [*key, *numbers, "without"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cards, place = sent.value
        names = pa.array(cards.ids, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, USERS):
                batch = whole.slice(start, USERS)
                if not batch.num_rows or not len(cards.ids):
                    continue
                user = {c: _numpy(batch.column(columns.index(c))) for c in numbers}
                raw, value = score(user, cards)
                shown, counts = _shown(value, batch.column(len(columns) - 1), place)
                # Equal scores go by reward, then by the cards' own order.
                order = np.lexsort((-_rounded(raw, 8), -shown))[:, :k]
                counts = np.minimum(k, counts)
                wanted = np.arange(order.shape[1])[None, :] < counts[:, None]
                row, rank = np.nonzero(wanted)
                card = order[row, rank]
                taken = [batch.column(i).take(pa.array(row)) for i in range(len(key))]
                yield pa.RecordBatch.from_arrays(
                    [*taken, names.take(pa.array(card)), pa.array((rank + 1).astype(np.int32)), pa.array(raw[row, card]), pa.array(value[row, card]), pa.array(cards.fee[card])],
                    names=[*key, "card_id", "rank", "raw_reward", "score", "annual_fee"],
                )

    kinds = [T.StructField(c, users.schema[c].dataType) for c in key]
    more = [("card_id", T.StringType()), ("rank", T.IntegerType()), ("raw_reward", T.DoubleType()), ("score", T.DoubleType()), ("annual_fee", T.DoubleType())]
    return users.select(*columns).mapInArrow(run, T.StructType([*kinds, *[T.StructField(n, x) for n, x in more]]))


def _shown(value: np.ndarray, without: pa.Array, place: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Scores without those of the cards that a row is not offered, and how many each row has left.

    Only the cards that are named cost a step of Python; most rows name none.
    """
    counts = np.full(len(value), value.shape[1])
    names = without.flatten()
    if not len(names):
        return value, counts
    rows = np.repeat(np.arange(len(without)), pc.fill_null(pc.list_value_length(without), 0).to_numpy())
    cards = np.array([place.get(c, -1) for c in names.to_pylist()])
    hidden = np.zeros(value.shape, bool)
    hidden[rows[cards >= 0], cards[cards >= 0]] = True
    return np.where(hidden, -np.inf, value), counts - hidden.sum(axis=1)


def _numpy(column: pa.Array) -> np.ndarray:
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


# ---------------------------------------------------------------------- what is offered


def by_category(rows: DataFrame, key: str, categories: Sequence[str] = CATEGORIES, out: str = "amounts") -> DataFrame:
    """``key`` and an array with the amount of each category."""
    names = list(categories)
    known = F.when(F.col("category").isin(names), F.col("category")).otherwise(F.lit(""))
    sums = [F.sum(F.when(known == c, F.col("amount")).otherwise(F.lit(0.0))) for c in names]
    return rows.groupBy(key).agg(F.array(*sums).alias(out))


def _requests(users: DataFrame, spend: DataFrame, user_cards: DataFrame, user_personas: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row per user: amounts, what the first category and the personas make of them, saved cards, yearly factor."""
    saved = user_cards.groupBy("user_id").agg(F.collect_set("card_id").alias("saved"))
    d = users.select("user_id", F.when(F.col("monthly_spend") > 0, F.col("monthly_spend")).alias("monthly"))
    d = d.join(by_category(spend, "user_id", categories), "user_id", "left").join(saved, "user_id", "left").join(scoring.valid_personas(user_personas), "user_id", "left")
    amount = F.coalesce("monthly", F.lit(DEFAULT_AMOUNT))
    nothing = F.array(*[amount if c == "other" else F.lit(0.0) for c in categories])
    d = d.withColumn("amounts", F.coalesce("amounts", nothing))
    top = F.array_max(F.col("amounts"))
    names = F.array(*[F.lit(c) for c in categories])
    first = F.array_min(F.filter(F.zip_with("amounts", names, lambda a, c: F.when(a == top, c)), lambda c: c.isNotNull()))
    d = d.withColumns({"category": first, "main_amount": top})
    boost, fee = scoring.persona_factors(F.col("personas"), F.col("category"))
    factor = F.when(F.col("main_amount") != 0, F.coalesce("monthly", "main_amount") / F.col("main_amount") * 12.0).otherwise(F.lit(12.0))
    return d.withColumns({"boost": boost, "fee_multiplier": fee, "active": F.col("personas").isNotNull(), "yearly": factor, "is_generic": F.coalesce(F.size("saved"), F.lit(0)) <= 0})


_NUMBERS = ["amounts", "boost", "fee_multiplier", "active"]


def portfolio(
    users: DataFrame, spend: DataFrame, user_cards: DataFrame, user_personas: DataFrame, cards: DataFrame,
    full_catalogue: bool = False, k: int = TOP, categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """user_id, card_id, rank, is_generic, raw_reward, score, projected_savings.

    Users with saved cards get those ranked, all of them; with ``full_catalogue`` they get
    the first ``k`` cards that they haven't saved.  Users without saved cards get the first
    ``k`` of the catalogue.  Personas change the reward and the order.  Savings are the
    reward of a year at the user's monthly spend.  A user without spend is taken to spend
    the monthly amount, or 100, on ``other``.
    """
    table = rate_table(cards, categories)
    asked = _stored(_requests(users, spend, user_cards, user_personas, categories), "requests")
    longest = asked.agg(F.coalesce(F.max(F.size("saved")), F.lit(0))).first()[0] if full_catalogue else 0
    open_ = asked if full_catalogue else asked.where("is_generic")
    near = offers(table, k + max(0, longest))
    without = F.col("saved").alias("without")
    found = best(open_.select("user_id", *_NUMBERS, without), near, persona_score, ["user_id"], k)
    if not full_catalogue:
        found = found.unionByName(_wallets(asked.where("NOT is_generic"), table))
    out = found.join(asked.select("user_id", "is_generic", "yearly"), "user_id")
    return out.select("user_id", "card_id", "rank", "is_generic", "raw_reward", "score", _rounded_column(F.col("raw_reward") * F.col("yearly"), 2).alias("projected_savings"))


def _wallets(asked: DataFrame, table: DataFrame) -> DataFrame:
    """All saved cards of each user in order; a wallet is never longer than the catalogue."""
    d = asked.select("user_id", *_NUMBERS, F.explode("saved").alias("card_id")).join(table.select("card_id", "annual_fee", "rates"), "card_id")
    raw = F.aggregate(F.zip_with("amounts", "rates", lambda a, r: a * (r / 100)), F.lit(0.0), lambda s, x: s + x)
    d = d.withColumn("raw_reward", raw)
    penalty = (F.col("fee_multiplier") - 1.0) * F.col("annual_fee") / 12.0
    score = F.when(F.col("active"), _rounded_column(F.col("raw_reward") * F.col("boost") - penalty, 4)).otherwise(_rounded_column(F.col("raw_reward"), 8))
    d = d.withColumn("score", score)
    order = W.partitionBy("user_id").orderBy(F.desc("score"), F.desc(_rounded_column(F.col("raw_reward"), 8)), "annual_fee", "card_id")
    return d.select("user_id", "card_id", F.row_number().over(order).alias("rank"), "raw_reward", "score")


def for_purchases(
    purchases: DataFrame, user_personas: DataFrame, cards: DataFrame, key: Sequence[str], k: int = TOP,
    words=dims.MERCHANT_WORDS, categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """``key``, card_id, rank, category_used, raw_reward, score, projected_savings for single purchases.

    ``purchases`` has the key, user_id, amount, category and merchant.  The category given
    counts before the merchant's words.  Refunds rank the cards that lose least first; a
    null amount is zero.
    """
    used = scoring.resolve_category(F.col("merchant"), F.col("category"), words)
    d = purchases.select(*key, "user_id", F.coalesce(F.col("amount").cast("double"), F.lit(0.0)).alias("amount"), used.alias("category_used"))
    d = d.join(scoring.valid_personas(user_personas), "user_id", "left")
    boost, fee = scoring.persona_factors(F.col("personas"), F.col("category_used"))
    known = F.when(F.col("category_used").isin(list(categories)), F.col("category_used")).otherwise(F.lit(""))
    amounts = F.array(*[F.when(known == c, F.col("amount")).otherwise(F.lit(0.0)) for c in categories])
    d = d.withColumns({"amounts": amounts, "boost": boost, "fee_multiplier": fee, "active": F.col("personas").isNotNull()})
    near = offers(rate_table(cards, categories), k, refunds=True)
    asked = d.select(*key, "category_used", *_NUMBERS, F.lit(None).cast("array<string>").alias("without"))
    found = best(asked, near, persona_score, [*key, "category_used"], k)
    return found.withColumn("projected_savings", _rounded_column(F.col("raw_reward") * 12.0, 2))


def profile_scores(
    profiles: DataFrame, spend: DataFrame, purchases: DataFrame, predictions: DataFrame, cards: DataFrame,
    k: int = TOP, default_point_value: float = DEFAULT_POINT_VALUE, categories: Sequence[str] = CATEGORIES,
) -> DataFrame:
    """user_id, card_id, rank, deterministic_score, blended_score, is_personalized, explanation.

    ``predictions`` has user_id and point_value as a model predicted it; a missing, NaN or
    non-positive one leaves a user's scores deterministic.  ``profiles`` has user_id,
    likes_travel and likes_cashback.
    """
    value = F.col("point_value")
    good = F.coalesce((value > 0) & ~F.isnan(value), F.lit(False))
    d = profiles.select("user_id", F.coalesce("likes_travel", F.lit(False)).alias("likes_travel"), F.coalesce("likes_cashback", F.lit(False)).alias("likes_cashback"))
    d = d.join(by_category(purchases, "user_id", categories), "user_id").join(by_category(spend, "user_id", categories, "spend"), "user_id", "left")
    d = d.join(predictions.select("user_id", "point_value"), "user_id", "left")
    d = d.withColumns({"personal": good, "factor": F.when(good, value / default_point_value).otherwise(F.lit(1.0)), "spend": F.coalesce("spend", F.array(*[F.lit(0.0)] * len(categories)))})
    numbers = ["amounts", "spend", "likes_travel", "likes_cashback", "factor", "personal"]
    asked = _stored(d.select("user_id", *numbers, F.lit(None).cast("array<string>").alias("without")), "profiles")
    table = with_uplifts(rate_table(cards, categories), categories)
    found = best(asked, offers(table, k, personas=False), blended_score, ["user_id"], k)
    largest = _first_bonus(asked, found.select("user_id", "card_id"), cards, categories)
    out = found.join(asked.select("user_id", "personal"), "user_id").join(largest, ["user_id", "card_id"], "left")
    text = wording.template_explanation(F.col("bonus_category"), F.col("bonus_rate"), F.coalesce("base_rate", F.lit(scoring.DEFAULT_RATE)))
    return out.select("user_id", "card_id", "rank", F.col("raw_reward").alias("deterministic_score"), F.col("score").alias("blended_score"), F.col("personal").alias("is_personalized"), text.alias("explanation"))


def _first_bonus(asked: DataFrame, pairs: DataFrame, cards: DataFrame, categories: Sequence[str]) -> DataFrame:
    """user_id, card_id, base_rate and the bonus of the card in the largest of the user's categories that has one."""
    names = F.array(*[F.lit(c) for c in categories])
    ranked = F.array_sort(F.filter(F.zip_with("spend", names, lambda a, c: F.struct((-a).alias("neg"), c.alias("category"))), lambda x: x["neg"] < 0))
    d = pairs.join(asked.select("user_id", F.transform(ranked, lambda x: x["category"]).alias("by_spend")), "user_id").join(cards.select("card_id", "base_rate", "bonuses"), "card_id")
    d = d.withColumn("bonus_category", F.get(F.filter("by_spend", lambda c: F.map_contains_key("bonuses", c)), F.lit(0)))
    return d.select("user_id", "card_id", "base_rate", "bonus_category", F.try_element_at("bonuses", F.col("bonus_category")).alias("bonus_rate"))
