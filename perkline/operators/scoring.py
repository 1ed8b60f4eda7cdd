"""Reward scoring: rates, fees, credits, caps, ranking, personas and savings.

Two shapes of the same arithmetic:

* a *portfolio* is a short list of cards the caller names.  It becomes a literal rate
  book inside the plan, so scoring is a map lookup per transaction with no join.
* a *card table* of any size becomes a small table of the best cards per category,
  quarter and foreign flag (:func:`best_by_category`), which purchases meet in an equi
  join; or it meets its spend rows through an equi join and the expressions below work
  on its columns.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline import dims
from perkline.functions import text
from perkline.operators import ordered

DEFAULT_RATE = 1.0


@dataclass(frozen=True)
class Card:
    """One card of a portfolio; rates are percentages."""

    card_id: str
    card_name: str = ""
    annual_fee: float = 0.0
    base_rate: float | None = None
    bonuses: Mapping[str, float] = field(default_factory=dict)
    rotating: Mapping[str, tuple[Sequence[str], float]] = field(default_factory=dict)
    caps: Mapping[str, float] = field(default_factory=dict)
    foreign_fee_pct: float = 0.0
    credits: Mapping[str, tuple[float, str]] = field(default_factory=dict)
    issuer: str = ""

    def rate(self, category: str, quarter: str | None, default: float = DEFAULT_RATE) -> float:
        base = default if self.base_rate is None else self.base_rate
        if quarter in self.rotating and category in self.rotating[quarter][0]:
            return self.rotating[quarter][1]
        return self.bonuses.get(category, base)


def curated_portfolio() -> list[Card]:
    return [
        Card(cid, name, fee, base, bonuses, issuer=issuer)
        for cid, name, issuer, fee, base, bonuses in dims.CURATED_CARDS
    ]


# ---------------------------------------------------------------- category lookup


def mcc_category(mcc: Column, overrides: Mapping[int, str] | None = None) -> Column:
    """Spending category of a merchant code: exact code, then range, then default."""
    exact = {**dims.MCC_EXACT, **(overrides or {})}
    points: dict[int, str] = {}
    for lo, hi, cat in dims.MCC_RANGES:
        for code in range(lo, hi + 1):
            points.setdefault(code, cat)
    points.update(exact)
    spans: list[tuple[int, int, str]] = []
    for code in sorted(points):
        if spans and spans[-1][2] == points[code] and spans[-1][1] == code - 1:
            spans[-1] = (spans[-1][0], code, points[code])
        else:
            spans.append((code, code, points[code]))
    out = F.lit(dims.MCC_DEFAULT)
    for lo, hi, cat in reversed(spans):
        out = F.when(mcc.between(lo, hi), F.lit(cat)).otherwise(out)
    return out


def _pattern(words: Mapping[str, int], order: int) -> str | None:
    """A pattern of the words (word to order) by their common beginnings, at each place the one that comes first in order.

    Words that go on after another one only count if they come before it in order; they are
    tried first.  ``order`` is that of the shorter word.
    """
    own = min(order, words.get("", order))
    after: dict[str, dict[str, int]] = {}
    for word, k in words.items():
        if word and k < own:
            after.setdefault(word[0], {})[word[1:]] = k
    parts = [(ch, _pattern(rest, own)) for ch, rest in after.items()]
    found = [(ch if ch.isalnum() else "\\" + ch) + rest for ch, rest in parts if rest is not None]
    if not found:
        return "" if "" in words and words[""] < order else None
    inner = found[0] if len(found) == 1 else f"(?:{'|'.join(found)})"
    return f"(?:{inner})?" if "" in words and words[""] < order else inner


def merchant_category(merchant: Column, words: Mapping[str, Sequence[str]] = dims.MERCHANT_WORDS) -> Column:
    """First category, in the order given, with a keyword inside the merchant name.

    All keywords are one pattern that branches by character, tried at each place of the
    name once, so the work per name does not grow with the number of keywords; where
    several start at one place, the pattern takes the one whose category comes first.
    """
    order = {c: i for i, c in enumerate(words)}
    ranked: dict[str, int] = {}
    for cat, kws in words.items():
        for kw in kws:
            ranked[kw.lower()] = min(ranked.get(kw.lower(), len(order)), order[cat])
    if "" in ranked:
        ranked = {w: k for w, k in ranked.items() if k < ranked[""] or not w}
    always = ranked.pop("", len(order))
    names = F.array(*[F.lit(c) for c in order], F.lit(None).cast("string"))
    least = F.lit(always)
    pattern = _pattern(ranked, len(order)) if ranked else None
    if pattern:
        place = F.create_map(*[x for w, k in ranked.items() for x in (F.lit(w), F.lit(k))])
        found = F.regexp_extract_all(F.lower(merchant), F.lit(f"(?=({pattern}))"), F.lit(1))
        least = F.least(least, F.array_min(F.transform(F.array_distinct(found), lambda w: F.try_element_at(place, w))))
    return F.when(merchant.isNotNull(), F.get(names, least))


def resolve_category(merchant: Column, hint: Column, words=dims.MERCHANT_WORDS, hint_first: bool = True) -> Column:
    given = F.lower(F.when(hint != "", hint))
    found = merchant_category(merchant, words)
    return F.coalesce(given, found, F.lit("other")) if hint_first else F.coalesce(found, given, F.lit("other"))


def quarter_label(day: Column) -> Column:
    return F.concat(F.lit("Q"), F.quarter(day).cast("string"))


# ------------------------------------------------------------- row-level arithmetic


def reward_amount(
    amount: Column,
    rate: Column,
    is_foreign: Column | None = None,
    foreign_fee_pct: Column | None = None,
    annual_fee: Column | None = None,
    amortize_months: int | None = None,
) -> Column:
    """Dollars earned on one purchase; a zero amount earns nothing and pays nothing."""
    out = amount * (rate / 100)
    if is_foreign is not None and foreign_fee_pct is not None:
        out = out - F.when(is_foreign, amount * (foreign_fee_pct / 100)).otherwise(F.lit(0.0))
    if annual_fee is not None and amortize_months:
        out = out - annual_fee / amortize_months / 30
    return F.when(amount == 0, F.lit(0.0)).otherwise(out)


def credit_per_purchase(amount: Column, credit: Column, frequency: Column) -> Column:
    """Statement credit spread over a year of purchases, capped at the purchase."""
    per = credit / F.when(frequency == "quarterly", 12).when(frequency == "annual", 48).otherwise(4)
    return F.least(per, amount)


def applicable_rate(
    category: Column,
    day: Column,
    base_rate: Column,
    bonuses: Column,
    rotating: Column | None = None,
    default: float = DEFAULT_RATE,
) -> Column:
    """Rotating bonus of the quarter, then category bonus, then base, then default.

    ``bonuses`` is map<category, rate>; ``rotating`` is
    map<quarter, struct<categories: array<string>, rate: double>>.
    """
    base = F.coalesce(base_rate, F.lit(default))
    fixed = F.coalesce(F.try_element_at(bonuses, category), base)
    if rotating is None:
        return fixed
    season = F.try_element_at(rotating, quarter_label(day))
    active = F.coalesce(F.array_contains(season["categories"], category), F.lit(False))
    return F.when(active, F.coalesce(season["rate"], base)).otherwise(fixed)


def welcome_bonus_eligible(has_bonus: Column, received: Column, tenure_days: Column, window_days: Column) -> Column:
    return (
        F.coalesce(has_bonus, F.lit(False))
        & ~F.coalesce(received, F.lit(False))
        & (F.coalesce(tenure_days, F.lit(0)) <= F.coalesce(window_days, F.lit(90)))
    )


def effective_rate(reward: Column, amount: Column) -> Column:
    return F.when(amount > 0, reward / amount * 100).otherwise(F.lit(0.0))


# ------------------------------------------------------------------ literal portfolio


def _categories(cards: Sequence[Card]) -> list[str]:
    return sorted(
        {k for c in cards for k in [*c.bonuses, *c.caps, *c.credits, *[x for v in c.rotating.values() for x in v[0]]]}
    )


def _book(cards: Sequence[Card], page, category: Column, day: Column | None) -> Column:
    """Literal map from category (and quarter, where bonuses rotate) to ``page(category, quarter)``."""
    quarters = sorted({q for c in cards for q in c.rotating}) if day is not None else []
    keyed = [(cat if q is None else f"{cat}|{q}", page(cat, q)) for cat in _categories(cards) for q in [None, *quarters]]
    fallback = page("", None)
    if not keyed:
        return fallback
    book = F.create_map(*[x for k, v in keyed for x in (F.lit(k), v)])
    found = F.try_element_at(book, category)
    if quarters:
        found = F.coalesce(F.try_element_at(book, F.concat_ws("|", category, quarter_label(day))), found)
    return F.coalesce(found, fallback)


def rate_book(cards: Sequence[Card], category: Column, day: Column | None = None) -> Column:
    """array<struct<card...>> for a purchase, each card with its rate there."""

    def entry(c: Card, cat: str, q: str | None) -> Column:
        credit, freq = c.credits.get(cat, (0.0, "monthly"))
        base = DEFAULT_RATE if c.base_rate is None else c.base_rate
        return F.struct(
            F.lit(c.card_id).alias("card_id"),
            F.lit(c.card_name).alias("card_name"),
            F.lit(float(c.annual_fee)).alias("annual_fee"),
            F.lit(float(c.rate(cat, q))).alias("rate"),
            F.lit(float(base)).alias("base_rate"),
            F.lit(float(c.foreign_fee_pct)).alias("foreign_fee_pct"),
            F.lit(float(c.caps[cat]) if cat in c.caps else None).cast("double").alias("cap"),
            F.lit(float(credit)).alias("credit"),
            F.lit(freq).alias("credit_frequency"),
        )

    return _book(cards, lambda cat, q: F.array(*[entry(c, cat, q) for c in cards]), category, day)


def ranked_by_rate(cards: Sequence[Card], amount: Column, category: Column, day: Column | None = None, top_k: int | None = None) -> Column:
    """Cards of a purchase in rank order, taken from orders fixed in the plan.

    For purchases whose reward is the amount times a rate and nothing else, so the order
    for a category depends on the amount only through its sign: rates descending,
    ascending for a refund, and fees alone for a zero or missing amount.  Equal rewards
    go by fee, then card id.
    """

    def order(cat: str, q: str | None, sign: int) -> Column:
        ranked = sorted(cards, key=lambda c: (-sign * c.rate(cat, q), c.annual_fee, c.card_id))[:top_k]
        return F.array(
            *[
                F.struct(
                    F.lit(c.card_id).alias("card_id"), F.lit(c.card_name).alias("card_name"),
                    F.lit(float(c.annual_fee)).alias("annual_fee"), F.lit(float(c.rate(cat, q))).alias("rate"),
                )
                for c in ranked
            ]
        )

    def page(cat: str, q: str | None) -> Column:
        return F.struct(order(cat, q, 1).alias("earn"), order(cat, q, -1).alias("refund"), order(cat, q, 0).alias("nothing"))

    orders = _book(cards, page, category, day)
    found = F.when(amount > 0, orders["earn"]).when(amount < 0, orders["refund"]).otherwise(orders["nothing"])
    return F.transform(found, lambda c: c.withField("reward", reward_amount(amount, c["rate"])))


def net_reward(card: Column, amount: Column, foreign: Column | None, amortize_months: int | None, with_credits: bool, spent: Column | None = None) -> Column:
    """What one card of a rate book earns on a purchase after fees, credits and caps.

    ``spent`` is the spend of the bucket before the purchase: a card whose cap is reached,
    or has less left than the amount, earns its base rate there.
    """
    rate = card["rate"]
    if spent is not None:
        remaining = F.greatest(card["cap"] - spent, F.lit(0.0))
        rate = F.when((remaining <= 0) | (remaining < amount), card["base_rate"]).otherwise(rate)
    out = reward_amount(amount, rate, foreign, card["foreign_fee_pct"], card["annual_fee"], amortize_months)
    if with_credits:
        credit = credit_per_purchase(amount, card["credit"], card["credit_frequency"])
        out = out + F.when(card["credit"] > 0, credit).otherwise(F.lit(0.0))
    return out


def ranked_by_reward(
    cards: Sequence[Card], amount: Column, category: Column, day: Column | None = None, top_k: int | None = None,
    foreign: Column | None = None, amortize_months: int | None = None, with_credits: bool = False, spent: Column | None = None,
) -> Column:
    """Cards of a purchase ordered by what they earn net, inside the row: reward, lower fee, card id."""
    entries = F.transform(
        rate_book(cards, category, day),
        lambda c: F.struct(
            (-F.coalesce(net_reward(c, amount, foreign, amortize_months, with_credits, spent), F.lit(0.0))).alias("less"),
            c["annual_fee"].alias("annual_fee"), c["card_id"].alias("card_id"), c["card_name"].alias("card_name"), c["rate"].alias("rate"),
            net_reward(c, amount, foreign, amortize_months, with_credits, spent).alias("reward"),
        ),
    )
    ranked = F.sort_array(entries)
    return F.slice(ranked, 1, top_k) if top_k else ranked


def _ranked(txns: DataFrame, cards: Sequence[Card], top_k, amount, category, day, foreign, amortize_months, with_credits, spent) -> Column:
    """The lookup where a reward is a rate times the amount, the order inside the row where more counts."""
    day_col = F.col(day) if day else None
    abroad = (F.col(foreign) == 1) if foreign and foreign in txns.columns and any(c.foreign_fee_pct for c in cards) else None
    capped = F.col(spent) if spent and any(c.caps for c in cards) else None
    credits = with_credits and any(c.credits for c in cards)
    if abroad is None and capped is None and not credits and not amortize_months:
        return ranked_by_rate(cards, F.col(amount), F.col(category), day_col, top_k)
    return ranked_by_reward(cards, F.col(amount), F.col(category), day_col, top_k, abroad, amortize_months, credits, capped)


def score_portfolio(
    txns: DataFrame,
    cards: Sequence[Card],
    amount: str = "amount",
    category: str = "category",
    day: str | None = "txn_date",
    foreign: str | None = "is_foreign",
    amortize_months: int | None = None,
    with_credits: bool = False,
) -> DataFrame:
    """Every card of the portfolio against every purchase, one row per pair."""
    day_col = F.col(day) if day else None
    d = txns.withColumn("__c", F.explode(rate_book(cards, F.col(category), day_col)))
    reward = reward_amount(
        F.col(amount),
        F.col("__c.rate"),
        (F.col(foreign) == 1) if foreign else None,
        F.col("__c.foreign_fee_pct"),
        F.col("__c.annual_fee"),
        amortize_months,
    )
    if with_credits:
        has = F.col("__c.credit") > 0
        reward = reward + F.when(
            has, credit_per_purchase(F.col(amount), F.col("__c.credit"), F.col("__c.credit_frequency"))
        ).otherwise(F.lit(0.0))
    return (
        d.withColumn("reward_amount", reward)
        .withColumn("reward_rate", effective_rate(F.col("reward_amount"), F.col(amount)))
        .select(
            *txns.columns,
            F.col("__c.card_id").alias("card_id"),
            F.col("__c.card_name").alias("card_name"),
            F.col("__c.annual_fee").alias("annual_fee"),
            "reward_amount",
            "reward_rate",
        )
    )


def rank_portfolio(
    txns: DataFrame,
    cards: Sequence[Card],
    top_k: int | None = None,
    amount: str = "amount",
    category: str = "category",
    day: str | None = "txn_date",
    foreign: str | None = "is_foreign",
    amortize_months: int | None = None,
    with_credits: bool = False,
    spent: str | None = None,
) -> DataFrame:
    """Ranked cards per purchase: net reward first, then lower fee, then card id.

    The net reward counts the foreign fee, the amortised annual fee, credits and, with
    ``spent``, caps.  Ranking needs neither a shuffle nor a sort across rows.
    """
    ranked = _ranked(txns, cards, top_k, amount, category, day, foreign, amortize_months, with_credits, spent)
    return txns.select("*", F.posexplode(ranked).alias("__p", "__c")).select(
        *txns.columns,
        (F.col("__p") + 1).alias("rank"),
        F.col("__c.card_id").alias("card_id"),
        F.col("__c.card_name").alias("card_name"),
        F.col("__c.annual_fee").alias("annual_fee"),
        F.col("__c.reward").alias("reward_amount"),
    )


def best_card(
    txns: DataFrame,
    cards: Sequence[Card],
    amount: str = "amount",
    category: str = "category",
    day: str | None = "txn_date",
    foreign: str | None = "is_foreign",
    amortize_months: int | None = None,
    with_credits: bool = False,
    spent: str | None = None,
) -> DataFrame:
    """The card of each purchase with the highest net reward."""
    top = F.get(_ranked(txns, cards, 1, amount, category, day, foreign, amortize_months, with_credits, spent), F.lit(0))
    return txns.withColumn("__b", top).withColumn("best_card_id", F.col("__b.card_id")).withColumn("best_reward", F.col("__b.reward")).drop("__b")


# ------------------------------------------------------------------------ card tables


def _first_of_pages(frames: Iterator[pd.DataFrame], top_k: int) -> Iterator[pd.DataFrame]:
    """The best ``top_k`` cards of this task for every page; rows in hand are those of one batch and the best so far."""
    held: dict[tuple[int, bool, int], pd.DataFrame] = {}
    for frame in frames:
        rates = np.stack(frame["rates"].to_numpy())
        fee, name, abroad_fee = (frame[c].to_numpy() for c in ("fee_order", "name_order", "fee"))
        for page in range(rates.shape[1]):
            for abroad in (False, True):
                net = rates[:, page] - abroad_fee if abroad else rates[:, page]
                for sign in (1, -1, 0):
                    value = np.nan_to_num(-sign * net, nan=np.inf, posinf=np.inf, neginf=-np.inf) + 0.0
                    last = held.get((page, abroad, sign))
                    at = np.arange(len(value))
                    if last is not None and len(last) >= top_k:
                        v, f, n = last[["value", "fee_order", "name_order"]].iloc[-1]
                        at = at[(value < v) | ((value == v) & (fee <= f))]
                        at = at[(value[at] < v) | (fee[at] < f) | (name[at] < n)]
                    if len(at) > top_k:
                        # Names are compared only where value and fee tie with the last place.
                        w = at[np.lexsort((fee[at], value[at]))[top_k - 1]]
                        at = at[(value[at] < value[w]) | ((value[at] == value[w]) & (fee[at] <= fee[w]))]
                    if len(at):
                        near = frame.iloc[at].drop(columns=["rates", "fee"]).assign(value=value[at], rate=rates[at, page], net_rate=net[at])
                        near = near if last is None else pd.concat([last, near])
                        held[page, abroad, sign] = near.sort_values(["value", "fee_order", "name_order"]).head(top_k)
    for (page, abroad, sign), best in held.items():
        yield best[["card_id", "annual_fee", "rate", "net_rate"]].assign(page=page, foreign=abroad, sign=sign)


def _bonus_categories(cards: DataFrame) -> Column:
    """The names of all bonus categories and ``""`` first, as one array."""
    return cards.select(F.explode(F.map_keys("bonuses")).alias("k")).agg(F.array_union(F.array(F.lit("")), F.sort_array(F.collect_set("k")))).scalar()


def best_by_category(cards: DataFrame, top_k: int = 10) -> DataFrame:
    """The best ``top_k`` cards per category, foreign flag and sign of an amount, by the net share of it.

    ``cards`` has card_id, annual_fee, base_rate, bonuses (map of category to rate) and
    foreign_fee_pct, and may have any number of rows.  The category ``""`` stands for all
    without a bonus anywhere; the names of categories are a short vocabulary.  A reward is
    the amount times the net rate, so a positive amount puts the highest net rate first, a
    refund the lowest, and none the lowest fee; that order holds for every purchase.  The
    result has 6 * (categories + 1) * top_k rows.  No card is sorted that is not among the
    first of its batch, so a task holds a batch and ``top_k`` cards per page.
    """
    named = _bonus_categories(cards)
    base = cards.select("card_id", "annual_fee", F.coalesce("base_rate", F.lit(DEFAULT_RATE)).alias("base_rate"), "bonuses", F.coalesce("foreign_fee_pct", F.lit(0.0)).alias("fee"))
    base = base.withColumn("__named", named)
    rates = F.transform("__named", lambda c: F.coalesce(F.try_element_at("bonuses", c), F.col("base_rate")).cast("double"))
    # What is missing comes first.
    fee = F.coalesce(F.col("annual_fee").cast("double"), F.lit(float("-inf"))).alias("fee_order")
    rows = base.select("card_id", F.coalesce("card_id", F.lit("")).alias("name_order"), F.col("annual_fee").cast("double").alias("annual_fee"), fee, F.col("fee").cast("double").alias("fee"), rates.alias("rates"))
    schema = "card_id string, annual_fee double, rate double, net_rate double, page int, foreign boolean, sign int"
    near = rows.mapInPandas(lambda frames: _first_of_pages(frames, top_k), schema).withColumn("category", F.get(named, F.col("page")))
    order = W.partitionBy("category", "foreign", "sign").orderBy((-F.col("sign") * F.col("net_rate")).asc(), "annual_fee", "card_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("category", "foreign", "sign", "rank", "card_id", "annual_fee", "rate", "net_rate")


def rank_card_table(txns: DataFrame, cards: DataFrame, top_k: int = 10, amount: str = "amount", category: str = "category", foreign: str = "is_foreign") -> DataFrame:
    """Ranked cards of a table of any size per purchase; a refund ranks what it loses least on, a null amount is nothing.

    Categories are few, so the pages of best cards go to every task and purchases stay where they are.
    """
    best = best_by_category(cards, top_k)
    page = F.when(F.array_contains(_bonus_categories(cards), F.col(category)), F.col(category)).otherwise(F.lit(""))
    keyed = txns.withColumns({"__foreign": F.coalesce(F.col(foreign) == 1, F.lit(False)), "__sign": F.signum(F.coalesce(F.col(amount), F.lit(0.0))).cast("int"), "__page": page})
    pages = best.select(F.col("category").alias("__page"), F.col("foreign").alias("__foreign"), F.col("sign").alias("__sign"), "rank", "card_id", "annual_fee", "net_rate")
    out = keyed.join(F.broadcast(pages), ["__page", "__foreign", "__sign"])
    return out.select(*txns.columns, "rank", "card_id", "annual_fee", (F.col(amount) * F.col("net_rate") / 100).alias("reward_amount"))


# ------------------------------------------------------------------------- spend caps


def spend_before(
    txns: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    amount: str = "amount",
    out: str = "spent_before",
    many: bool = False,
) -> DataFrame:
    """Spend of a bucket before each purchase, negatives counted as zero.

    Sums run in whole cents, so the result does not depend on the order of addition.
    ``chunk`` goes with the first of ``order``; the second cuts it further.  ``many`` as in
    running_before.
    """
    cents = F.round(F.greatest(F.coalesce(F.col(amount), F.lit(0.0)), F.lit(0.0)) * 100).cast("long")
    d = ordered.running_before(txns, keys, chunk, [F.col(c) for c in order], cents, "__cents", within=order[1] if len(order) > 1 else None, many=many)
    return d.withColumn(out, F.col("__cents") / 100).drop("__cents")


def cap_state(spent: Column, cap: Column) -> tuple[Column, Column]:
    """Remaining cap, never below zero, and whether the cap is reached."""
    remaining = F.greatest(cap - spent, F.lit(0.0))
    return remaining, remaining <= 0


def score_with_caps(
    txns: DataFrame,
    cards: Sequence[Card],
    user: str = "user_id",
    order: Sequence[str] = ("txn_date", "transaction_id"),
    period: Column | None = None,
    amount: str = "amount",
    category: str = "category",
    day: str = "txn_date",
) -> DataFrame:
    """Scores with category caps: a purchase that does not fit earns only the base rate.

    Every card of the portfolio accrues the spend, so the running sum is per user and
    category, computed once however many cards there are.  ``period`` resets the caps.
    """
    d = txns.withColumn("__period", period if period is not None else F.lit(0))
    d = spend_before(d, [user, category, "__period"], order, F.col(day), amount)
    d = d.withColumn("__c", F.explode(rate_book(cards, F.col(category), F.col(day))))
    remaining, _ = cap_state(F.col("spent_before"), F.col("__c.cap"))
    capped = F.col("__c.cap").isNotNull() & ((remaining <= 0) | (remaining < F.col(amount)))
    rate = F.when(capped, F.col("__c.base_rate")).otherwise(F.col("__c.rate"))
    return (
        d.withColumn("is_capped", capped)
        .withColumn("remaining_cap", remaining)
        .withColumn("reward_amount", reward_amount(F.col(amount), rate))
        .withColumn("card_id", F.col("__c.card_id"))
        .drop("__c", "__period")
    )


# ------------------------------------------------------------------ card table scoring


def card_frame(spark, cards: Sequence[Card]) -> DataFrame:
    """A portfolio as a table with map columns, for joins by card id."""
    rows = [
        (
            c.card_id, c.card_name, c.issuer, float(c.annual_fee),
            None if c.base_rate is None else float(c.base_rate),
            {k: float(v) for k, v in c.bonuses.items()},
        )
        for c in cards
    ]
    return spark.createDataFrame(
        rows,
        "card_id string, card_name string, issuer string, annual_fee double, base_rate double, bonuses map<string,double>",
    )


def score_card_table(pairs: DataFrame, amount: str = "amount", category: str = "category") -> DataFrame:
    """Reward for rows that already pair a purchase with a card by an equi join."""
    rate = applicable_rate(F.col(category), F.lit(None).cast("date"), F.col("base_rate"), F.col("bonuses"))
    return pairs.withColumn("reward_amount", reward_amount(F.col(amount), rate)).withColumn("reward_rate", rate)


def wallet(user_cards: DataFrame, catalog: DataFrame) -> DataFrame:
    """Saved cards with their catalogue data, each card once per user.

    Ids missing from the catalogue drop out, so a wallet is never longer than the catalogue.
    """
    once = user_cards.groupBy("user_id", "card_id").agg(F.min("saved_order").alias("saved_order"))
    return once.join(catalog, "card_id", "inner")


def finder(users: DataFrame, user_cards: DataFrame, cards: Sequence[Card]) -> DataFrame:
    """(user, card) pairs of the catalogue that the user has not saved."""
    offered = users.select("user_id", F.explode(F.array(*[F.lit(c.card_id) for c in cards])).alias("card_id"))
    return offered.join(user_cards.select("user_id", "card_id"), ["user_id", "card_id"], "left_anti")


def totals_per_card(scored: DataFrame, keys: Sequence[str] = ("user_id", "card_id")) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.sum("reward_amount").alias("reward_amount"),
        F.first("annual_fee").alias("annual_fee"),
        F.first("card_name").alias("card_name"),
    )


def rank_cards(scored: DataFrame, keys: Sequence[str], reward: str = "reward_amount") -> DataFrame:
    """1-based rank per key: reward descending, then fee, then card id.

    The window holds the cards offered to one key, which the catalogue size bounds.
    """
    w = W.partitionBy(*keys).orderBy(F.col(reward).desc(), F.col("annual_fee"), F.col("card_id"))
    return scored.withColumn("rank", F.row_number().over(w))


# ------------------------------------------------------------------- personalisation


def usable_point_value(predicted: Column, default: float = 1.0) -> Column:
    bad = predicted.isNull() | F.isnan(predicted) | (predicted <= 0)
    return F.when(bad, F.lit(default)).otherwise(predicted)


def personalize(scored: DataFrame, predictions: DataFrame, key: str = "user_id", default: float = 1.0) -> DataFrame:
    """Raw reward times the user's point value; the raw reward is kept beside it."""
    value = usable_point_value(F.col("point_value"), default)
    return (
        scored.join(predictions.select(key, "point_value"), key, "left")
        .withColumn("raw_reward_amount", F.col("reward_amount"))
        .withColumn("is_personalized", F.coalesce((F.col("point_value") > 0) & ~F.isnan("point_value"), F.lit(False)))
        .withColumn("point_value", value)
        .withColumn("reward_amount", F.col("raw_reward_amount") * F.col("point_value"))
    )


def valid_personas(user_personas: DataFrame, personas: Mapping = dims.PERSONAS) -> DataFrame:
    """Known personas per user; the set is at most as long as the persona table."""
    return (
        user_personas.where(F.col("persona").isin(list(personas)))
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_set("persona")).alias("personas"))
    )


def persona_factors(personas: Column, category: Column, table: Mapping = dims.PERSONAS) -> tuple[Column, Column]:
    """Mean category boost and mean fee multiplier of the active personas."""
    boosts = {(p, c): b for p, (_, _, cats) in table.items() for c, b in cats.items()}
    boost_map = F.create_map(*[x for (p, c), b in boosts.items() for x in (F.lit(f"{p}|{c}"), F.lit(float(b)))])
    fee_map = F.create_map(*[x for p, (_, m, _) in table.items() for x in (F.lit(p), F.lit(float(m)))])

    def mean(one):
        return F.aggregate(personas, F.lit(0.0), lambda acc, p: acc + one(p)) / F.size(personas)

    boost = mean(lambda p: F.coalesce(F.try_element_at(boost_map, F.concat_ws("|", p, category)), F.lit(1.0)))
    fee = mean(lambda p: F.coalesce(F.try_element_at(fee_map, p), F.lit(1.0)))
    none = personas.isNull() | (F.size(personas) == 0)
    return F.when(none, F.lit(1.0)).otherwise(boost), F.when(none, F.lit(1.0)).otherwise(fee)


def apply_personas(ranked: DataFrame, user_personas: DataFrame, keys: Sequence[str], category: str = "category") -> DataFrame:
    """Persona-adjusted reward and rank; without a known persona the row is unchanged."""
    d = ranked.join(valid_personas(user_personas), "user_id", "left")
    boost, fee = persona_factors(F.col("personas"), F.col(category))
    d = d.withColumn("category_boost", boost).withColumn("fee_multiplier", fee)
    penalty = (F.col("fee_multiplier") - 1.0) * F.col("annual_fee") / 12.0
    d = d.withColumn("fee_penalty", penalty).withColumn("previous_rank", F.col("rank"))
    changed = F.col("personas").isNotNull()
    d = d.withColumn(
        "adjusted_reward",
        F.when(changed, F.round(F.col("reward_amount") * F.col("category_boost") - F.col("fee_penalty"), 4)).otherwise(
            F.col("reward_amount")
        ),
    )
    w = W.partitionBy(*keys).orderBy(F.col("adjusted_reward").desc(), F.col("previous_rank"))
    return d.withColumn("rank", F.when(changed, F.row_number().over(w)).otherwise(F.col("previous_rank")))


def _persona_notes(personas: Column) -> Column:
    notes = F.create_map(*[x for p, (text, _, _) in dims.PERSONAS.items() for x in (F.lit(p), F.lit(text))])
    return F.transform(personas, lambda p: F.try_element_at(notes, p))


def persona_reason(personas: Column, category: Column, annual_fee: Column, boost: Column, fee_multiplier: Column) -> Column:
    """Short sentence on why a card suits the active personas."""
    say, fee = dims.PERSONA_REASON, F.format_string("$%.0f", annual_fee)
    about_fee = (
        F.when((annual_fee == 0) & (fee_multiplier > 1), F.lit(say["no_fee"]))
        .when((annual_fee != 0) & (fee_multiplier > 1), text.filled(say["fee_up"], fee=fee))
        .when((annual_fee != 0) & (fee_multiplier < 1), text.filled(say["fee_down"], fee=fee))
    )
    parts = F.concat_ws(
        " ",
        text.filled(say["match"], personas=F.concat_ws(", ", personas), notes=F.concat_ws("; ", _persona_notes(personas))),
        F.when(boost > 1, text.filled(say["boost"], category=category, boost=F.format_string("%.2f", boost))),
        about_fee,
    )
    none = personas.isNull() | (F.size(personas) == 0)
    return F.when(none, F.lit(say["none"])).otherwise(parts)


def persona_context(personas: Column, boost: Column, fee_multiplier: Column) -> Column:
    say = dims.PERSONA_CONTEXT
    way = F.when(fee_multiplier > 1, F.lit("increased")).otherwise(F.lit("reduced"))
    parts = F.concat_ws(
        " ",
        text.filled(say["active"], personas=F.concat_ws(", ", personas)),
        F.concat_ws(" | ", _persona_notes(personas)),
        F.when(boost != 1, text.filled(say["boost"], boost=F.format_string("%.2f", boost))),
        F.when(fee_multiplier != 1, text.filled(say["fee"], way=way, fee=F.format_string("%.2f", fee_multiplier))),
    )
    none = personas.isNull() | (F.size(personas) == 0)
    return F.when(none, F.lit("")).otherwise(parts)


# --------------------------------------------------------------------- profile scoring


def normalize_spend(raw: DataFrame, key: str = "user_id", category: str = "raw_category", amount: str = "raw_amount") -> DataFrame:
    """Positive spend per known category; unknown names add up under ``other``."""
    value = F.col(amount).try_cast("double")
    name = F.lower(F.trim(F.col(category)))
    return (
        raw.where((value > 0) & (name != ""))
        .withColumn("category", F.when(name.isin(dims.SPENDING_CATEGORIES), name).otherwise(F.lit("other")))
        .groupBy(key, "category")
        .agg(F.sum(value).alias("amount"))
    )


def profile_purchases(
    profiles: DataFrame,
    spend: DataFrame,
    history: DataFrame | None = None,
    key: str = "user_id",
    default_spend: float = 1000.0,
) -> DataFrame:
    """Pseudo-purchases of a profile: its categories, its history, and the remainder.

    ``profiles`` has (key, monthly_spend); a profile without anything gets one default
    purchase.
    """
    per_user = spend.groupBy(key).agg(F.sum("amount").alias("__explicit"))
    parts = spend.select(key, "category", "amount", F.lit("monthly_profile").alias("merchant"))
    has_history = None
    if history is not None:
        past = history.where(F.col("amount") > 0).select(
            key, "category", "amount", F.coalesce(F.col("merchant"), F.lit("transaction_history")).alias("merchant")
        )
        parts = parts.unionByName(past)
        has_history = past.groupBy(key).agg(F.lit(1).alias("__h"))
    p = profiles.select(key, F.coalesce(F.col("monthly_spend"), F.lit(0.0)).alias("__monthly")).join(per_user, key, "left")
    p = p.join(has_history, key, "left") if has_history is not None else p.withColumn("__h", F.lit(None).cast("int"))
    explicit = F.coalesce(F.col("__explicit"), F.lit(0.0))
    extra = p.select(
        key,
        F.lit("other").alias("category"),
        F.when(F.col("__monthly") > explicit, F.col("__monthly") - explicit)
        .when(F.col("__explicit").isNull() & F.col("__h").isNull(), F.lit(default_spend))
        .alias("amount"),
        F.when(F.col("__monthly") > explicit, F.lit("monthly_spend_remainder")).otherwise(F.lit("default_spend")).alias("merchant"),
    ).where(F.col("amount").isNotNull())
    return parts.unionByName(extra)


def affinity(spend: DataFrame, catalog: DataFrame, pairs: DataFrame, preferred: DataFrame) -> DataFrame:
    """Multiplier per (user, card) from spend shares, bonuses and reward preferences.

    ``pairs`` holds (user_id, card_id); ``preferred`` holds user_id with boolean
    columns ``likes_travel`` and ``likes_cashback``.
    """
    totals = spend.groupBy("user_id").agg(F.sum("amount").alias("__total"))
    joined = (
        pairs.join(catalog, "card_id")
        .join(spend, "user_id", "left")
        .join(totals, "user_id", "left")
    )
    base = F.coalesce(F.col("base_rate"), F.lit(1.0))
    uplift = F.greatest(F.coalesce(F.try_element_at("bonuses", F.col("category")), base) - base, F.lit(0.0))
    per_card = joined.groupBy("user_id", "card_id").agg(
        (1.0 + F.coalesce(F.sum(F.col("amount") / F.col("__total") * uplift * 0.75), F.lit(0.0))).alias("__m"),
        F.max(F.coalesce(F.try_element_at("bonuses", F.lit("travel")), base) > base).alias("__travel"),
        F.max(F.col("annual_fee") <= 0).alias("__free"),
        F.max("__total").alias("__total"),
    )
    d = per_card.join(preferred, "user_id", "left")
    m = (
        F.col("__m")
        + F.when(F.coalesce(F.col("likes_travel"), F.lit(False)) & F.col("__travel"), 0.15).otherwise(0.0)
        + F.when(F.coalesce(F.col("likes_cashback"), F.lit(False)) & F.col("__free"), 0.10).otherwise(0.0)
    )
    return d.select(
        "user_id",
        "card_id",
        F.when(F.coalesce(F.col("__total"), F.lit(0.0)) <= 0, F.lit(1.0)).otherwise(F.greatest(m, F.lit(0.1))).alias("affinity"),
    )


def blend(deterministic: Column, point_factor: Column, affinity_: Column, personalised: Column, weight: float = 0.6) -> Column:
    personal = deterministic * point_factor * affinity_
    return F.when(personalised, deterministic * weight + personal * (1.0 - weight)).otherwise(deterministic)


# ------------------------------------------------------------------ savings calculator


def default_spend(monthly: float = 1000.0) -> dict[str, float]:
    """The default spend profile scaled to a monthly total."""
    total = sum(dims.DEFAULT_SPEND.values())
    return {c: round((monthly if monthly > 0 else 1000.0) * v / total, 2) for c, v in dims.DEFAULT_SPEND.items()}


def default_spend_rows(monthly: Column) -> Column:
    """array<struct<category, amount>>: the default profile scaled to each row's monthly total, to the cent."""
    total = sum(dims.DEFAULT_SPEND.values())
    known = F.when(monthly > 0, monthly).otherwise(F.lit(1000.0))
    return F.array(*[F.struct(F.lit(c).alias("category"), F.round(F.floor(known * v * 100 / total + 0.5) / 100, 2).alias("amount")) for c, v in dims.DEFAULT_SPEND.items()])


def baseline_cards(user_cards: DataFrame, catalog: DataFrame) -> DataFrame:
    """First saved card without category bonuses, per user."""
    flat = catalog.where(F.size("bonuses") == 0)
    saved = user_cards.join(flat, "card_id")
    return saved.groupBy("user_id").agg(
        F.min(
            F.struct("saved_order", F.col("card_id").alias("id"), F.col("annual_fee").alias("fee"), F.col("base_rate").alias("rate"))
        ).alias("b")
    ).select(
        "user_id",
        F.col("b.id").alias("baseline_card_id"),
        F.col("b.fee").alias("baseline_fee"),
        F.col("b.rate").alias("baseline_rate"),
    )


def savings(spend: DataFrame, offered: DataFrame, catalog: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per (user, card): monthly and annual reward, uplift over the baseline, net benefit.

    ``spend`` is (user_id, category, amount), ``offered`` is (user_id, card_id).
    A user without a flat-rate card is measured against a generic 1 % card.
    """
    pairs = (
        offered.join(catalog, "card_id")
        .join(spend, "user_id")
        .join(baseline, "user_id", "left")
        .withColumn("baseline_rate", F.coalesce(F.col("baseline_rate"), F.lit(1.0)))
        .withColumn("baseline_fee", F.coalesce(F.col("baseline_fee"), F.lit(0.0)))
    )
    rate = F.coalesce(F.try_element_at("bonuses", F.col("category")), F.col("base_rate"), F.lit(1.0))
    reward = F.col("amount") * rate / 100
    base = F.col("amount") * F.col("baseline_rate") / 100
    totals = pairs.groupBy("user_id", "card_id", "card_name", "annual_fee", "baseline_card_id", "baseline_fee").agg(
        F.sum(reward).alias("monthly_reward"), F.sum(reward - base).alias("monthly_uplift")
    )
    return totals.select(
        "user_id",
        "card_id",
        "card_name",
        "annual_fee",
        "baseline_card_id",
        "monthly_reward",
        (F.col("monthly_reward") * 12).alias("annual_reward"),
        "monthly_uplift",
        (F.col("monthly_uplift") * 12).alias("annual_uplift"),
        (F.col("monthly_uplift") * 12 - (F.col("annual_fee") - F.col("baseline_fee"))).alias("net_annual_benefit"),
    )


def check_cases(cases: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Pass flag per case from ``actual`` and ``expected``."""
    return cases.withColumn("passed", F.abs(F.col("actual") - F.col("expected")) < tolerance)


def online_user_features(purchases: DataFrame, spend: DataFrame, profiles: DataFrame, key: str = "user_id") -> DataFrame:
    """Feature row per scoring request.

    Purchases and spend are read once per block of features, so give written tables.  Uses the population deviation, the upper median, and the share of merchants seen
    more than once; these differ on purpose from the batch features of the same names.
    """
    amount = F.greatest(F.col("amount"), F.lit(0.0))
    p = purchases.withColumn("__a", amount)
    base = p.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("__a").alias("total_spending"),
        F.avg("__a").alias("avg_transaction_amount"),
        F.stddev_pop("__a").alias("transaction_amount_std"),
    )
    upper = ordered.pick_ranks(p, [key], "__a", {"median_transaction_amount": lambda n: F.floor(n / 2)}, many=True).drop("n_values")
    names = F.lower(F.trim("merchant"))
    merchants = (
        p.where(names != "").groupBy(key, names.alias("__m")).agg(F.count(F.lit(1)).alias("__k"))
        .groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("num_unique_merchants"),
            F.sum((F.col("__k") > 1).cast("long")).alias("__repeat"),
        )
    )
    total = spend.groupBy(key).agg(F.sum("amount").alias("__s"), F.count(F.lit(1)).alias("__k"))
    shares = spend.join(total, key).withColumn("__p", F.col("amount") / F.col("__s"))
    entropy = shares.groupBy(key).agg(
        F.sum(-F.col("__p") * F.log2("__p")).alias("__e"), F.max("__k").alias("n_categories")
    )
    d = (
        base.join(upper, key, "left")
        .join(merchants, key, "left")
        .join(entropy, key, "left")
        .join(profiles.select(key, "monthly_spend"), key, "left")
    )
    total_col = F.col("total_spending")
    budget = (
        F.when(F.col("monthly_spend") > 0, F.col("monthly_spend"))
        .when(total_col > 0, total_col)
        .otherwise(F.lit(1000.0))
    )
    e = F.coalesce(F.col("__e"), F.lit(0.0))
    return d.select(
        key,
        budget.alias("monthly_budget"),
        (budget * 12).alias("annual_budget"),
        F.log1p(budget).alias("monthly_budget_log"),
        "total_spending",
        "avg_transaction_amount",
        "median_transaction_amount",
        "transaction_amount_std",
        F.greatest(e, F.lit(0.0)).alias("spending_diversity"),
        (e / F.log2(F.greatest(F.coalesce(F.col("n_categories"), F.lit(0)), F.lit(2)))).alias("category_affinity_score"),
        F.coalesce("num_unique_merchants", F.lit(0)).alias("num_unique_merchants"),
        (F.coalesce("__repeat", F.lit(0)) / F.greatest(F.coalesce("num_unique_merchants", F.lit(0)), F.lit(1))).alias(
            "repeat_merchant_ratio"
        ),
        F.when(F.col("avg_transaction_amount") > 0, F.col("transaction_amount_std") / F.col("avg_transaction_amount"))
        .otherwise(F.lit(0.0))
        .alias("spending_velocity"),
    )
