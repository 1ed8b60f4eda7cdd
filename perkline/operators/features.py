"""Features per user, per card and per profile.

The user block reads the transactions once for sums and once, exploded to
(user, dimension, value) counts, for everything that depends on value frequencies:
distinct counts, modes, repeat ratios and per-code means.  Both reduce map-side, so
a very active user costs one row per distinct value after the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline import dims
from perkline.functions import nested, text
from perkline.operators import ordered

FEATURE_CATEGORIES = ["dining", "travel", "online_shopping", "utilities", "entertainment", "groceries", "gas"]


# -------------------------------------------------------------------- date and number


def calendar_parts(day: Column) -> dict[str, Column]:
    """Monday is 0; the first week and the days from the 24th have their own flags."""
    dow = F.weekday(day)
    dom = F.dayofmonth(day)
    return {
        "day_of_week": dow,
        "day_of_month": dom,
        "month": F.month(day),
        "quarter": F.quarter(day),
        "is_weekend": (dow >= 5).cast("int"),
        "is_month_start": (dom <= 7).cast("int"),
        "is_month_end": (dom >= 24).cast("int"),
    }


def entropy_of(parts: Sequence[Column]) -> Column:
    """Base-2 entropy of the positive parts of one row, 0 when there is none."""
    positive = [F.when(p > 0, p).otherwise(F.lit(0.0)) for p in parts]
    total = positive[0]
    for p in positive[1:]:
        total = total + p
    e = F.lit(0.0)
    for p in positive:
        share = p / total
        e = e + F.when(p > 0, -share * F.log2(share + 1e-10)).otherwise(F.lit(0.0))
    return F.when(total > 0, e).otherwise(F.lit(0.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.when(b != 0, b), F.lit(0.0))


# --------------------------------------------------------------------------- per user


def spending_by_category(txns: DataFrame, user: str = "user_id", category: str = "category", amount: str = "amount") -> DataFrame:
    """Sum, count, mean, max, min and sample deviation per (user, category)."""
    a = F.col(amount)
    return txns.groupBy(user, category).agg(
        F.sum(a).alias("total_spent"),
        F.count(a).alias("transaction_count"),
        F.avg(a).alias("avg_transaction"),
        F.max(a).alias("max_transaction"),
        F.min(a).alias("min_transaction"),
        F.stddev_samp(a).alias("std_transaction"),
    )


def _fixed_mode(counts: dict[int, str]) -> Column:
    """Most frequent of a few known values from their count columns, ties to the smallest."""
    return F.array_min(F.array(*[F.struct((-F.col(c)).alias("n"), F.lit(v).alias("v")) for v, c in counts.items()]))["v"]


def base_block(txns: DataFrame, categories: Sequence[str], user: str = "user_id") -> DataFrame:
    """All per-user sums in one aggregate: category pivot, totals, calendar counts.

    Months and weekdays are few, so their modes come from conditional counts here.
    """
    cal = calendar_parts(F.col("txn_date"))
    a = F.col("amount")
    aggs = []
    for c in categories:
        hit = F.col("category") == c
        aggs.append(F.coalesce(F.sum(F.when(hit, a)), F.lit(0.0)).alias(f"{c}_total_spent"))
        aggs.append(F.coalesce(F.sum(F.when(hit & a.isNotNull(), 1)), F.lit(0)).alias(f"{c}_txn_count"))
    months = {m: f"__month_{m}" for m in range(1, 13)}
    days = {d: f"__dow_{d}" for d in range(7)}
    aggs += [F.count(F.when(cal["month"] == m, 1)).alias(c) for m, c in months.items()]
    aggs += [F.count(F.when(cal["day_of_week"] == d, 1)).alias(c) for d, c in days.items()]
    aggs += [
        F.sum(a).alias("total_spending"),
        F.count(a).alias("total_transactions"),
        F.count(F.lit(1)).alias("__n"),
        F.avg(cal["is_weekend"]).alias("weekend_spending_ratio"),
        F.avg(a).alias("avg_transaction_amount"),
        F.stddev_samp(a).alias("transaction_amount_std"),
    ]
    if "suspicious" in txns.columns:
        aggs += [F.sum("suspicious").alias("num_suspicious"), F.avg("suspicious").alias("suspicious_rate")]
    d = txns.groupBy(user).agg(*aggs)
    d = d.withColumns({"peak_spending_month": _fixed_mode(months), "peak_spending_day": _fixed_mode(days)})
    if categories:
        d = d.withColumn("spending_diversity", entropy_of([F.col(f"{c}_total_spent") for c in categories]))
    return d.drop(*months.values(), *days.values())


def frequency_block(txns: DataFrame, user: str = "user_id") -> DataFrame:
    """Distinct counts and modes of card, code and merchant, and the mean per code.

    A mode with equal counts is the smallest value.
    """
    dimsets = {"card": F.col("card_used"), "mcc": F.col("mcc_code").cast("string"), "merchant": F.col("merchant")}
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), v.alias("val")) for k, v in dimsets.items()]))
    counts = (
        txns.select(user, "amount", pairs.alias("p"))
        .groupBy(user, F.col("p.dim").alias("dim"), F.col("p.val").alias("val"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean_amount"))
        .where(F.col("val").isNotNull())
    )

    def mode(dim: str) -> Column:
        return F.min(F.when(F.col("dim") == dim, F.struct((-F.col("n")).alias("n"), F.col("val").alias("val"))))["val"]

    def distinct(dim: str) -> Column:
        return F.sum((F.col("dim") == dim).cast("long"))

    return counts.groupBy(user).agg(
        distinct("card").alias("num_cards_used"),
        mode("card").alias("primary_card"),
        distinct("mcc").alias("num_unique_mccs"),
        mode("mcc").cast("int").alias("primary_mcc"),
        F.avg(F.when(F.col("dim") == "mcc", F.col("mean_amount"))).alias("avg_spending_per_mcc"),
        distinct("merchant").alias("num_unique_merchants"),
        mode("merchant").alias("favorite_merchant"),
    )


def _blocks(txns: DataFrame, categories: Sequence[str], user: str, order: Sequence[str]) -> DataFrame:
    """The feature rows of users with any number of transactions, cut by day, value and frequency."""
    switches = ordered.change_counts(txns, [user], F.col("txn_date"), [F.col(c) for c in order], "card_used")
    median = ordered.quantiles(txns, [user], "amount", {"median_transaction_amount": 0.5}).drop("n_values")
    rate = F.when(F.col("n_rows") > 1, F.col("n_changes") / (F.col("n_rows") - 1)).otherwise(F.lit(0.0))
    return (
        base_block(txns, categories, user)
        .join(frequency_block(txns, user), user, "left")
        .join(median, user, "left")
        .join(switches.select(user, rate.alias("card_switch_rate")), user, "left")
    )


def _first_most(group: np.ndarray, count: np.ndarray, groups: int) -> np.ndarray:
    """Place of the first largest ``count`` of every group, -1 for none; ``group`` is ascending."""
    order = np.lexsort((np.arange(len(group)), -count, group))
    found = np.full(groups, -1)
    own, first = np.unique(group[order], return_index=True)
    found[own] = order[first]
    return found


class _Rows:
    """Features of the users of one table whose rows lie together and in order."""

    def __init__(self, rows: pa.Table, categories: int, starts: np.ndarray):
        self.rows, self.n, self.starts, self.kinds = rows, len(starts), starts, categories
        self.size = np.diff(np.append(starts, rows.num_rows))
        self.user = np.repeat(np.arange(self.n), self.size)
        amount = rows["amount"]
        self.known = amount.is_valid().to_numpy()
        self.amount = pc.fill_null(amount, 0.0).to_numpy()

    def _sum(self, values: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
        where = slice(None) if where is None else where
        return np.bincount(self.user[where], values[where], self.n)

    def _count(self, where: np.ndarray) -> np.ndarray:
        return np.bincount(self.user[where], minlength=self.n)

    def _mode(self, name: str, low: int, high: int) -> pa.Array:
        """Most frequent of the numbers from ``low`` to ``high``, ties to the smallest, ``low`` for none."""
        column = self.rows[name]
        at, width = column.is_valid().to_numpy(), high - low + 1
        place = self.user[at] * width + pc.fill_null(column, low).to_numpy().astype(np.int64)[at] - low
        table = np.bincount(place, minlength=self.n * width).reshape(self.n, width)
        return pa.array((table.argmax(axis=1) + low).astype(np.int32))

    def _texts(self, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Code per row (-1 for null), and user, code, count of every pair of them; the texts by code; pair per known row."""
        coded = self.rows[name].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        by_size = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(by_size) + 1, np.int64)
        rank[by_size], rank[-1] = np.arange(len(by_size)), -1
        code = rank[pc.fill_null(coded.indices, -1).to_numpy()]
        at, width = code >= 0, max(1, len(by_size))
        pairs, pair, count = np.unique(self.user[at] * width + code[at], return_inverse=True, return_counts=True)
        return code, np.stack([pairs // width, pairs % width, count]), at, coded.dictionary.take(pa.array(by_size)), pair

    def columns(self) -> dict[str, pa.Array]:
        out, whole = {}, self._count(self.known)
        category = self.rows["__category"].to_numpy()
        place = (self.user * (self.kinds + 1) + category)[self.known]
        shape = (self.n, self.kinds + 1)
        sums = np.bincount(place, self.amount[self.known], self.n * shape[1]).reshape(shape)
        counts = np.bincount(place, minlength=self.n * shape[1]).reshape(shape)
        for k in range(self.kinds):
            out[f"__sum_{k}"], out[f"__count_{k}"] = pa.array(sums[:, k]), pa.array(counts[:, k])
        total = self._sum(self.amount, self.known)
        none, mean = whole == 0, total / np.maximum(whole, 1)
        spread = self._sum((self.amount - mean[self.user]) ** 2, self.known)
        out["total_spending"], out["total_transactions"], out["__n"] = pa.array(total, mask=none), pa.array(whole), pa.array(self.size)
        out["avg_transaction_amount"] = pa.array(mean, mask=none)
        out["transaction_amount_std"] = pa.array(np.sqrt(spread / np.maximum(whole - 1, 1)), mask=whole < 2)
        day = self.rows["__day"]
        dated, weekend = day.is_valid().to_numpy(), pc.fill_null(day, 0).to_numpy() >= 5
        days = self._count(dated)
        out["weekend_spending_ratio"] = pa.array(self._count(dated & weekend) / np.maximum(days, 1), mask=days == 0)
        out["peak_spending_month"], out["peak_spending_day"] = self._mode("__month", 1, 12), self._mode("__day", 0, 6)
        if "suspicious" in self.rows.column_names:
            flag = self.rows["suspicious"]
            valid = flag.is_valid().to_numpy()
            flags, flagged = self._count(valid), np.zeros(self.n, np.int64)
            np.add.at(flagged, self.user[valid], pc.fill_null(flag, 0).to_numpy().astype(np.int64)[valid])
            out["num_suspicious"] = pa.array(flagged, mask=flags == 0)
            out["suspicious_rate"] = pa.array(flagged / np.maximum(flags, 1), mask=flags == 0)
        names = {"card_used": ("num_cards_used", "primary_card"), "mcc_code": ("num_unique_mccs", "primary_mcc"), "merchant": ("num_unique_merchants", "favorite_merchant")}
        any_, distinct = np.zeros(self.n, bool), {}
        for name, (number, most) in names.items():
            code, (own, value, count), at, texts, pair = self._texts(name)
            distinct[number] = np.bincount(own, minlength=self.n)
            any_ |= distinct[number] > 0
            first = _first_most(own, count, self.n)
            out[most] = texts.take(pa.array(value[first] if len(value) else np.zeros(self.n, np.int64), mask=first < 0))
            if name == "card_used":
                turned = np.zeros(len(code), bool)
                turned[1:] = (code[1:] != code[:-1]) & (self.user[1:] == self.user[:-1])
                out["card_switch_rate"] = pa.array(self._count(turned) / np.maximum(self.size - 1, 1))
            if name == "mcc_code":
                known = self.known[at]
                n = np.bincount(pair[known], minlength=len(own))
                mean = np.bincount(pair[known], self.amount[at][known], len(own)) / np.maximum(n, 1)
                means = np.bincount(own[n > 0], minlength=self.n)
                out["avg_spending_per_mcc"] = pa.array(np.bincount(own[n > 0], mean[n > 0], self.n) / np.maximum(means, 1), mask=means == 0)
        for number, values in distinct.items():
            out[number] = pa.array(values, mask=~any_)
        real = self.known & ~np.isnan(self.amount)
        n, order = self._count(real), np.lexsort((self.amount[real], self.user[real]))
        values, begin = self.amount[real][order] + 0.0, np.cumsum(n) - n
        if not len(values):
            values = np.zeros(1)
        h = 0.5 * np.maximum(n - 1, 0)
        low, high = (values[np.minimum(begin + f(h).astype(np.int64), len(values) - 1)] for f in (np.floor, np.ceil))
        out["median_transaction_amount"] = pa.array(low + (high - low) * (h - np.floor(h)), mask=n == 0)
        return out


def _of_few(txns: DataFrame, categories: Sequence[str], user: str, order: Sequence[str]) -> DataFrame:
    """The same rows for users whose transactions fit into a task, from one shuffle and one sort.

    A task gets its users one after the other, each in order, and works on whole Arrow
    batches; the last user of a batch waits for the next one.
    """
    kinds, cal = len(categories), calendar_parts(F.col("txn_date"))
    place = F.lit(kinds)
    for k, c in reversed(list(enumerate(categories))):
        place = F.when(F.col("category") == c, F.lit(k)).otherwise(place)
    flags = [F.col("suspicious")] if "suspicious" in txns.columns else []
    # The hash parts most rows at the first look, where names and numbers begin alike.
    rows = txns.repartition(user).sortWithinPartitions(F.xxhash64(user), user, *order).select(
        user, place.alias("__category"), cal["month"].alias("__month"), cal["day_of_week"].alias("__day"), F.col("amount").cast("double").alias("amount"),
        *[F.col(c).cast("string").alias(c) for c in ("card_used", "mcc_code", "merchant")], *flags,
    )
    texts = ["primary_card", "primary_mcc", "favorite_merchant"]
    longs = ["total_transactions", "__n", "num_cards_used", "num_unique_mccs", "num_unique_merchants"]
    doubles = ["total_spending", "avg_transaction_amount", "transaction_amount_std", "weekend_spending_ratio", "card_switch_rate", "avg_spending_per_mcc", "median_transaction_amount"]
    if flags:
        longs, doubles = [*longs, "num_suspicious"], [*doubles, "suspicious_rate"]
    fields = [T.StructField(user, txns.schema[user].dataType)]
    for k in range(kinds):
        fields += [T.StructField(f"__sum_{k}", T.DoubleType()), T.StructField(f"__count_{k}", T.LongType())]
    for kind, own in [(T.StringType(), texts), (T.LongType(), longs), (T.DoubleType(), doubles), (T.IntegerType(), ["peak_spending_month", "peak_spending_day"])]:
        fields += [T.StructField(name, kind) for name in own]
    names = [f.name for f in fields]

    def features(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        out = _Rows(rows, kinds, starts).columns()
        out[user] = rows[user].combine_chunks().take(pa.array(starts))
        yield from pa.table([out[name] for name in names], names=names).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            both = both.combine_chunks()
            ids = both[user].combine_chunks()
            starts = np.append(0, np.nonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False))[0] + 1)
            held = both.slice(starts[-1])
            if starts[-1]:
                yield from features(both.slice(0, starts[-1]), starts[:-1])
        if held is not None:
            yield from features(held.combine_chunks(), np.zeros(1, np.int64))

    d = rows.mapInArrow(run, T.StructType(fields))
    for k, c in enumerate(categories):
        d = d.withColumnsRenamed({f"__sum_{k}": f"{c}_total_spent", f"__count_{k}": f"{c}_txn_count"})
    d = d.withColumn("primary_mcc", F.col("primary_mcc").cast("int"))
    return d.withColumn("spending_diversity", entropy_of([F.col(f"{c}_total_spent") for c in categories])) if categories else d


def user_features(
    txns: DataFrame,
    categories: Sequence[str] = FEATURE_CATEGORIES,
    user: str = "user_id",
    order: Sequence[str] = ("txn_date", "transaction_id"),
    most: int = ordered.CHUNK_VALUES,
) -> DataFrame:
    """The full feature row of every user with transactions.

    Users with at most ``most`` transactions are shuffled once, whole; what larger ones
    (and those without a name) have is cut and goes block by block.
    """
    n = txns.groupBy(user).agg(F.count(F.lit(1)).alias("__rows"))
    large = F.broadcast(n.where((F.col("__rows") > most) | F.col(user).isNull()).select(F.col(user).alias("__large")))
    same = F.col(user).eqNullSafe(F.col("__large"))
    cut = _blocks(txns.join(large, same, "left_semi"), categories, user, order)
    d = cut.unionByName(_of_few(txns.join(large, same, "left_anti"), categories, user, order).select(*cut.columns))
    return d.withColumn("repeat_merchant_ratio", (F.col("__n") - F.col("num_unique_merchants")) / F.col("__n")).drop("__n")


# --------------------------------------------------------------------------- one-hot


def one_hot(column: str, values: Sequence[str], prefix: str) -> dict[str, Column]:
    """Indicator columns for known values; null and unknown values are all zero."""
    return {f"{prefix}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in values}


# ------------------------------------------------------------------------------ cards


def fee_tiers(fee: Column) -> dict[str, Column]:
    f = F.coalesce(fee, F.lit(0.0))
    return {
        "is_premium": (f >= 450).cast("int"),
        "is_mid_tier": ((f >= 95) & (f < 450)).cast("int"),
        "is_no_annual_fee": (f == 0).cast("int"),
    }


def bonus_difficulty(spend: Column, days: Column) -> Column:
    d = F.when(F.coalesce(days, F.lit(0)) == 0, F.lit(90)).otherwise(days)
    return (
        F.when(spend == 0, F.lit("none"))
        .when((spend < 2000) & (d >= 90), F.lit("easy"))
        .when((spend > 5000) | (d < 60), F.lit("hard"))
        .otherwise(F.lit("medium"))
    )


def card_features(
    cards: DataFrame,
    annual_spending: float = 25000.0,
    issuers: Sequence[str] = (),
    networks: Sequence[str] = (),
    currencies: Sequence[str] = (),
) -> DataFrame:
    """Activity, base rate, bonus value, credits, fees and net value of every card.

    A row-level projection: no shuffle however many cards there are.
    """
    d = cards
    if "discontinued" in d.columns:
        gone = F.coalesce(F.col("discontinued"), F.lit(False))
        d = d.withColumns({"is_active": (~gone).cast("int"), "is_discontinued": gone.cast("int")})
    else:
        d = d.withColumns({"is_active": F.lit(1), "is_discontinued": F.lit(0)})
    d = d.withColumn("base_reward_rate", nested.base_reward_rate(d.columns))
    if "offers" in d.columns:
        d = d.withColumn("__o", nested.first_offer(F.col("offers")))
    else:
        d = d.withColumn("__o", F.struct(F.lit(0.0).alias("spend"), F.lit(0.0).alias("amount"), F.lit(90).alias("days")))
    d = d.withColumns(
        {
            "welcome_bonus_spend_req": F.col("__o.spend"),
            "welcome_bonus_amount": F.col("__o.amount"),
            "welcome_bonus_days": F.col("__o.days"),
            "currency": F.coalesce(F.col("currency"), F.lit("POINTS")) if "currency" in d.columns else F.lit("POINTS"),
        }
    ).drop("__o")
    value = F.col("welcome_bonus_amount") * nested.lookup(F.col("currency"), dims.CENTS_PER_UNIT, 1.0)
    d = d.withColumns({"welcome_bonus_value_cents": value, "welcome_bonus_value_usd": value / 100.0})
    d = d.withColumns(
        {
            "welcome_bonus_roi": F.when(
                F.col("welcome_bonus_spend_req") > 0, F.col("welcome_bonus_value_usd") / F.col("welcome_bonus_spend_req")
            ).otherwise(F.lit(0.0)),
            "bonus_difficulty": bonus_difficulty(F.col("welcome_bonus_spend_req"), F.col("welcome_bonus_days")),
        }
    )
    if "credits" in d.columns:
        d = d.withColumn("__c", nested.credit_totals(F.col("credits")))
    else:
        d = d.withColumn("__c", F.struct(F.lit(0.0).alias("value"), F.lit(0).alias("count")))
    d = d.withColumns(
        {
            "annual_credits_value": F.col("__c.value"),
            "num_credits": F.col("__c.count"),
            "has_credits": (F.col("__c.count") > 0).cast("int"),
        }
    ).drop("__c")
    fee = F.coalesce(F.col("annual_fee").try_cast("double"), F.lit(0.0)) if "annual_fee" in d.columns else F.lit(0.0)
    waived = F.coalesce(F.col("is_annual_fee_waived"), F.lit(False)) if "is_annual_fee_waived" in d.columns else F.lit(False)
    d = d.withColumn("effective_annual_fee", fee - F.col("annual_credits_value"))
    d = d.withColumns(
        {
            "effective_fee_year1": F.when(waived, 0.0 - F.col("annual_credits_value")).otherwise(F.col("effective_annual_fee")),
            "net_annual_cost": F.col("effective_annual_fee"),
        }
    )
    rate = F.coalesce(text.numeric_like(F.col("base_reward_rate")), F.lit(0.0))
    d = d.withColumn("expected_annual_rewards", F.lit(float(annual_spending)) * (rate / 100.0))
    d = d.withColumns(
        {
            "net_value_annual": F.col("expected_annual_rewards") - F.col("effective_annual_fee"),
            "net_value_year1": F.col("expected_annual_rewards") - F.col("effective_fee_year1") + F.col("welcome_bonus_value_usd"),
        }
    )
    d = d.withColumn("value_per_dollar", F.col("net_value_annual") / float(annual_spending))
    if "issuer" in d.columns:
        d = d.withColumn("issuer_clean", text.title_case(F.replace(F.col("issuer"), F.lit("_"), F.lit(" "))))
    d = d.withColumns(fee_tiers(fee))
    if "is_business" in d.columns:
        d = d.withColumn("is_business", F.coalesce(F.col("is_business"), F.lit(False)).cast("int"))
    for col, values in [("issuer", issuers), ("network", networks), ("currency", currencies)]:
        if values:
            d = d.withColumns(one_hot(col, values, col))
    return d


# ------------------------------------------------------------------------------ users


QUARTER_LABELS = ["Q1_low", "Q2_medium_low", "Q3_medium_high", "Q4_high"]


def cut_label(value: Column, edges: Sequence[Column], labels: Sequence[str]) -> Column:
    """Label by value cut points: right-closed bins, the lowest edge included."""
    out = F.lit(labels[-1])
    for e, lab in list(zip(edges, labels[:-1]))[::-1]:
        out = F.when(value <= e, F.lit(lab)).otherwise(out)
    return F.when(value.isNotNull(), out)


def quantile_edges(df: DataFrame, column: str, k: int = 4) -> DataFrame:
    """One row with the k-1 inner quantile cut points of a column."""
    return ordered.quantiles(df, [], column, {f"e{i}": i / k for i in range(1, k)}).drop("n_values")


def quantile_label(df: DataFrame, column: str, out: str, labels: Sequence[str]) -> DataFrame:
    """Quantile bin of each row by value cut points; equal values share a bin."""
    k = len(labels)
    edges = quantile_edges(df, column, k).select(F.array(*[f"e{i}" for i in range(1, k)]).alias("e")).scalar()
    d = df.withColumn("__edges", edges)
    label = cut_label(F.col(column), [F.col("__edges")[i] for i in range(k - 1)], labels)
    return d.withColumn(out, label).drop("__edges")


def profile_features(
    users: DataFrame,
    archetypes: Sequence[str] = tuple(dims.ARCHETYPES),
    ages: Sequence[str] = tuple(dims.AGE_GROUPS),
    locations: Sequence[str] = tuple(dims.LOCATIONS),
    redemptions: Sequence[str] = tuple(dims.REDEMPTIONS),
) -> DataFrame:
    """Feature row of every profile: cards, encodings, budget, point value."""
    d = users.withColumn("cards_list", nested.card_list(F.col("cards"))).withColumn("num_cards", F.size("cards_list"))
    d = d.withColumns(one_hot("archetype", archetypes, "archetype"))
    d = d.withColumn("age_group_ordinal", nested.lookup(F.col("age_group"), dims.AGE_ORDINAL, 0))
    d = d.withColumns(one_hot("age_group", ages, "age"))
    d = d.withColumns(one_hot("location_type", locations, "location"))
    d = d.withColumn("monthly_budget", F.coalesce(F.col("monthly_budget").try_cast("double"), F.lit(0.0)))
    d = d.withColumns(
        {
            "monthly_budget_log": F.when(F.col("monthly_budget") > -1, F.log1p("monthly_budget")),
            "annual_budget": F.col("monthly_budget") * 12.0,
        }
    )
    d = quantile_label(d, "monthly_budget", "budget_quartile", QUARTER_LABELS)
    d = d.withColumns(one_hot("budget_quartile", QUARTER_LABELS, "budget"))
    d = d.withColumn("estimated_point_value", nested.lookup(F.col("redemption_preference"), dims.POINT_VALUE, 0.01))
    return d.withColumns(one_hot("redemption_preference", redemptions, "redemption"))


def user_cards(users: DataFrame) -> DataFrame:
    """(user, card, redemption preference), one row per listed card."""
    return users.select("user_id", F.explode(nested.card_list(F.col("cards"))).alias("card_id"), "redemption_preference")


def build_all(
    cards: DataFrame | None,
    txns: DataFrame | None,
    users: DataFrame | None,
    annual_spending: float = 25000.0,
    encodings: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """The three feature tables for whichever inputs are present."""
    enc = encodings or {}
    out: dict[str, DataFrame] = {}
    if cards is not None:
        out["cards"] = card_features(
            cards, annual_spending, enc.get("issuer", ()), enc.get("network", ()), enc.get("currency", ())
        )
    if txns is not None:
        out["transactions"] = user_features(txns)
    if users is not None:
        out["users"] = profile_features(users)
    return out
