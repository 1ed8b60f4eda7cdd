"""Order-aware building blocks that stay parallel when one key is very large.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  When one user
holds a third of all transactions that task never ends.  The helpers below cut a
key into ordered chunks, do the work per (key, chunk), and carry a small summary
per chunk across the chunk boundary.  The summaries are bounded by the number of
chunks, never by the number of rows.  Results are exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALL = "__all__"
#: Values that one chunk should hold, and the most chunks that values are cut into.
CHUNK_VALUES, MOST_CHUNKS = 50_000, 4096
#: Texts have no sketch: so many rows drawn by hash stand for them, and are cut into fewer chunks.
DRAWN, DRAWN_PER_CHUNK = 16_384, 16
_SKETCHED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def range_chunk(df: DataFrame, value: str, out: str, chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """``df`` with ``out``: an integer that never decreases as ``value`` grows, null for null.

    Bounds are quantiles of the rows of ``df``, whatever their scale or offset, and their
    number follows from the number of rows, so a chunk holds about ``chunk_values`` of
    them.  Numbers and times go through a quantile sketch, which combines map-side and asks
    for nothing that ``df`` doesn't have, so where ``df`` is an aggregate its shuffle is
    used twice and its input is read once.  A row finds its chunk by halving.
    """
    if isinstance(df.schema[value].dataType, _SKETCHED):
        places = np.arange(1, MOST_CHUNKS) / MOST_CHUNKS
        # The other columns are named so that this reads the same shuffled rows as the rest of the plan.
        sums = [F.max(c).alias(c) for c in df.columns if c != value and isinstance(df.schema[c].dataType, T.NumericType)]
        sketch = df.agg(F.percentile_approx(value, F.lit(places), F.lit(4 * MOST_CHUNKS)).alias("__p"), F.count(value).alias("__rows"), *sums)
        chunks = F.least(F.lit(MOST_CHUNKS), F.ceil(F.col("__rows") / chunk_values)).cast("int")
        step = F.lit(float(MOST_CHUNKS)) / chunks
        cuts = F.transform(F.sequence(F.lit(1), chunks - 1), lambda i: F.get("__p", (i * step).cast("int") - 1))
        every = sketch.select(F.when(chunks > 1, cuts).otherwise(F.array().cast(T.ArrayType(df.schema[value].dataType))).alias("b"))
        most = MOST_CHUNKS
    else:
        drawn = df.where(F.col(value).isNotNull()).select(F.col(value).alias("__s"), F.xxhash64(*[c for c in df.columns if "map<" not in df.schema[c].dataType.simpleString()]).alias("__h"))
        drawn = drawn.orderBy("__h", "__s").limit(DRAWN)
        every = drawn.agg(F.sort_array(F.collect_list("__s")).alias("b")).select(F.filter("b", lambda x, i: (i > 0) & (i % DRAWN_PER_CHUNK == 0)).alias("b"))
        most = DRAWN // DRAWN_PER_CHUNK
    steps = F.lit(np.array([1 << k for k in range(most.bit_length())][::-1], dtype=np.int32))
    place = F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.get("__bounds", at + s - 1) <= F.col(value), at + s).otherwise(at))
    return df.withColumn("__bounds", every.scalar()).withColumn(out, F.when(F.col(value).isNotNull(), place)).drop("__bounds")


def _keys(df: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if groups:
        return df, list(groups)
    return df.withColumn(_ALL, F.lit(0)), [_ALL]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that treats a null key as a value, keeping the left key columns."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(r[f"__r_{k}"])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def mark_large(df: DataFrame, keys: Sequence[str], out: str, most: int = CHUNK_VALUES) -> DataFrame:
    """``df`` with ``out``: true for keys with more than ``most`` rows, else null.

    There are at most a ``most``-th as many such keys as rows, so they go to every task.
    """
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > most).select(*keys, F.lit(True).alias(out))
    return null_safe_join(df, F.broadcast(large), keys, "left")


def pick_ranks(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Mapping[str, "callable"],
    chunk_values: int = CHUNK_VALUES,
    many: bool = False,
) -> DataFrame:
    """Exact order statistics: one column per entry of ``ranks``.

    Each entry maps the non-null count ``n`` to a 0-based position in sorted order.
    Rows are first reduced to (group, value, count), so the shuffle carries distinct
    values only and a hot group spreads over its values.  The bucket that holds each
    position is found from per-bucket counts, and only those buckets are sorted.

    ``many`` is for a table of many groups, read once more for their sizes: a group of at
    most ``chunk_values`` rows is sorted in one piece, and only larger ones go this way.
    """
    if many:
        d = mark_large(df, groups, "__large", chunk_values).withColumn("__v", F.col(value).cast("double") + 0.0)
        d = d.where(F.col("__v").isNotNull() & ~F.isnan("__v")).select(*groups, "__v", "__large")
        inside, total = W.partitionBy(*groups), F.col("n_values")
        small = d.where(F.col("__large").isNull()).withColumn("__i", F.row_number().over(inside.orderBy("__v")).cast("long") - 1)
        small = small.withColumn("n_values", F.count(F.lit(1)).over(inside))
        picked = [F.max(F.when(F.col("__i") == fn(total).cast("long"), F.col("__v"))).alias(name) for name, fn in ranks.items()]
        small = small.groupBy(*groups).agg(F.max("n_values").alias("n_values"), *picked)
        return small.unionByName(pick_ranks(d.where("__large").drop("__large"), groups, "__v", ranks, chunk_values))
    df, keys = _keys(df, groups)
    counts = (
        df.withColumn("__v", F.col(value).cast("double"))
        .where(F.col("__v").isNotNull() & ~F.isnan("__v"))
        .groupBy(*keys, "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    counts = range_chunk(counts, "__v", "__b", chunk_values)
    per_bucket = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__bn"))
    over = W.partitionBy(*keys).orderBy("__b")
    placed = per_bucket.withColumn(
        "__before",
        F.coalesce(F.sum("__bn").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("__total", F.sum("__bn").over(W.partitionBy(*keys)))
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), fn(F.col("__total")).cast("long").alias("pos"))
            for name, fn in ranks.items()
        ]
    )
    targets = (
        placed.withColumn("__t", F.explode(wanted))
        .where((F.col("__t.pos") >= F.col("__before")) & (F.col("__t.pos") < F.col("__before") + F.col("__bn")))
        .select(*keys, "__b", "__before", "__total", F.col("__t.name").alias("__name"), F.col("__t.pos").alias("__pos"))
    )
    inside = null_safe_join(counts, targets, [*keys, "__b"])
    run = W.partitionBy(*keys, "__b", "__name").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    hit = (
        inside.withColumn("__upto", F.col("__before") + F.sum("__n").over(run))
        .where((F.col("__pos") < F.col("__upto")) & (F.col("__pos") >= F.col("__upto") - F.col("__n")))
    )
    out = hit.groupBy(*keys).agg(
        F.max("__total").alias("n_values"),
        *[F.max(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in ranks],
    )
    return out.drop(_ALL)


def quantiles(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    many: bool = False,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group; ``many`` as in pick_ranks."""

    def at(p: float, up: bool):
        def position(n: Column) -> Column:
            h = F.lit(float(p)) * (n - 1)
            return F.ceil(h) if up else F.floor(h)

        return position

    ranks = {}
    for name, p in probs.items():
        ranks[f"{name}__lo"] = at(p, False)
        ranks[f"{name}__hi"] = at(p, True)
    found = pick_ranks(df, groups, value, ranks, many=many)
    cols = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n_values") - 1)
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        cols.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return found.select(*groups, "n_values", *cols)


def running_before(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    value: Column,
    out: str,
    within: str | None = None,
    chunk_values: int = CHUNK_VALUES,
    many: bool = False,
) -> DataFrame:
    """Sum of ``value`` over the rows before this one within its key.

    ``chunk`` must not decrease along ``order``; for time-ordered rows it is a
    calendar bucket.  ``within`` names the column that comes next in ``order``: chunks are
    cut again by ranges of it that hold equally many rows of all, so no part of a chunk has
    more than its share of the table, even if one key has all its rows on one day.

    ``many`` is for a table of many keys, which is then read several times: a key of at most
    ``chunk_values`` rows is summed in one piece, and only larger ones are cut.
    """
    if many:
        d = mark_large(df, keys, "__large", chunk_values)
        before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        small = d.where(F.col("__large").isNull()).drop("__large").withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
        return small.unionByName(running_before(d.where("__large").drop("__large"), keys, chunk, order, value, out, within, chunk_values))
    d = df.withColumn("__chunk", chunk)
    if within:
        d = range_chunk(d, within, "__part", chunk_values).withColumn("__chunk", F.struct(F.col("__chunk").alias("a"), F.col("__part").alias("b"))).drop("__part")
    d = d.withColumn("__val", value)
    part = [*keys, "__chunk"]
    local = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*part).agg(F.sum("__val").alias("__sum"))
    carried = totals.withColumn(
        "__carry",
        F.coalesce(
            F.sum("__sum").over(W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("__sum")
    d = d.withColumn("__local", F.coalesce(F.sum("__val").over(local), F.lit(0)))
    return (
        null_safe_join(d, carried, part, "left")
        .withColumn(out, F.col("__carry") + F.col("__local"))
        .drop("__chunk", "__val", "__local", "__carry")
    )


def row_index(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    out: str,
    within: str | None = None,
    chunk_values: int = CHUNK_VALUES,
) -> DataFrame:
    """1-based position of each row within its key, the distributed ``row_number``; ``within`` as in running_before."""
    d, ks = _keys(df, keys)
    return running_before(d, ks, chunk, order, F.lit(1).cast("long"), out, within, chunk_values).withColumn(out, F.col(out) + 1).drop(_ALL)


def hash_chunk(h: Column, bits: int = 20) -> Column:
    """Leading bits of a 64-bit hash: an even, order-keeping chunk for hash order.

    A million chunks per group at most, so a task sorts a millionth of a group; a small
    group has no more chunks than rows.
    """
    return F.shiftright(h, 64 - bits)


def change_counts(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column],
    value: str,
    chunk_values: int = CHUNK_VALUES,
    many: bool = False,
) -> DataFrame:
    """Per key: row count and how often ``value`` differs from the row before it.

    ``many`` is for a table of many keys, read once more for their sizes: only large keys are cut.
    """
    d = df.withColumn("__chunk", chunk)
    if many:
        d = mark_large(df, keys, "__large", chunk_values).withColumn("__chunk", F.when(F.col("__large"), chunk)).drop("__large")
    part = W.partitionBy(*keys, "__chunk").orderBy(*order)
    place = F.struct(*order)
    d = d.withColumn("__prev", F.lag(value).over(part)).withColumn("__rn", F.row_number().over(part))
    per_chunk = d.groupBy(*keys, "__chunk").agg(
        F.count(F.lit(1)).alias("__n"),
        F.sum(((F.col("__rn") > 1) & ~F.col("__prev").eqNullSafe(F.col(value))).cast("long")).alias("__inner"),
        F.min_by(F.col(value), place).alias("__first"),
        F.max_by(F.col(value), place).alias("__last"),
    )
    w = W.partitionBy(*keys).orderBy("__chunk")
    seam = per_chunk.withColumn("__before", F.lag("__last").over(w)).withColumn("__i", F.row_number().over(w))
    return seam.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"),
        F.sum(
            F.col("__inner")
            + ((F.col("__i") > 1) & ~F.col("__before").eqNullSafe(F.col("__first"))).cast("long")
        ).alias("n_changes"),
    )


def mark_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """1 for every row of a key but the earliest, with null keys equal to each other.

    The earliest place per key is an aggregate joined back on the key.  A window would
    sort a hot key in one task; the join lets adaptive execution split it.
    """
    place = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    d = df.withColumn("__place", place)
    firsts = d.groupBy(*keys).agg(F.min("__place").alias("__first"))
    return (
        null_safe_join(d, firsts, keys)
        .withColumn(out, (F.col("__place") != F.col("__first")).cast("int"))
        .drop("__place", "__first")
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the earliest by ``order``.

    An aggregate instead of a row-number filter: each task keeps one row per key
    before the shuffle, so copies of a hot key never travel.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min(F.struct(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__ord"), *[F.col(c) for c in rest]))
    if _has_map(df, rest):
        best = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
        return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(
        *df.columns
    )


def _has_map(df: DataFrame, cols: Sequence[str]) -> bool:
    return any("map<" in df.schema[c].dataType.simpleString() for c in cols)


def cumulative(counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], chunk_values: int = CHUNK_VALUES) -> DataFrame:
    """Running totals of ``sums`` up to and including each value, per key.

    ``counts`` has one row per (key, value).  Adds ``cum_<name>`` and ``all_<name>``.
    """
    d, ks = _keys(counts, keys)
    d = range_chunk(d, value, "__b", chunk_values)
    local = W.partitionBy(*ks, "__b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    over = W.partitionBy(*ks).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    per = d.groupBy(*ks, "__b").agg(*[F.sum(s).alias(f"__s_{s}") for s in sums])
    per = per.select(
        *ks,
        "__b",
        *[F.coalesce(F.sum(f"__s_{s}").over(over), F.lit(0)).alias(f"__c_{s}") for s in sums],
        *[F.sum(f"__s_{s}").over(W.partitionBy(*ks)).alias(f"all_{s}") for s in sums],
    )
    for s in sums:
        d = d.withColumn(f"__l_{s}", F.sum(s).over(local))
    d = null_safe_join(d, per, [*ks, "__b"])
    for s in sums:
        d = d.withColumn(f"cum_{s}", F.col(f"__c_{s}") + F.col(f"__l_{s}")).drop(f"__c_{s}", f"__l_{s}")
    return d.drop("__b", _ALL)


def average_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, rank) with equal values sharing the mean of their positions."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    c = cumulative(counts, [], value, ["__n"])
    return c.select(value, (F.col("cum___n") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out))
