"""Streaming forms of the log and contract jobs; each has its batch operator as oracle.

All take and return DataFrames.  Only :func:`run_available` starts a query: it reads
everything there is, writes files, and stops.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from perkline.operators import monitoring, quality

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows of a key that are put in order at once; more go through the state store by time.
HELD_ROWS = 20_000
#: Time ranges that rows of a large key are cut into, and again where one holds too many.
RANGES = 32
#: Groups that spending keys are dealt into, for each value of the further keys, and the parts a group's state is kept in.
GROUPS, SLOTS = 512, 32


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", only: str | None = None, max_files: int = 1000) -> DataFrame:
    """New files at ``path`` (a folder or a pattern) as they arrive; ``only`` keeps matching file names."""
    r = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files)
    if only:
        r = r.option("pathGlobFilter", only)
    return r.load(path)


def daily_metrics(requests: DataFrame, ts: str, delay: str = "1 hour") -> DataFrame:
    """Request metrics per UTC day, emitted when the watermark has passed the day.

    Percentiles are approximate here; the batch report has the exact ones.
    """
    aggs = monitoring.request_aggregates()
    p = F.percentile_approx(F.when(F.col("total_ms") > 0, F.col("total_ms")), F.lit(0.95), F.lit(10000)).alias("p95_ms_approx")
    d = requests.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w")).agg(*aggs, p)
    return d.select(F.to_date("w.start").alias("day"), *[c for c in d.columns if c != "w"])


def sliding_latency(requests: DataFrame, ts: str, size: str = "1 day", step: str = "1 hour", alert_ms: float = 10000.0, delay: str = "1 hour") -> DataFrame:
    """Latency per sliding window with the alert flag on its 95th percentile."""
    d = requests.withWatermark(ts, delay).groupBy(F.window(ts, size, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("total_ms").alias("mean_ms"),
        F.max("total_ms").alias("max_ms"),
        F.percentile_approx("total_ms", F.lit(0.95), F.lit(10000)).alias("p95_ms_approx"),
    )
    return d.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "mean_ms", "max_ms", "p95_ms_approx").withColumn(
        "alert", F.col("p95_ms_approx") > alert_ms
    )


def _micros(times: pd.Series) -> np.ndarray:
    """Microseconds since 1970; a missing time comes first."""
    return times.astype("datetime64[us]").astype("int64").to_numpy()


class InOrder(StatefulProcessor):
    """Takes the rows of a key in order, a bounded number at a time, and carries a value along.

    Rows arrive in slices in no order.  A key with few is sorted in memory.  The slices of
    a larger one are cut by ranges of time and put into the state store; the ranges are
    then taken in order, and one that still holds too many is cut again.  So memory holds
    ``HELD_ROWS`` rows, or those of one instant, however many a key has.  What is held lives
    in the store for the micro-batch only; ``carry`` outlives it.
    """

    def __init__(self, columns: Sequence[str], time: str, order: Sequence[str], carry: str, most: int | None = None):
        self.columns, self.time, self.order, self.schema = list(columns), time, list(order), carry
        self.most = most or HELD_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", self.schema)
        self.held = handle.getMapState("held", "width long, range long, part long", "rows binary")

    def step(self, key: tuple, rows: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        """The output for ordered rows and the new carry; none leaves it as it is."""
        raise NotImplementedError

    def done(self, key: tuple, rows_end: object, carried: tuple | None) -> None:
        """Called after the rows of a micro-batch, to register timers."""

    def load(self) -> object:
        """What was carried out of the last micro-batch."""
        return self.carry.get() if self.carry.exists() else None

    def save(self, carried: object) -> None:
        self.carry.update(carried)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        carried, last = self.load(), None
        changed = False
        for chunk in self._ordered(rows):
            out, new = self.step(key, chunk, carried)
            if new is not None:
                carried, changed = new, True
            last = chunk
            if len(out):
                yield out
        if changed:
            self.save(carried)
        if last is not None:
            self.done(key, last, carried)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass

    def _sorted(self, frames: list[pd.DataFrame]) -> pd.DataFrame:
        return (frames[0] if len(frames) == 1 else pd.concat(frames)).sort_values(self.order, kind="stable")

    def _ordered(self, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near, rows = [], 0
        frames = (frame.set_axis(self.columns, axis=1) for frame in frames)  # some names arrive changed
        for frame in frames:
            near.append(frame)
            rows += len(frame)
            if rows > self.most:
                break
        if rows <= self.most:
            if rows:
                yield self._sorted(near)
            return
        times = np.concatenate([_micros(f[self.time]) for f in near])
        known = times[times > np.iinfo(np.int64).min]
        width = max(1, int(known.max() - known.min()) // RANGES) if len(known) else 1
        sizes: dict[int, list[int]] = {}
        for frame in near:
            self._put(frame, width, sizes)
        del near, times, known
        for frame in frames:
            self._put(frame, width, sizes)
        yield from self._take(width, sizes)

    def _put(self, frame: pd.DataFrame, width: int, sizes: dict[int, list[int]]) -> None:
        for at in range(0, len(frame), self.most):
            part = frame.iloc[at : at + self.most]
            for name, own in part.groupby(_micros(part[self.time]) // width, sort=False):
                size = sizes.setdefault(int(name), [0, 0])
                self.held.updateValue((width, int(name), size[1]), (pickle.dumps(own, protocol=5),))
                size[0] += len(own)
                size[1] += 1

    def _parts(self, width: int, name: int, parts: int) -> Iterator[pd.DataFrame]:
        for i in range(parts):
            place = (width, name, i)
            raw = self.held.getValue(place)[0]
            self.held.removeKey(place)
            yield pickle.loads(raw)

    def _take(self, width: int, sizes: dict[int, list[int]]) -> Iterator[pd.DataFrame]:
        for name in sorted(sizes):
            rows, parts = sizes[name]
            if rows <= self.most or width == 1:
                yield self._sorted(list(self._parts(width, name, parts)))
                continue
            finer, inner = max(1, width // RANGES), {}
            for part in self._parts(width, name, parts):
                self._put(part, finer, inner)
            yield from self._take(finer, inner)


class _Quiet(InOrder):
    """The first row and then each first one after a quiet time; the time of the last one is carried."""

    def __init__(self, time: str, names: Sequence[str], quiet: int, most: int | None = None):
        super().__init__(names, time, [time], "last long", most=most)
        self.quiet = quiet

    def step(self, key, rows, carried):
        times = _micros(rows[self.time])
        last, sent = (carried[0] if carried else None), []
        i = 0 if last is None else int(times.searchsorted(last + self.quiet))
        while i < len(times):
            sent.append(i)
            last = int(times[i])
            i = int(times.searchsorted(last + self.quiet))
        return rows.iloc[sent], (last,) if sent else None

    def done(self, key, rows_end, carried):
        if carried:
            self.handle.registerTimer(-(-(carried[0] + self.quiet) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        # Rows before the watermark come no more, so from here on the next alert is sent anyway.
        if self.carry.exists() and self.carry.get()[0] + self.quiet <= timerValues.getCurrentWatermarkInMs() * 1000:
            self.carry.clear()
        return iter(())


def dedupe_alerts(
    alerts: DataFrame, ts: str, keys: Sequence[str] = ("severity", "message"), quiet_seconds: int = 3600, delay: str = "1 hour", most: int | None = None
) -> DataFrame:
    """The first alert of each kind; repeats stay silent until the time from it has passed.

    Spark's own deduplication within a watermark may drop an alert that comes after
    the quiet time, because it looks at the watermark and not at the first alert.  So
    the time of the last alert sent is kept as state, one number per kind, until the
    watermark has passed its quiet time.  Alerts later than ``delay`` are dropped.
    """
    step = _Quiet(ts, alerts.columns, int(quiet_seconds * 1_000_000), most)
    return alerts.withWatermark(ts, delay).groupBy(*keys).transformWithStateInPandas(step, alerts.schema, "Append", "EventTime")


def contract_split(rows: DataFrame, reasons: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a stream; the batch function is stateless."""
    return quality.split_rows(rows, reasons)


class _Spend(InOrder):
    """Spend before each row of a bucket, in whole cents; the spend so far is carried until the bucket's end.

    A group has the buckets of many names, because a call of the state store per bucket
    costs more than its rows.  What they have spent is kept in ``SLOTS`` parts, of which a
    micro-batch reads and writes those whose names it has; ``carry`` lists the parts there are.
    """

    def __init__(self, columns: Sequence[str], order: Sequence[str], keys: Sequence[str], kept: Sequence[str], until: str | None, most: int | None):
        super().__init__(columns, order[0], order, "slots array<long>", most)
        self.keys, self.kept, self.until = list(keys), list(kept), until

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.spent = handle.getMapState("spent", "slot long", "names array<string>, cents array<long>, ends array<long>")

    def load(self) -> dict[int, dict]:
        self.there = set(self.carry.get()[0]) if self.carry.exists() else set()
        return {}  # filled as names come

    def save(self, carried: dict[int, dict]) -> None:
        for slot, own in carried.items():
            self._write(slot, own)
        if not self.there.issuperset(carried):
            self.carry.update((sorted(self.there.union(carried)),))

    def _write(self, slot: int, own: dict[str | None, tuple[int, int]]) -> None:
        self.spent.updateValue((slot,), (list(own), [cents for cents, _ in own.values()], [end for _, end in own.values()]))

    def _slot(self, name: str | None, carried: dict[int, dict]) -> dict[str | None, tuple[int, int]]:
        slot = zlib.crc32((name or "").encode()) % SLOTS
        if slot not in carried:
            carried[slot] = self._read(slot) if slot in self.there else {}
        return carried[slot]

    def _read(self, slot: int) -> dict[str | None, tuple[int, int]]:
        names, cents, ends = self.spent.getValue((slot,))
        return dict(zip(names, zip(cents, ends)))

    def step(self, key, rows, carried):
        cents = (rows["__amount"].clip(lower=0).fillna(0.0) * 100).round().astype("int64")
        codes, found = pd.factorize(rows["__name"], use_na_sentinel=False)
        names = [None if pd.isna(name) else str(name) for name in found]
        slots = [self._slot(name, carried) for name in names]
        spent = np.array([own.get(name, (0, 0))[0] for own, name in zip(slots, names)], np.int64)
        by_name = cents.groupby(codes, sort=True)
        out = rows[self.kept].copy()
        for name, value in zip(self.keys[1:], key[1:]):
            out[name] = value
        out[self.keys[0]] = rows["__name"]
        out["spent_before"] = (by_name.cumsum() - cents + spent[codes]) / 100.0
        never = np.iinfo(np.int64).min
        ends = np.full(len(names), never)
        if self.until:
            ends[codes] = _micros(rows[self.until])
        for own, name, total, end in zip(slots, names, spent + by_name.sum().to_numpy(), ends):
            own[name] = (int(total), int(-(-end // 1000)) if end > never else never)
        return out, carried

    def done(self, key, rows_end, carried):
        if self.until:
            for end in {end for own in carried.values() for _, end in own.values()} - {int(np.iinfo(np.int64).min)}:
                self.handle.registerTimer(end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, never = expiredTimerInfo.getExpiryTimeInMs(), np.iinfo(np.int64).min
        self.load()
        left = []
        for slot in sorted(self.there):
            held = self._read(slot)
            still = {name: (cents, end) for name, (cents, end) in held.items() if end > now or end == never}
            if not still:
                self.spent.removeKey((slot,))
                continue
            left.append(slot)
            if len(still) < len(held):
                self._write(slot, still)
        if left:
            self.carry.update((left,))
        else:
            self.carry.clear()
        return iter(())


def spend_before(
    purchases: DataFrame, keys: Sequence[str], order: Sequence[str], amount: str, kept: Sequence[str], schema: str,
    until: str | None = None, delay: str = "1 hour", most: int | None = None,
) -> DataFrame:
    """Spend of a bucket before each purchase, carried across micro-batches as state.

    The first of ``keys``, a plain value, is the one with many values, as the user is; those
    are dealt into ``GROUPS`` groups that are taken as one.  The first of ``order`` is the
    time.  The reset period belongs into ``keys``; ``until`` names the column with its end,
    and a bucket's state goes when the watermark has passed that; purchases later than
    ``delay`` are dropped then.  Without it a bucket counts forever.
    """
    # As text the name keeps its digits and its nulls in pandas.
    text = F.col(keys[0]).cast("string")
    d = purchases.withColumns({"__amount": F.col(amount).cast("double"), "__name": text, "__group": F.pmod(F.xxhash64(text), F.lit(GROUPS))})
    if until:
        d = d.withWatermark(order[0], delay)
    step = _Spend(d.columns, order, keys, kept, until, most)
    mode = "EventTime" if until else "None"
    fields = T.StructType.fromDDL(schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name == keys[0] else f for f in fields])
    out = d.groupBy("__group", *keys[1:]).transformWithStateInPandas(step, texts, "Append", mode)
    return out.select(*[F.col(f.name).cast(f.dataType) if f.name == keys[0] else f.name for f in fields])


def run_available(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Process all available input into Parquet files and return them as a table.

    Waits until everything is processed, however long that takes; a failure raises.  State
    is kept in RocksDB, so it need not fit into memory.
    """
    conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, ROCKSDB)
    w = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    try:
        q = w.trigger(availableNow=True).start()
    finally:
        conf.set(name, before) if before else conf.unset(name)
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.read.schema(df.schema).parquet(path)
