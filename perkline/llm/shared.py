"""Folders that driver and executors share, and what the operators do with them."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline.llm.words import forget, mix

SCAN_BYTES = 16 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of its own on a single machine where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = f"{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody has used."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that are run inside leave no shuffle files: Spark removes them when a query ends."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again, which cuts its lineage.

    The shuffles of the write are removed with its end: the table stands for them.
    """
    folder = new_folder(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def dropped(*tables: DataFrame) -> None:
    """Delete tables as ``stored`` returned them, which nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        own = shared_folder(table.sparkSession)
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            top = context._jvm.org.apache.hadoop.fs.Path(own)
            if path.getParent().toUri().getPath() != top.toUri().getPath():
                raise ValueError(f"{folder} is no table of its own in {own}")
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def partitions_for(spark: SparkSession, wanted: int) -> int:
    """``wanted`` partitions, or as many as the session shuffles into if that is more."""
    return max(wanted, int(spark.conf.get("spark.sql.shuffle.partitions")))


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving what it has freed back to the system when it is done: workers live on for the next stages.

    A worker that goes on to a stage that ``encodes`` no text lets go of its encoders and the pieces they keep.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = None if encodes else sys.modules.get("perkline.llm.tokens")
        if encoders:
            encoders.forget()
        yield from run(batches)
        forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
        if trim:
            trim(0)

    return whole


def over_text(docs: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType, max_bytes: int = 1 << 19) -> DataFrame:
    """Apply ``fn`` to Arrow slices of ``docs`` whose ``text`` has about ``max_bytes`` bytes or is one row.

    A null text arrives as null.  ``fn`` gets ``columns`` and returns a batch of ``schema``.
    Columns travel under numbers, so any name will do.
    """
    kind = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    numbers = [f"c{i}" for i in range(len(kind))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns(columns), max_bytes):
                yield fn(part).rename_columns(numbers)

    safe = T.StructType([T.StructField(n, f.dataType) for n, f in zip(numbers, kind)])
    sent = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    return sent.mapInArrow(trimmed(run), safe).toDF(*[f.name for f in kind])


def slices(batch: pa.RecordBatch, max_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut a batch where the bytes of ``column`` pass multiples of ``max_bytes``; a longer row stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and held + n > max_bytes:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < batch.num_rows:
        yield batch.slice(at)


ID_FILTER_BITS = 1 << 26


def parted(df: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """``df`` in two: rows whose ``key`` is surely not in ``ids`` (one long column), and the others.

    So a join with ``ids`` need not shuffle the first part.  A Bloom filter of a fixed 8 MB
    is put together on the executors and sent out, however many ids there are; with very
    many, all rows are in the second part, which a join has to look through in any case.
    A null key is surely not in ``ids``.
    """

    def places(values: np.ndarray) -> list[np.ndarray]:
        own = mix(values.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        return [(own >> np.uint64(s)) & np.uint64(ID_FILTER_BITS - 1) for s in (0, 32)]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(ID_FILTER_BITS // 64, np.uint64)
        for batch in batches:
            for at in places(batch.column(0).drop_null().to_numpy(zero_copy_only=False)):
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(bits[some].view(np.int64))], names=["at", "bits"])

    rows = ids.mapInArrow(trimmed(marked), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(ID_FILTER_BITS // 64, np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    sent = df.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def there(values: pd.Series) -> pd.Series:
        out = values.notna().to_numpy()
        for at in places(values.fillna(0).to_numpy()):
            out &= (sent.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return pd.Series(out)

    mark = there(F.col(key))
    return df.filter(~mark), df.filter(mark)
