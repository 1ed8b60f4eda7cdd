"""File sources: feeds, offers, request logs, manifests, latest snapshots."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline.sources import json_arrays

LOG_SCHEMA = (
    "timestamp string, request_id string, user_hash string, "
    "input_features struct<spending_categories:map<string,double>,monthly_spend:double,preferred_rewards:array<string>,transaction_history_count:int>, "
    "predicted_scores array<struct<card_name:string,rank:int,deterministic_score:double,personalization_score:double,blended_score:double>>, "
    "top_card string, model_version string, latency_breakdown_ms map<string,double>, is_personalized boolean, "
    "explanation_latency_ms double, recommendation_flow string, request_status string"
)
CORRUPT = "_corrupt_record"


def optional(read) -> DataFrame | None:
    """The frame, or None where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """CSV with a header and a declared schema; a missing file is an absent table."""
    return optional(lambda: spark.read.csv(path, header=True, schema=schema, nullValue=""))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns."""
    def walk(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return df.select(*walk(df.schema, ()))


def read_offers(spark: SparkSession, path: str, schema: str | T.StructType | None = None, lines: bool = False) -> DataFrame | None:
    """Offers from ``{"offers": [...]}`` or a bare list, nested keys as dotted columns.

    A payload object has no card name of its own, which tells the two shapes apart.  With
    ``lines`` every line is a payload or an offer, so large files are split between tasks.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    df = optional(lambda: reader.json(path))
    if df is None:
        return None
    if "offers" in df.columns and not {"name", "card_name", "title"} & set(df.columns):
        df = df.select(F.explode("offers").alias("s")).select("s.*")
    return flatten(df)


def read_offer_arrays(spark: SparkSession, path: str, schema: str | T.StructType, key: str = "offers", slice_bytes: int | None = None) -> DataFrame:
    """Offers from array files too large for one task, bare lists or ``{"offers": [...]}``.

    Files are cut into slices that many tasks read, see :mod:`perkline.sources.json_arrays`;
    nested keys become dotted columns.  Records that don't parse give null fields.
    """
    found = json_arrays.records(spark, path, key, slice_bytes)
    return flatten(found.select(F.from_json("record", schema).alias("s")).select("s.*"))


def read_feeds(spark: SparkSession, paths: Mapping[str, str], lines: bool = False) -> DataFrame | None:
    """All feeds in one frame, rows without a source tagged with the feed's name."""
    out = None
    for name, path in paths.items():
        df = read_offers(spark, path, lines=lines)
        if df is None:
            continue
        tag = F.coalesce(F.col("source"), F.lit(name)) if "source" in df.columns else F.lit(name)
        df = df.withColumn("source", tag)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_logs(spark: SparkSession, base: str, start: str, end: str, schema: str = LOG_SCHEMA) -> DataFrame:
    """Request logs of a date range; only the ``dt`` folders in range are listed and read.

    Unreadable lines are dropped.
    """
    df = (
        spark.read.schema(f"{schema}, {CORRUPT} string, dt date")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(base)
    )
    kept = df.where(F.col("dt").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    # Spark refuses a scan that needs the corrupt column alone, as in a bare count; the
    # second condition always holds and keeps one data column in the scan.
    parsed = F.coalesce("request_id", "timestamp", F.lit("")) >= ""
    return kept.where(F.col(CORRUPT).isNull() & parsed).drop(CORRUPT)


SLICE_BYTES = 8 << 20


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and sha256 of every file below a folder, in path order.

    Files are listed without their content and read in slices inside the tasks, so their
    size doesn't matter.  Spark's listing leaves out files of no bytes.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"))

    def digests(batches):
        from pyarrow import fs

        for batch in batches:
            found = []
            for place in batch.column(0).to_pylist():
                system, name = fs.FileSystem.from_uri(re.sub("^file:/+", "/", place))
                digest = hashlib.sha256()
                with system.open_input_stream(name, compression=None) as file:
                    while data := file.read(SLICE_BYTES):
                        digest.update(data)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["path", "bytes", "sha256"])

    spread = listed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(digests, "path string, bytes long, sha256 string").orderBy("path")


def latest_run(runs: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The newest run (of each group), its final output before its checkpoint."""
    best = F.max(F.struct("run_id", (F.col("stage") == "final").alias("is_final"), "stage"))
    return runs.groupBy(*groups).agg(best.alias("b")).select(*groups, "b.run_id", "b.stage")


def latest_snapshot(snapshots: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows of the newest run of a table partitioned by run; other partitions are not read."""
    newest = snapshots.agg(F.max(run)).scalar()
    return snapshots.where(F.col(run) == newest)
