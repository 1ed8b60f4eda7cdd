"""Writers: feature tables, logs, exports, snapshots, fingerprints and run audits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    A session on one machine that has no such folder gets one; elsewhere the setting must
    be there.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        shared = f"{tempfile.gettempdir()}/checkpoints"
    return f"{shared.rstrip('/')}/perkline-{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Overwrite a folder; the committer's ``_SUCCESS`` file marks it complete."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_run(tables: Mapping[str, DataFrame], base: str, run_id: str) -> dict[str, str]:
    """One folder per table, partitioned by run; writing a run again replaces that run."""
    out = {}
    for name, df in tables.items():
        path = f"{base}/{name}"
        (
            df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("run_id").parquet(path)
        )
        out[name] = path
    return out


def append_logs(df: DataFrame, base: str, ts: str = "timestamp") -> str:
    """Append JSON log records below their UTC day."""
    day = F.to_date(F.try_to_timestamp(F.col(ts).cast("string")))
    df.withColumn("dt", day).write.mode("append").partitionBy("dt").json(base)
    return base


def write_export(df: DataFrame, path: str) -> str:
    """CSV export with a header, nulls as empty text."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return path


def append_snapshot(stats: DataFrame, path: str, name: str, ts: str) -> str:
    """Add one statistics snapshot to a history table."""
    stats.select(F.lit(name).alias("dataset"), F.lit(ts).cast("timestamp").alias("ts"), "*").write.mode("append").parquet(path)
    return path


def write_report(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").json(path)
    return path


def _hashable(df: DataFrame):
    cols = []
    for f in sorted(df.schema.fields, key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.MapType, T.VariantType)) or "map<" in f.dataType.simpleString():
            c = F.to_json(c)
        cols.append(c)
    return cols


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: row count and a hash of the contents, whatever the row order."""
    h = F.xxhash64(*_hashable(df))
    d = df.agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x")
    )
    text = F.concat_ws("|", F.lit(",".join(sorted(df.columns))), F.col("rows").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))
    return d.select("rows", F.sha2(text, 256).alias("fingerprint"))


def run_audit(steps: Mapping[str, DataFrame], run_id: str, config_text: str, reused: Sequence[str] = ()) -> DataFrame:
    """Rows, width, fingerprint and reuse flag of every step of a run."""
    out = None
    for name, df in steps.items():
        row = fingerprint(df).select(
            F.lit(run_id).alias("run_id"), F.lit(name).alias("step"), "rows", F.lit(len(df.columns)).alias("columns"), "fingerprint",
            F.lit(name in reused).alias("used_checkpoint"), F.sha2(F.lit(config_text), 256).alias("config_hash"),
        )
        out = row if out is None else out.unionByName(row)
    return out
