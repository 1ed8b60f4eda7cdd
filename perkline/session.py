"""Session settings shared by the tests, the bench and ad-hoc jobs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "perkline", cores: int | None = None) -> SparkSession:
    """A local session with the settings a cluster submit would also carry.

    On a cluster the master and memory come from spark-submit; only the SQL
    settings below matter there.  Shuffle partitions are a starting point, adaptive
    execution merges small ones and splits skewed ones at run time.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PERKLINE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        .getOrCreate()
    )

