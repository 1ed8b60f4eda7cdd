"""Registered queries: a Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from perkline.sources import tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


@dataclass(frozen=True)
class Tables:
    """Tables of one scale folder by name."""

    spark: SparkSession
    folder: str

    def __call__(self, table: str) -> DataFrame:
        return tables.load(self.spark, self.folder, table)

    def path(self, table: str) -> str:
        return f"{self.folder.rstrip('/')}/{table}.parquet"


def query(name: str, covers: str, sql: str | None = None, reads: str = ""):
    """Register ``fn(t)`` where ``t("table")`` loads a table of the scale folder.

    ``sql`` is the oracle body; tables named in ``reads`` are put in front as CTEs.
    """

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        oracle = tables.with_tables(sql, *reads.split()) if sql and reads else sql
        REGISTRY[name] = Query(name, run, tuple(covers.split()), oracle)
        return fn

    return register


MODULES = ["scoring_queries", "wallet_queries", "cleaning_queries", "feature_queries", "quality_queries", "fairness_queries", "monitoring_queries", "model_queries", "io_queries"]


def load_all() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"perkline.plans.{m}")
    return REGISTRY
