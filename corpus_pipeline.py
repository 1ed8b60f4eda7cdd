"""The training-data pipeline: five stages over ``documents``, each written and read again.

Quality classifier, language identification, one document of each group of near
duplicates, removal of repeated passages, and packing into sequences of 2048 tokens.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from perkline.llm import byte_cnn, jaccard_join, language_masks, packing, repeats, shared

#: A trained classifier and float scores are beyond SQL.  The test holds run() against its stages one by one; no stage
#: is held against plain Python there.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on the labelled ones among ``docs``, finds good."""
    return byte_cnn.kept(docs, byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are clearly in one of the languages of ``docs``."""
    return language_masks.kept(docs, language_masks.learned(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return jaccard_join.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; emptied ones go."""
    return repeats.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    pieces = shared.stored(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json")), "pieces")
    return packing.packed(pieces).drop("copy")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("packed", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is stored and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
