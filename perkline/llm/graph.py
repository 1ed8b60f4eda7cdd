"""Connected components of a graph that no task holds whole."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perkline.llm import shared


def least_reached(a: np.ndarray, b: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For each of ``nodes`` the smallest node that links (places ``a``, ``b`` in ``nodes``) reach, inside one task."""
    least = nodes.copy()
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        np.minimum.at(least, a, low)
        np.minimum.at(least, b, low)
        if (least == before).all():
            return least


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node that links reach) for every node of ``edges`` (a, b).

    Alternating large and small stars: each node points its larger, then its smaller
    neighbours to the smallest one it knows, until every node points at its component.
    Rounds grow with the logarithm of the nodes; each is stored in the shared folder.
    Minima are taken with partial aggregates and a node of many links only meets them in
    joins, which adaptive execution splits.
    """
    now = shared.stored(_tidy(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "stars")
    while not _all_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a")
        stars = moved.filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.withColumnRenamed("m", "b"))
        before, now = now, shared.stored(_tidy(stars), "stars")
        shared.dropped(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("a") != F.col("b")).groupBy("a", "b").agg(F.lit(1).alias("one")).drop("one")


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and no neighbour both ways."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()
