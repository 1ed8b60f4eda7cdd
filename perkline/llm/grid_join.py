"""Near-duplicate vectors by an epsilon grid order join.

Vectors of equal label and length are brought to length one, turned to the principal axes
of all vectors, and sorted by the grid cells (side: the largest distance of a link) of
their leading coordinates.  The sorted sequence is cut into blocks.  Intervals of blocks
are joined recursively: a pair of intervals whose bounding boxes are further apart than a
link can be is dropped, and the rest is taken apart until single blocks meet.  Two blocks
are compared by one matrix product in double precision.

Equal vectors of one label are one class and are not compared with each other.  A block
pair gives, per vector, how many it links with and the smallest vector it is connected
with there, so a dense group gives no row per link.

Null label, null or empty vectors, zero vectors and vectors with a null or non-finite
component link with nothing and are components of their own.  Rows that repeat a vec_id
are vectors of their own and get the same results.  An empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.llm import graph, shared

COSINE = 0.93
AXES, BLOCK, FANOUT = 6, 1024, 16
_SLACK = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that neither very large nor very small ones overflow."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def classes(vectors: DataFrame) -> DataFrame:
    """label, size, embedding, rep (smallest vec_id), copies for all vectors that can link."""
    fine = vectors.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    fine = fine.filter(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0))
    return fine.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("embedding"))


def axes(found: DataFrame, count: int = AXES) -> dict[int, np.ndarray]:
    """Leading principal axes of the unit vectors of each length, from sums over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                x = unit(_matrix(batch.column(0).filter(pa.array(sizes == size)), size))
                x = np.hstack([x, np.ones((len(x), 1))])
                sums[size] = sums.get(size, 0) + x.T @ x
        for size, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([own.ravel().tolist()], pa.list_(pa.float64()))], names=["size", "sums"])

    parts = found.select("embedding", "size").mapInArrow(run, "size int, sums array<double>").select("size", F.posexplode("sums").alias("at", "value"))
    total: dict[int, np.ndarray] = {}
    for r in parts.groupBy("size", "at").agg(F.sum("value").alias("value")).collect():  # (size + 1) squared numbers per length
        total.setdefault(r["size"], np.zeros((r["size"] + 1) ** 2))[r["at"]] = r["value"]
    out = {}
    for size, flat in total.items():
        m = flat.reshape(size + 1, size + 1)
        mean = m[:-1, -1] / m[-1, -1]
        _, turned = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        out[size] = turned[:, ::-1][:, :count]
    return out


def blocks(found: DataFrame, turn: dict[int, np.ndarray], side: float, block: int = BLOCK) -> DataFrame:
    """Blocks of the sequence sorted by grid cells: label, size, part, at, low, high, reps, copies, vectors."""
    width = max((a.shape[1] for a in turn.values()), default=1)

    def placed(batch: pa.RecordBatch) -> np.ndarray:
        sizes = batch.column("size").to_numpy(zero_copy_only=False)
        out = np.zeros((len(sizes), width))
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            y = unit(_matrix(batch.column("embedding").take(pa.array(own)), size)) @ turn[size]
            out[own, : y.shape[1]] = y
        return out

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grid = np.floor(placed(batch) / side).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(grid[:, k]) for k in range(width)]], names=[*batch.schema.names, *names])

    names = [f"c{k}" for k in range(width)]
    order = ["label", "size", *names, "rep"]
    schema = "label int, size int, rep long, copies long, embedding array<float>, " + ", ".join(f"{c} int" for c in names)
    celled = found.select(F.col("label").cast("int"), "size", "rep", "copies", F.col("embedding").cast("array<float>")).mapInArrow(cells, schema)
    sequence = celled.repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def out(rows: pa.Table):
            nonlocal at
            own = rows.combine_chunks().to_batches()[0]
            y, size = placed(own), own.column("size")[0].as_py()
            vectors = _matrix(own.column("embedding"), size).astype("<f4").tobytes()
            values = [own.column("label")[0].as_py(), size, part, at, (y.min(0) - _SLACK).tolist(), (y.max(0) + _SLACK).tolist(), own.column("rep").to_pylist(), own.column("copies").to_pylist(), vectors]
            at += 1
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["label", "size", "part", "at", "low", "high", "reps", "copies", "vectors"])

        def key(batch, i):
            return batch.column("label")[i].as_py(), batch.column("size")[i].as_py()

        for batch in batches:
            label, size = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "size"))
            edges = np.flatnonzero((label[1:] != label[:-1]) | (size[1:] != size[:-1])) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if held and key(held[-1], 0) != key(batch, a):
                    yield out(pa.Table.from_batches(held))
                    held = []
                while a < b:
                    room = block - sum(x.num_rows for x in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += held[-1].num_rows
                    if sum(x.num_rows for x in held) == block:
                        yield out(pa.Table.from_batches(held))
                        held = []
        if held:
            yield out(pa.Table.from_batches(held))

    return sequence.mapInArrow(cut, "label int, size int, part int, at long, low array<double>, high array<double>, reps array<long>, copies array<long>, vectors binary")


def near_blocks(meta: DataFrame, reach: float, fanout: int = FANOUT) -> DataFrame:
    """label, size, x, y (numbers of blocks, x <= y) for blocks whose boxes are within ``reach``.

    ``meta`` has label, size, n (number in sequence), low, high.  Starts with at most
    ``fanout`` intervals per label and takes near pairs apart, level by level.
    """
    last = meta.agg(F.max("n")).first()[0] or 0
    levels = 1
    while fanout**levels <= last:
        levels += 1

    def nodes(level: int) -> DataFrame:
        step = fanout**level
        width = F.size("low")
        down = meta.select("label", "size", F.floor(F.col("n") / step).cast("long").alias("n"), "low", "high")
        if level == 0:
            return down
        flat = down.select("label", "size", "n", F.posexplode(F.arrays_zip("low", "high")).alias("k", "b"))
        per = flat.groupBy("label", "size", "n", "k").agg(F.min("b.low").alias("l"), F.max("b.high").alias("h"))
        box = per.groupBy("label", "size", "n").agg(F.sort_array(F.collect_list(F.struct("k", "l", "h"))).alias("box"))
        return box.select("label", "size", "n", F.col("box.l").alias("low"), F.col("box.h").alias("high"))

    def near(pairs: DataFrame) -> DataFrame:
        gap = F.zip_with(F.zip_with("x_low", "y_high", lambda a, b: a - b), F.zip_with("y_low", "x_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b, F.lit(0.0)))
        return pairs.filter((F.col("x") <= F.col("y")) & (F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g) <= reach * reach)).select("label", "size", "x", "y")

    def side(level: int, which: str) -> DataFrame:
        own = nodes(level)
        return own.select("label", "size", F.col("n").alias(which), F.floor(F.col("n") / fanout).cast("long").alias(f"{which}_up"), F.col("low").alias(f"{which}_low"), F.col("high").alias(f"{which}_high"))

    pairs = near(side(levels - 1, "x").join(side(levels - 1, "y"), ["label", "size"]))
    for level in range(levels - 2, -1, -1):
        up = shared.stored(pairs.withColumnsRenamed({"x": "x_up", "y": "y_up"}), "near-intervals")
        pairs = near(up.join(side(level, "x"), ["label", "size", "x_up"]).join(side(level, "y"), ["label", "size", "y_up"]))
    return pairs


def _joined(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size = row["size"]
            x, y = (unit(np.frombuffer(row[f"{s}_vectors"], "<f4").reshape(-1, size)) for s in "xy")
            same = row["x"] == row["y"]
            hit = x @ y.T >= cosine
            if same:
                hit = np.triu(hit, 1)
            a, b = np.nonzero(hit)
            if not len(a):
                continue
            reps = np.array(row["x_reps"] if same else row["x_reps"] + row["y_reps"], np.int64)
            copies = np.array(row["x_copies"] if same else row["x_copies"] + row["y_copies"], np.int64)
            if not same:
                b = b + len(x)
            links = np.bincount(a, copies[b], len(reps)) + np.bincount(b, copies[a], len(reps))
            least = graph.least_reached(a, b, reps)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(links[some].astype(np.int64)), pa.array(least[some])], names=["rep", "links", "least"])


def links(found: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """rep, links, least per vector and block pair: partners (copies counted) and the smallest vector reached there."""
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    cut = shared.stored(blocks(found, axes(found), reach, block), "grid-blocks")
    numbered = W.partitionBy("label", "size").orderBy("part", "at")
    meta = shared.stored(cut.select("label", "size", "part", "at", "low", "high").withColumn("n", F.row_number().over(numbered).cast("long") - 1), "grid-boxes")
    data = cut.join(meta.select("label", "size", "part", "at", "n"), ["label", "size", "part", "at"])

    def side(which: str) -> DataFrame:
        return data.select("label", "size", F.col("n").alias(which), *[F.col(c).alias(f"{which}_{c}") for c in ("reps", "copies", "vectors")])

    pairs = near_blocks(meta, reach).join(side("x"), ["label", "size", "x"]).join(side("y"), ["label", "size", "y"])
    return pairs.mapInArrow(lambda batches: _joined(batches, cosine), "rep long, links long, least long")


def linked(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    own = vectors.select("vec_id", "embedding", "label")
    found = shared.stored(classes(own), "vector-classes")
    near = shared.stored(links(found, cosine, block), "vector-links")
    counts = near.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = graph.components(near.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    results = found.join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(
        "label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = own.join(results, ["label", "embedding"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
