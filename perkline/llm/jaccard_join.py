"""Near duplicates by an exact Jaccard join of word shingles in metric space.

The distance of two documents is one less the Jaccard similarity of their shingle sets,
which is a metric.  Two linked documents share one of the first quarter of their shingles
in any order that holds for all; each shared one is a cell.  The order puts shingles that
many documents have last, so cells stay small.

Each cell's most central document is its pivot.  Distances to pivots come first: they link
most of what belongs together.  Where a cell then still holds several components,

* a small cell compares its documents across components, if the cells they share and the
  triangle inequality over the pivot allow a link;
* a middling cell is joined block by block, with no row per pair: first on the lists of
  cells, which leave the documents with a partner that could link, then on the texts of
  those.  A pair is looked at in the first of the cells it shares only;
* a large cell becomes Voronoi-like regions: rings of the link distance around the pivot,
  each with the next ring as its window, so that a pair within the link distance meets in
  one.  The pivot is done with, and each region is joined in the same way again;
* regions that no longer shrink are joined block by block too.

Documents of equal sets are one class and are not compared.  Results are exact: filters
only drop pairs that can't link, and every pair that is kept is checked on its whole sets.

Null text, or text without words, has no shingle and links with nothing.  A null doc_id
links with nothing and has no component.  Rows of one doc_id are one document.  An empty
table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.llm import graph, shared
from perkline.llm.words import mix, runs_hash, spans_hash, window_starts, words

SHINGLE = 5
PERCENT = 75
REACH = 1 - PERCENT / 100
SMALL_CELL = 64
#: A shingle goes to the end of the order if more documents than this, and this share of all, have it.
HOT_DOCS, HOT_SHARE = 16, 1e-4
BLOCK = 512
#: Cells up to this size are joined block by block at once; larger ones are taken apart by rings first.
RING_ROWS, ROUNDS = 16 * BLOCK, 6
_HELD = 4 << 20
#: Bytes of text that a worker takes at once; it holds some twenty times as much.
SLICE = 1 << 19
_SALTS = (np.uint64(0x8CB92BA72F3D8DD7), np.uint64(0x589965CC75374CC3))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and the texts' bounds."""
    found = words(texts, lower=True)
    starts, bounds = window_starts(found.first, size)
    n = np.diff(found.first)
    short = np.flatnonzero((n > 0) & (n < size))
    hashes = np.concatenate([runs_hash(found.hashes, starts, size) if len(starts) else np.zeros(0, np.uint64), mix(spans_hash(found.hashes, found.first)[short])])
    owner = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(bounds)), short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def repeated(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values that ``held`` has more than once, sorted, and how often; empties ``held``, and sorts in place to spare memory."""
    values = np.concatenate(held)
    held.clear()
    values.sort()
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[1:] == values[:-1]
    first, last = np.flatnonzero(~same[:-1] & same[1:]), np.flatnonzero(same[:-1] & ~same[1:])
    return values[first], (last - first + 1).astype(np.int64)


def frequent(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Shingles of many documents, sorted: at most the mean set size over ``HOT_SHARE`` of them.

    Counts are summed from what each task sees twice among some millions of shingles.
    They only set the order of shingles, on which no result depends.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held, rows = [], 0, 0

        def flush():
            own, count = repeated(held)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(count)], names=["shingle", "docs"])

        for batch in batches:
            for part in shared.slices(batch, SLICE):
                held.append(shingles(part.column(0), size)[0])
                size_held += len(held[-1])
                rows += part.num_rows
                if size_held > _HELD:
                    yield from flush()
                    held, size_held = [], 0
        if held:
            yield from flush()

    total = docs.count()
    counts = docs.select("text").mapInArrow(shared.trimmed(run), "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))
    hot = counts.filter(F.col("docs") > max(HOT_DOCS, HOT_SHARE * total)).select("shingle").toArrow()
    return np.sort(hot["shingle"].to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, hot: np.ndarray, size: int = SHINGLE) -> DataFrame:
    """doc_id, n (set size), key1, key2 (hashes of the set), cells (first quarter of the set, by rare and hash)."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, bounds = shingles(batch.column(1), size)
        n = np.diff(bounds)
        owner = np.repeat(np.arange(len(n)), n)
        keys = []
        for salt in _SALTS:
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + salt), dtype=np.uint64)])
            keys.append(pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)))
        spot = np.minimum(np.searchsorted(sent.value, hashes), max(0, len(sent.value) - 1))
        late = sent.value[spot] == hashes if len(sent.value) else np.zeros(len(hashes), bool)
        order = np.lexsort((hashes, late, owner))
        first = np.arange(len(hashes)) - bounds[owner] <= n[owner] // 4
        cells = (hashes[order][first] >> np.uint64(16)).view(np.int64)
        ends = np.concatenate([[0], np.cumsum(np.where(n > 0, n // 4 + 1, 0))])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(cells))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *keys, lists], names=["doc_id", "n", "key1", "key2", "cells"])

    return shared.over_text(docs, ["doc_id", "text"], run, "doc_id long, n long, key1 long, key2 long, cells array<long>", SLICE)


def _fits(n: Column, m: Column) -> Column:
    return F.lit(100) * F.least(n, m) >= F.lit(PERCENT) * F.greatest(n, m)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One text per doc_id of ``ids``, stored; other documents are mostly left out before the shuffle."""
    near = shared.parted(docs, ids)[1].join(ids, "doc_id", "left_semi")
    return shared.stored(near.groupBy("doc_id").agg(F.max("text").alias("text")), "jaccard-texts")


def distances(pairs: DataFrame, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """a, b, shared, total (sizes of intersection and union) for pairs (a, b), counted on the whole sets; stored."""
    pairs = shared.stored(pairs.select("a", "b"), "jaccard-pairs")
    texts = _texts(docs, pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shared.slices(batch, 1 << 20, "a_text"):
                (x, x_at), (y, y_at) = (shingles(part.column(c), size) for c in ("a_text", "b_text"))
                row = np.concatenate([np.repeat(np.arange(part.num_rows), np.diff(at)) for at in (x_at, y_at)])
                both = np.concatenate([x, y])
                order = np.lexsort((both, row))
                both, row = both[order], row[order]
                common = np.bincount(row[1:][(both[1:] == both[:-1]) & (row[1:] == row[:-1])], minlength=part.num_rows)
                total = np.diff(x_at) + np.diff(y_at) - common
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common.astype(np.int64)), pa.array(total.astype(np.int64))], names=["a", "b", "shared", "total"])

    with_a = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a")
    with_b = with_a.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
    out = shared.stored(with_b.select("a", "b", "a_text", "b_text").mapInArrow(shared.trimmed(run), "a long, b long, shared long, total long"), "jaccard-distances")
    shared.dropped(pairs, texts)
    return out


def _links(tested: DataFrame) -> DataFrame:
    return tested.filter(100 * F.col("shared") >= PERCENT * F.col("total")).select("a", "b")


def _open(cells: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of ``cells`` with their component and the number of rows, for cells with more than one component."""
    own = cells.drop("component", "rows").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    state = own.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("rows")).filter(F.col("low") < F.col("high"))
    return own.join(state.select("cell", "rows"), "cell")


def _pivots(cells: DataFrame) -> DataFrame:
    """The pivot of each cell: the document with most of its prefix in cells, then the smallest."""
    least = cells.groupBy("cell").agg(F.min(F.struct("off_centre", "doc_id", "n")).alias("p"))
    return least.select("cell", F.col("p.doc_id").alias("pivot"), F.col("p.n").alias("pivot_n"))


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col("a") < F.col("b")).distinct()


def _with_distance(rows: DataFrame, tested: DataFrame) -> DataFrame:
    """Rows (doc_id, pivot) with ``d``, their distance where it was tested."""
    known = tested.select(F.col("a").alias("x"), F.col("b").alias("y"), (1 - F.col("shared") / F.col("total")).alias("d"))
    keyed = rows.withColumns({"x": F.least("doc_id", "pivot"), "y": F.greatest("doc_id", "pivot")})
    return keyed.join(known, ["x", "y"], "left").drop("x", "y")


def _need(n: Column, m: Column) -> Column:
    """Cells that two sets must share to link.

    What two sets have in common and is in no common cell lies behind the prefix of one of
    them, so it is at most the rest of the larger set.
    """
    larger = F.greatest(n, m)
    return F.ceil(PERCENT * (n + m) / (100 + PERCENT) - F.lit(1e-9)) - (larger - F.floor(larger / 4) - 1)


def _across(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) across the components of a cell that sizes, distances to the pivot and shared cells let link.

    Cells are counted here, as each is a row: all that both have open, but for those ``over``.
    """
    cols = ["doc_id", "n", "component", "d", "open", "over"]
    x, y = (rows.select("cell", *[F.col(c).alias(f"{s}_{c}") for c in cols]) for s in "xy")
    need = _need(F.col("x_n"), F.col("y_n"))
    met = x.join(y, "cell").filter((F.col("x_doc_id") < F.col("y_doc_id")) & (F.col("x_component") != F.col("y_component")) & _fits(F.col("x_n"), F.col("y_n")))
    met = met.filter(F.least("x_open", "y_open") >= need)
    near = F.coalesce(F.abs(F.col("x_d") - F.col("y_d")) <= REACH + 1e-9, F.lit(True))
    pairs = met.groupBy(F.col("x_doc_id").alias("a"), F.col("y_doc_id").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.bool_and(near).alias("near"), F.max(need - F.least("x_over", "y_over")).alias("here"))
    return pairs.filter(F.col("near") & (F.col("met") >= F.col("here"))).select("a", "b")


def _plausible(pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs whose common cells are enough for a link."""
    own = cells.groupBy("doc_id").agg(F.collect_list("cell").alias("cells"), F.max("n").alias("n"))  # one document's prefix
    a, b = (own.select(F.col("doc_id").alias(s), F.col("cells").alias(f"{s}_cells"), F.col("n").alias(f"{s}_n")) for s in "ab")
    met = pairs.join(a, "a").join(b, "b").withColumn("met", F.size(F.array_intersect("a_cells", "b_cells")))
    return met.filter(F.col("met") >= _need(F.col("a_n"), F.col("b_n"))).select("a", "b")


def _key() -> Column:
    """Name of a cell that says its place in the order in which cells are looked at: small, middling, large."""
    turn = F.when(F.col("rows") <= SMALL_CELL, 0).when(F.col("rows") <= RING_ROWS, 1).otherwise(2)
    return F.col("cell") + turn.cast("long") * F.lit(1 << 48)


def _lists(rest: DataFrame) -> DataFrame:
    """doc_id, keys (its open cells), open (how many), over (how many of them are not small); stored."""
    over = F.sum((F.col("rows") > SMALL_CELL).cast("int"))
    own = rest.groupBy("doc_id").agg(F.collect_list(_key()).alias("keys"), F.count(F.lit(1)).alias("open"), over.alias("over"))  # one document's prefix
    return shared.stored(own, "jaccard-lists")


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with the block of their document, about BLOCK of them a block."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    return rows.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("parts")))


def _shared_counts(hashes: list[np.ndarray], n: list[np.ndarray], among: np.ndarray) -> np.ndarray:
    """How many of ``among`` (sorted) each set of one side has in common with each of the other; sets are ``n`` hashes each."""
    common = np.zeros((len(n[0]), len(n[1])), np.float32)
    for at in range(0, len(among), 4096):
        part, columns = among[at : at + 4096], []
        for values, own in zip(hashes, n):
            spot = np.minimum(np.searchsorted(part, values), len(part) - 1)
            hit = part[spot] == values
            table = np.zeros((len(own), len(part)), np.float32)
            table[np.repeat(np.arange(len(own)), own)[hit], spot[hit]] = 1
            columns.append(table)
        common += columns[0] @ columns[1].T
    return common


def _met(hashes: list[np.ndarray], same: bool) -> np.ndarray:
    """Values that two sets may have in common, sorted: those of both sides, in one block those of two sets."""
    if not same:
        return np.intersect1d(*hashes)
    values, times = np.unique(hashes[0], return_counts=True)
    return values[times > 1]


def _sieved(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """cell, doc_id of ``rows`` (cell, doc_id, n, component, key) with a document across components that shares enough cells for a link; stored.

    Where a region is a cell (``key`` is its name in ``lists``), only pairs are looked at that share none before it.
    """
    columns = [F.col(c) for c in ("doc_id", "n", "component", "keys")]
    held = _dealt(rows).join(lists.select("doc_id", "keys"), "doc_id").groupBy("cell", "block").agg(F.max("key").alias("key"), F.collect_list(F.struct(*columns)).alias("docs"))
    held = shared.stored(held, "region-lists")  # about BLOCK documents a row
    x, y = held.select("cell", "key", F.col("block").alias("x_block"), F.col("docs").alias("x_docs")), held.select("cell", F.col("block").alias("y_block"), F.col("docs").alias("y_docs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell, key, a, b = (batch.column(c)[i].as_py() for c in ("cell", "key", "x_block", "y_block"))
                sides = [batch.column(f"{s}_docs")[i].values for s in "xy"]
                ids, n, component = ([side.field(c).to_numpy() for side in sides] for c in ("doc_id", "n", "component"))
                keys = [side.field("keys").flatten().to_numpy() for side in sides]
                sizes = [pc.list_value_length(side.field("keys")).to_numpy().astype(np.int64) for side in sides]
                among = _met(keys, a == b)
                before = 0 if key is None else np.searchsorted(among, key)
                earlier = _shared_counts(keys, sizes, among[:before])
                met = earlier + _shared_counts(keys, sizes, among[before:])
                small, large = np.minimum(n[0][:, None], n[1][None, :]), np.maximum(n[0][:, None], n[1][None, :])
                need = np.ceil(PERCENT * (small + large) / (100 + PERCENT) - 1e-9) - (large - large // 4 - 1)
                ok = (met >= need) & (earlier == 0) & (100 * small >= PERCENT * large) & (component[0][:, None] != component[1][None, :])
                some = np.unique(np.concatenate([ids[0][ok.any(1)], ids[1][ok.any(0)]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), cell, np.int64)), pa.array(some)], names=["cell", "doc_id"])

    out = shared.stored(x.join(y, "cell").filter(F.col("x_block") <= F.col("y_block")).mapInArrow(shared.trimmed(run), "cell long, doc_id long"), "region-rows")
    shared.dropped(held)
    return out


def _blocks(rows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Links that connect the documents of regions, found block against block on shared shingles as 0/1 columns; stored.

    A block pair gives each document's smallest one that it is connected with there.
    """
    numbered = _dealt(rows.select("cell", "doc_id").distinct())
    texts = _texts(docs, rows.select("doc_id").distinct())
    held = numbered.join(texts, "doc_id").groupBy("cell", "block").agg(F.collect_list("doc_id").alias("ids"), F.collect_list("text").alias("texts"))
    held = shared.stored(held, "region-blocks")  # about BLOCK documents a row
    shared.dropped(texts)
    x, y = (held.select("cell", *[F.col(c).alias(f"{s}_{c}") for c in ("block", "ids", "texts")]) for s in "xy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                same = row["x_block"] == row["y_block"]
                sets = [shingles(pa.array(row[f"{s}_texts"], pa.string()), size) for s in ("x" if same else "xy")]
                hashes, n = ([f(own) for own in (sets * 2 if same else sets)] for f in (lambda own: own[0], lambda own: np.diff(own[1])))
                common = _shared_counts(hashes, n, _met(hashes, same))
                i, j = np.nonzero(100 * common >= PERCENT * (n[0][:, None] + n[1][None, :] - common))
                nodes, at = np.unique(np.array(row["x_ids"] + row["y_ids"], np.int64), return_inverse=True)
                least = graph.least_reached(at[i], at[len(n[0]) + j], nodes)
                some = least < nodes
                yield pa.RecordBatch.from_arrays([pa.array(least[some]), pa.array(nodes[some])], names=["a", "b"])

    out = shared.stored(x.join(y, "cell").filter(F.col("x_block") <= F.col("y_block")).mapInArrow(shared.trimmed(run), "a long, b long"), "jaccard-blocks")
    shared.dropped(held)
    return out


def _rings(around: DataFrame, tested: DataFrame) -> DataFrame:
    """Regions of a cell around its pivot: each ring of the link distance together with the next one."""
    outer = F.least(F.floor((F.col("d") + 1e-9) / REACH), F.lit(3)).cast("long")
    inner = F.least(F.floor((F.col("d") - 1e-9) / REACH), F.lit(3)).cast("long")
    zones = F.array_distinct(F.transform(F.array(inner - 1, outer - 1, outer), lambda z: F.greatest(z, F.lit(0).cast("long"))))
    placed = _with_distance(around, tested).withColumn("zone", F.explode(zones))
    return placed.withColumn("cell", F.xxhash64("cell", "pivot", "zone")).select("cell", "doc_id", "n", "off_centre").distinct()


def joined(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    base = shared.stored(prefixes(docs, frequent(docs, size), size), "shingle-prefixes")
    light = base.select("doc_id", "n", "key1", "key2")
    firsts = light.filter((F.col("n") > 0) & F.col("doc_id").isNotNull()).groupBy("n", "key1", "key2").agg(F.min("doc_id").alias("rep"))
    classes = light.join(firsts, ["n", "key1", "key2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))
    members = shared.stored(classes, "shingle-classes")
    reps = members.filter(F.col("doc_id") == F.col("rep")).groupBy("doc_id").agg(F.max("n").alias("n"))

    posted = base.filter(F.col("doc_id").isNotNull()).select("doc_id", F.explode("cells").alias("cell"))
    often = posted.groupBy("cell").agg(F.count(F.lit(1)).alias("docs")).filter(F.col("docs") > 1).select("cell")
    met = posted.join(often, "cell").join(reps, "doc_id").distinct()
    met = shared.stored(met, "shingle-cells")
    shared.dropped(base)
    more = met.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    shared_cells = met.join(more, "cell")
    centre = shared_cells.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    cells = shared_cells.join(centre, "doc_id").select("cell", "doc_id", "n", "rows", (-F.col("own") / (F.floor(F.col("n") / 4) + 1)).alias("off_centre"))
    cells = shared.stored(cells, "jaccard-cells")
    shared.dropped(met)

    pivots = shared.stored(_pivots(cells), "jaccard-pivots")
    stars = _ordered(cells.join(pivots, "cell").filter(_fits(F.col("n"), F.col("pivot_n"))), "doc_id", "pivot")
    tested = distances(_plausible(stars, cells), docs, size)
    roots = shared.stored(graph.components(_links(tested)), "jaccard-components")

    rest = shared.stored(_open(cells, roots), "jaccard-open")
    lists = _lists(rest)
    near = rest.filter(F.col("rows") <= SMALL_CELL).join(lists.select("doc_id", "open", "over"), "doc_id").join(pivots, "cell")
    pairs = _across(_with_distance(near, tested)).join(tested, ["a", "b"], "left_anti")
    found = distances(_plausible(pairs, rest), docs, size)
    links = [_links(tested), _links(found)]

    # Rings are named by where they lie, so a region of many cells is joined once per cell only.
    stars = graph.components(links[0].unionByName(links[1]))
    roots = shared.stored(stars, "jaccard-components")
    shared.dropped(stars)
    middling = _open(rest.filter(F.col("rows").between(SMALL_CELL + 1, RING_ROWS)), roots).withColumn("key", _key())
    regions = rest.filter(F.col("rows") > RING_ROWS)
    blocked, before = [middling], None
    for _ in range(ROUNDS):
        regions = shared.stored(regions, "jaccard-regions")
        rows = regions.count()
        if not rows or before is not None and rows > 0.8 * before:
            break
        before = rows
        pivots = shared.stored(_pivots(regions), "jaccard-pivots")
        around = regions.join(pivots, "cell").filter(F.col("doc_id") != F.col("pivot"))
        new = _ordered(around, "doc_id", "pivot").join(tested, ["a", "b"], "left_anti")
        tested = shared.stored(tested.unionByName(distances(new, docs, size)), "jaccard-distances")
        links[0] = _links(tested)
        roots = shared.stored(graph.components(links[0].unionByName(links[1])), "jaccard-components")
        split = shared.stored(_open(_rings(around, tested), roots), "jaccard-open")
        near = split.filter(F.col("rows") <= SMALL_CELL).withColumn("d", F.lit(None).cast("double"))
        near = near.join(lists.select("doc_id", "open"), "doc_id").withColumn("over", F.col("open"))
        extra = _plausible(_across(near).join(tested, ["a", "b"], "left_anti"), cells)
        links[1] = links[1].unionByName(_links(distances(extra, docs, size)))
        blocked.append(split.filter(F.col("rows").between(SMALL_CELL + 1, RING_ROWS)))
        regions = split.filter(F.col("rows") > RING_ROWS)
    blocked.append(regions)
    left = blocked[0].select("cell", "doc_id", "n", "component", "key")
    for own in blocked[1:]:
        left = left.unionByName(own.select("cell", "doc_id", "n", "component", F.lit(None).cast("long").alias("key")))
    left = _sieved(shared.stored(left, "jaccard-blocks"), lists)
    if not left.isEmpty():
        links.append(_blocks(left, docs, size))
    every = links[0]
    for own in links[1:]:
        every = every.unionByName(own)
    roots = graph.components(every).select(F.col("node").alias("rep"), "component")
    out = members.join(roots, "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with all columns, less every document that a smaller doc_id is connected with.

    Of rows with one doc_id one stays.  Only rows that may go are shuffled.
    """
    found = shared.stored(joined(docs, size).filter(F.col("doc_id").isNotNull()).select("doc_id", "component_id"), "jaccard-result")
    state = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    touched = shared.stored(state.filter((F.col("component_id") < F.col("doc_id")) | (F.col("rows") > 1)), "jaccard-touched")
    rest, maybe = shared.parted(docs, touched.select("doc_id"))
    own = touched.select(F.col("doc_id").alias("__own_id"), F.col("component_id").alias("__own_component"))
    stays = maybe.join(own, F.col("doc_id") == F.col("__own_id"), "left")
    stays = stays.filter(F.col("__own_id").isNull() | (F.col("__own_component") == F.col("doc_id"))).dropDuplicates(["doc_id"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*names).unionByName(stays.select(*names))
