"""Ranked lexical search by blocked products of dense float64 tiles.

The vocabulary is that of the items searched for, so documents shrink to the terms that
some item has: (document, its number of terms, places in the vocabulary, counts).  From
that table come the statistics of the corpus, which fix the weight of a term and the
impact of a term in a document.

Items are scored a tile at a time: the tile's own terms make a compact vocabulary, the
weights an items x terms matrix, and the impacts of a tile of documents a terms x documents
matrix.  BLAS multiplies them in float64.  All numbers are whole; terms are taken so many
at a time that no partial sum can pass 2**53, and the partial sums are added as 64-bit
integers, so scores are exact.  Each task keeps an item's best ``k`` documents, ties by
doc_id, and the tasks' bests are ranked together.

Items are taken in blocks of about ``BLOCK_TERMS`` terms, so what is sent out is bounded
however many items there are.  Terms are 64-bit hashes.

A null text has no term.  Rows of one item_id (null too) are one item with all their terms.
Rows of documents count each for itself; a null doc_id comes last among equal scores.
Without items or documents there are no rows.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline.llm import shared
from perkline.llm.words import Words, words

TOP = 10
#: Length normalisation in hundredths, saturation in thousandths of a count.
B_PERCENT, K_MILLI, SCALE = 90, 8, 10**9
MOST_IMPACT = SCALE // 1000
ITEM_TILE, DOC_TILE = 32, 2048
BLOCK_TERMS = 1 << 20
_BETWEEN = np.ones(256, bool)
for _a, _b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _BETWEEN[_a : _b + 1] = False


def terms(texts: pa.Array) -> Words:
    """Runs of ASCII letters, digits and all other characters beyond ASCII, A-Z as a-z."""
    return words(texts, lower=True, separator=_BETWEEN)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term (hash): the distinct terms of each item; stored."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = terms(batch.column(1))
        owner = np.repeat(np.arange(batch.num_rows), np.diff(found.first))
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(found.hashes.view(np.int64))], names=["item_id", "term"])

    schema = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("term", T.LongType())])
    return shared.stored(shared.over_text(items, ["item_id", "text"], run, schema).distinct(), "search-items")


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms with repeats), at (places in the sorted ``vocabulary``), tf (their counts); stored."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = terms(batch.column(1))
        n = np.diff(found.first)
        place = np.minimum(np.searchsorted(sent.value, found.hashes), len(sent.value) - 1)
        hit = sent.value[place] == found.hashes
        owner = np.repeat(np.arange(len(n)), n)[hit]
        pairs, tf = np.unique(owner * len(sent.value) + place[hit], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(n) + 1) * len(sent.value)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (pairs % len(sent.value), tf)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), *lists], names=["doc_id", "n", "at", "tf"])

    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return shared.stored(shared.over_text(sized, ["doc_id", "text"], run, "doc_id long, n long, at array<int>, tf array<int>"), "search-postings")


def weights(found: DataFrame, size: int, filled: int) -> np.ndarray:
    """Weight of each place of the vocabulary from the documents that hold it."""
    df = np.zeros(size, np.int64)
    for at, n in found.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # one row per term of the block
        df[at] = n
    return np.array([math.floor(1000 * math.log((2 * filled + 2) / (2 * n + 1))) for n in df.tolist()], np.int64)


class Tile:
    """Some items: their compact vocabulary and their weights in it, cut where a partial sum might pass 2**53."""

    def __init__(self, items: np.ndarray, item: np.ndarray, at: np.ndarray, weight: np.ndarray):
        """``item`` and ``at`` list the terms of ``items``, by the item's place in ``items``."""
        self.items = items
        self.own = np.unique(at)
        self.matrix = np.zeros((len(items), len(self.own)))
        self.matrix[item, np.searchsorted(self.own, at)] = weight[at]
        self.wide = max(1, (1 << 53) // max(1, int(weight[at].max(initial=0)) * MOST_IMPACT))

    def scores(self, at: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
        """Items x documents, exact."""
        spot = np.minimum(np.searchsorted(self.own, at), len(self.own) - 1)
        hit = self.own[spot] == at
        spot, doc, impact = spot[hit], doc[hit], impact[hit]
        out = np.zeros((len(self.items), docs), np.int64)
        for start in range(0, len(self.own), self.wide):
            stop = min(len(self.own), start + self.wide)
            dense = np.zeros((stop - start, docs))
            some = (spot >= start) & (spot < stop)
            dense[spot[some] - start, doc[some]] = impact[some]
            out += (self.matrix[:, start:stop] @ dense).astype(np.int64)
        return out


class Best:
    """The best ``k`` documents of one item so far: by score, then documents with an id, then by id."""

    def __init__(self, k: int):
        self.k, self.floor = k, 1
        self.score, self.null, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def take(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray) -> None:
        if len(score) > self.k:
            some = score >= np.partition(score, -self.k)[-self.k]  # all that tie with the k-th
            score, null, doc = score[some], null[some], doc[some]
        score, null, doc = (np.concatenate(x) for x in ((self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.null, self.doc = score[order], null[order], doc[order]
        if len(order) == self.k:
            self.floor = max(1, int(self.score[-1]))


def impacts(tf: np.ndarray, n: np.ndarray, filled: int, length: int) -> np.ndarray:
    """Impact of a term that a document of ``n`` terms has ``tf`` times."""
    m = 100 - B_PERCENT + (B_PERCENT * n * filled) // length
    return (SCALE * tf) // (1000 * tf + K_MILLI * m)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``k`` best documents with a score above 0."""
    wanted = item_terms(items)
    blocks = -(-wanted.count() // block_terms)
    blocked = wanted.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, blocks))))
    found = [_block(docs, blocked.filter(F.col("block") == b).drop("block"), k) for b in range(blocks)]
    kind = items.schema["item_id"].dataType.simpleString()
    none = docs.sparkSession.createDataFrame([], f"item_id {kind}, doc_id long, score long")
    every = reduce(DataFrame.unionByName, [f for f in found if f is not None], none)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _block(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame | None:
    """item_id, doc_id, score: each task's best documents of each item; none where no score can be above 0."""
    rows = wanted.toArrow().combine_chunks()  # about BLOCK_TERMS rows
    if not rows.num_rows:
        return None
    vocabulary, at = np.unique(rows["term"].to_numpy().view(np.uint64), return_inverse=True)
    coded = pc.dictionary_encode(rows["item_id"], null_encoding="encode").combine_chunks()
    item, ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    found = postings(docs, vocabulary)
    filled, length = found.filter(F.col("n") > 0).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not filled:
        return None
    weight = weights(found, len(vocabulary), filled)
    order = np.lexsort((at, item))
    item, at = item[order], at[order]
    tiles = []
    for first in range(0, len(ids), ITEM_TILE):
        own = np.arange(first, min(len(ids), first + ITEM_TILE))
        a, b = np.searchsorted(item, [own[0], own[-1] + 1])
        tiles.append(Tile(own, item[a:b] - first, at[a:b], weight))
    sent = docs.sparkSession.sparkContext.broadcast((tiles, ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, ids = sent.value
        best = [Best(k) for _ in range(len(ids))]
        for batch in batches:
            for start in range(0, batch.num_rows, DOC_TILE):
                part = batch.slice(start, DOC_TILE)
                null = part.column(0).is_null().to_numpy(zero_copy_only=False)
                doc_id = part.column(0).fill_null(0).to_numpy()
                sizes = part.column(2).value_lengths().to_numpy()
                doc = np.repeat(np.arange(part.num_rows), sizes)
                at, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                impact = impacts(tf, part.column(1).to_numpy()[doc], filled, length)
                for tile in tiles:
                    scores = tile.scores(at, doc, impact, part.num_rows)
                    floors = np.array([best[i].floor for i in tile.items])
                    good = scores >= floors[:, None]
                    for row in np.flatnonzero(good.any(axis=1)).tolist():
                        some = np.flatnonzero(good[row])
                        best[tile.items[row]].take(scores[row, some], null[some], doc_id[some])
        counts = [len(b.score) for b in best]
        if sum(counts):
            owner = pa.array(np.repeat(np.arange(len(ids)), counts))
            doc = pa.array(np.concatenate([b.doc for b in best]), mask=np.concatenate([b.null for b in best]))
            yield pa.RecordBatch.from_arrays([ids.take(owner), doc, pa.array(np.concatenate([b.score for b in best]))], names=["item_id", "doc_id", "score"])

    kind = wanted.schema["item_id"].dataType.simpleString()
    return found.filter(F.size("at") > 0).select("doc_id", "n", "at", "tf").mapInArrow(run, f"item_id {kind}, doc_id long, score long")


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS nn, sum(len(ts))::BIGINT AS ll FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark),
t AS (SELECT r, doc_id, w, len(ts)::BIGINT AS n, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, ts, unnest(ts) AS w FROM d) GROUP BY r, doc_id, w, len(ts)),
wt AS (SELECT w, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM t, s GROUP BY w, nn),
c AS (SELECT q.item_id, t.r, t.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::BIGINT AS score
    FROM q JOIN wt USING (w) JOIN t USING (w), s GROUP BY q.item_id, t.r, t.doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
