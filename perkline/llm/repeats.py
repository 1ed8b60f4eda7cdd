"""Removal of long passages that also start in a document with a smaller id.

1. Every task names the parts of its texts by recompression; the names are global.
2. Spark counts, per name, the smallest and largest document.  A window of words can only
   repeat if all its anchors do.  Documents that are word for word equal to one with a
   smaller id are settled by the hash of all their words and leave here.
3. Windows with repeating anchors are held against each other by a 128-bit hash of all
   their words; the smallest document of each window decides.
4. Words under a window that a smaller document holds are cut out of the text.

Names, windows and positions are rows; a task holds the anchors of single documents only.
Joins on names and windows meet minima of at most one row per name, so frequent passages
split; hot names are reduced by partial aggregates first.

Null text has no words.  A null doc_id is never smaller than another and its row stays as
it is; rows with one doc_id don't remove each other's words.  An empty table gives no
rows.  Columns other than doc_id and text are not read by ``repeats``; ``without_repeats``
keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perkline.llm import shared
from perkline.llm.recompression import anchors, windows_with_all
from perkline.llm.words import digests, joined, runs_hash, spans_hash, words

WINDOW = 50
_SECOND = 0x2545F4914F6CDD1D
_KEY_SALT = 0x632BE59BD9B4E019


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def named(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, key1, key2 (hashes of all words), n_words, sha256 (of all words), names (distinct anchors)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(1))
        own = anchors(found.hashes, found.first, length)
        order = np.lexsort((own.name, own.text))
        name, text = own.name[order], own.text[order]
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
        bounds = np.searchsorted(text[new], np.arange(batch.num_rows + 1))
        columns = [
            batch.column(0), _longs(spans_hash(found.hashes, found.first)), _longs(spans_hash(found.hashes, found.first, _KEY_SALT)),
            _longs(np.diff(found.first)), pa.array(digests(found), pa.string()), _lists(_longs(name[new]), bounds),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key1", "key2", "n_words", "sha256", "names"])

    return shared.over_text(docs, ["doc_id", "text"], run, "doc_id long, key1 long, key2 long, n_words long, sha256 string, names array<long>")


def windows(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, text, at (first words), later, sooner, hash1, hash2 of the windows whose anchors all repeat.

    ``docs`` has doc_id, text and ``shared``: the repeating anchors as (name, sooner, later),
    whether a smaller and whether a larger document has the name.  ``sooner`` of a window
    says that a smaller document may have it, ``later`` that a larger one may.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column("text"))
        own = anchors(found.hashes, found.first, length)
        given = batch.column("shared")
        flat = given.flatten()
        owner = np.repeat(np.arange(batch.num_rows), np.diff(given.offsets.to_numpy()))
        known = flat.field("name").to_numpy(zero_copy_only=False).view(np.uint64) ^ (owner.astype(np.uint64) << np.uint64(40))
        order = np.argsort(known)
        known = known[order]
        asked = own.name ^ (own.text.astype(np.uint64) << np.uint64(40))
        spot = np.minimum(np.searchsorted(known, asked), max(0, len(known) - 1))
        there = known[spot] == asked if len(known) else np.zeros(len(asked), bool)
        flags = {}
        for side in ("sooner", "later"):
            mark = flat.field(side).to_numpy(zero_copy_only=False).astype(bool)[order]
            flags[side] = windows_with_all(own, there & (mark[spot] if len(known) else there))
        chosen = np.flatnonzero(flags["sooner"] | flags["later"])
        bounds = np.searchsorted(chosen, found.first)
        text = np.searchsorted(found.first, chosen, "right") - 1
        at = chosen - found.first[text]
        lists = [_lists(x, bounds) for x in (
            pa.array(at.astype(np.int32)), pa.array(flags["sooner"][chosen]),
            _longs(runs_hash(found.hashes, chosen, length)), _longs(runs_hash(found.hashes, chosen, length, _SECOND)),
        )]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *lists], names=["doc_id", "text", "at", "sooner", "hash1", "hash2"])

    return shared.over_text(docs, ["doc_id", "text", "shared"], run, "doc_id long, text string, at array<int>, sooner array<boolean>, hash1 array<long>, hash2 array<long>")


def _cut(found, removed: pa.Array, length: int) -> np.ndarray:
    """Which words stay when the windows from ``removed`` (lists of first words, null: none) go."""
    n = len(found.hashes)
    starts = removed.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(removed.offsets.to_numpy())
    starts = starts + np.repeat(found.first[:-1], sizes)
    change = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] == 0


def removals(docs: DataFrame, length: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, key1, n_words, sha256, copy; changed documents: doc_id, key1, text, removed).

    ``copy`` marks documents equal to one of a smaller id, all of whose words go.
    ``removed`` has the first words of the windows to cut out.
    """
    base = shared.stored(named(docs.select("doc_id", "text"), length), "repeat-names")
    light = base.select("doc_id", "key1", "key2", "n_words", "sha256")
    long_enough = light.filter((F.col("n_words") >= length) & F.col("doc_id").isNotNull())
    firsts = long_enough.groupBy("key1", "key2").agg(F.min("doc_id").alias("first_doc"))
    flagged = light.join(firsts, ["key1", "key2"], "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)))
    flagged = shared.stored(flagged.select("doc_id", "key1", "n_words", "sha256", "copy"), "repeat-copies")

    own = flagged.filter(~F.col("copy") & F.col("doc_id").isNotNull() & (F.col("n_words") >= length)).select("doc_id", "key1").distinct()
    names = base.select("doc_id", "key1", "names").join(own, ["doc_id", "key1"], "left_semi").select("doc_id", F.explode("names").alias("name"))
    spread = names.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(F.col("least") < F.col("most"))
    hits = names.join(spread, "name").select("doc_id", F.struct("name", (F.col("least") < F.col("doc_id")).alias("sooner"), (F.col("most") > F.col("doc_id")).alias("later")).alias("hit"))
    per_doc = hits.groupBy("doc_id").agg(F.collect_list("hit").alias("shared"))  # at most one document's anchors

    texts = docs.select("doc_id", "text").join(per_doc, "doc_id")
    found = windows(texts, length).filter(F.size("at") > 0).withColumn("row", F.monotonically_increasing_id())
    found = found.withColumn("text", F.when(F.array_contains("sooner", True), F.col("text")))
    found = shared.stored(found, "repeat-windows")
    each = found.select("row", "doc_id", F.inline(F.arrays_zip("at", "sooner", "hash1", "hash2")))
    least = each.groupBy("hash1", "hash2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).filter(F.col("least") < F.col("most")).drop("most")
    repeated = each.filter("sooner").join(least, ["hash1", "hash2"]).filter(F.col("least") < F.col("doc_id"))
    gone = repeated.groupBy("row").agg(F.collect_list("at").alias("removed"))  # at most one document's windows
    changed = found.select("row", "doc_id", "text").filter(F.col("text").isNotNull()).join(gone, "row").select("doc_id", "text", "removed")
    return flagged, changed


def repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) of every document."""
    flagged, changed = removals(docs, length)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(1))
        keep = _cut(found, batch.column(2), length)
        kept_before = np.concatenate([[0], np.cumsum(keep)])
        columns = [batch.column(0), _longs(spans_hash(found.hashes, found.first)), _longs(np.diff(kept_before[found.first])), pa.array(digests(found, keep), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "key1", "n_kept", "kept"])

    cut = shared.over_text(changed, ["doc_id", "text", "removed"], run, "doc_id long, key1 long, n_kept long, kept string")
    cut = cut.groupBy("doc_id", "key1").agg(F.min("n_kept").alias("n_kept"), F.min("kept").alias("kept"))  # repeated rows are equal here
    out = flagged.join(cut, ["doc_id", "key1"], "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    n_kept = F.when(F.col("copy"), F.lit(0)).otherwise(F.coalesce("n_kept", "n_words"))
    return out.select(
        "doc_id", "n_words", (F.col("n_words") - n_kept).cast("long").alias("n_removed"),
        F.when(F.col("copy"), nothing).otherwise(F.coalesce("kept", "sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame, length: int = WINDOW) -> DataFrame:
    """``docs`` with the text of changed documents replaced by their kept words; emptied documents leave.

    All columns stay; n_chars, if there, follows the text.
    """
    flagged, changed = removals(docs, length)
    columns = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(1))
        raw, at = joined(found, _cut(found, batch.column(2), length))
        texts = [raw[a : max(a, b - 1)].decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return pa.RecordBatch.from_arrays([batch.column(0), _longs(spans_hash(found.hashes, found.first)), pa.array(texts, pa.string())], names=["doc_id", "key1", "__new_text"])

    cut = shared.over_text(changed, ["doc_id", "text", "removed"], run, "doc_id long, key1 long, __new_text string").dropDuplicates(["doc_id", "key1"])
    copies = flagged.filter("copy").select("doc_id", "key1", F.lit("").alias("__new_text")).distinct()
    new = cut.unionByName(copies).select(F.col("doc_id").alias("__new_id"), F.col("key1").alias("__new_key"), "__new_text")

    def keyed(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = words(batch.column(columns.index("text")))
        return pa.RecordBatch.from_arrays([*batch.columns, _longs(spans_hash(found.hashes, found.first))], names=[*columns, "__key"])

    new = shared.stored(new, "repeat-texts")
    rest, maybe = shared.parted(docs, new.select("__new_id"))
    schema = T.StructType([*docs.schema, T.StructField("__key", T.LongType())])
    out = shared.over_text(maybe, columns, keyed, schema).join(new, (F.col("doc_id") == F.col("__new_id")) & (F.col("__key") == F.col("__new_key")), "left")
    out = out.filter(F.col("__new_text").isNull() | (F.col("__new_text") != ""))
    values = []
    for c in columns:
        old, then = F.col(f"`{c}`"), {"text": F.col("__new_text"), "n_chars": F.length("__new_text")}.get(c)
        values.append(old if then is None else F.when(F.col("__new_text").isNotNull(), then.cast(docs.schema[c].dataType)).otherwise(old).alias(c))
    return rest.select(*[F.col(f"`{c}`") for c in columns]).unionByName(out.select(*values))
