"""Repeats, near duplicates of texts and of vectors against brute force."""

from __future__ import annotations

import random
import tracemalloc
from hashlib import sha256
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from perkline.llm import graph, grid_join, jaccard_join, recompression, repeats, shared
from perkline.llm import words as hashing
from tests.llm.helpers import LOWER, WORD, edge_docs, edge_texts, empty_docs, prose, words


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def cut(rows, length):
    first = {}
    for i, t in rows:
        w = words(t)
        if i is not None:
            for k in range(len(w) - length + 1):
                key = tuple(w[k : k + length])
                first[key] = min(first.get(key, i), i)
    for i, t in rows:
        w = words(t)
        keep = [True] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                keep[k : k + length] = [False] * length
        yield i, w, [x for x, ok in zip(w, keep) if ok]


def test_word_places_and_hashes():
    texts = [t for _, t in edge_texts()]
    found = hashing.words(pa.array(texts, pa.string()))
    raw = found.data.tobytes()
    want = [w for t in texts for w in words(t)]
    assert [raw[a:b].decode() for a, b in zip(found.starts, found.ends)] == want
    assert np.diff(found.first).tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(want, found.hashes.tolist()))) == len(set(want)) == len(set(found.hashes.tolist()))
    low = hashing.words(pa.array(texts, pa.string()), lower=True)
    assert len(set(low.hashes.tolist())) == len({w.translate(LOWER) for w in want})
    assert hashing.digests(found) == [sha256(" ".join(words(t)).encode()).hexdigest() for t in texts]
    assert np.array_equal(hashing.words(pa.array(texts, pa.string()).slice(9, 5)).hashes, found.hashes[found.first[9] : found.first[14]])


def test_equal_windows_have_equal_anchors():
    rng = random.Random(8)
    passage = prose(rng, 30)
    texts = [f"{prose(rng, rng.randint(0, 40))} {passage} {prose(rng, rng.randint(0, 40))}" for _ in range(40)] + ["ha " * 90, "ha " * 50, "la ba " * 60]
    found = hashing.words(pa.array(texts))
    for length in (5, 12, 20):
        own = recompression.anchors(found.hashes, found.first, length)
        starts, _ = hashing.window_starts(found.first, length)
        assert (own.of_window >= 0).sum() == len(starts) and (own.of_window[starts] >= 0).all()
        seen = {}
        for s in starts.tolist():
            mine = (own.low <= s) & (own.high >= s) & (own.level == own.of_window[s])
            names = frozenset(own.name[mine].tolist())
            assert names
            assert seen.setdefault(tuple(found.hashes[s : s + length].tolist()), names) == names


@pytest.mark.parametrize("length", [50, 7])
def test_repeats(spark, length):
    want = sorted([(str(i), len(w), len(w) - len(k), sha256(" ".join(k).encode()).hexdigest()) for i, w, k in cut(edge_texts(), length)])
    got = sorted([(str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.repeats(edge_docs(spark), length).collect()])
    assert got == want


def test_texts_without_repeats(spark):
    docs = edge_docs(spark)
    out = repeats.without_repeats(docs)
    assert out.columns == docs.columns
    got = sorted([(str(r["doc_id"]), str(r["text"]), r["n_chars"]) for r in out.collect()])
    want = []
    for (i, t), (_, w, k) in zip(edge_texts(), cut(edge_texts(), 50)):
        new = t if len(w) == len(k) else " ".join(k)
        if len(w) == len(k) or new:
            want.append((str(i), str(new), len(new or "")))
    assert got == sorted(want)
    assert repeats.without_repeats(empty_docs(spark)).count() == 0 == repeats.repeats(empty_docs(spark)).count()


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    own = [(i, shingle_set(t)) for i, t in rows]
    sets = Sets()
    for i, a in own:
        for j, b in own:
            if a and b and i is not None and j is not None and 100 * len(a & b) >= 75 * len(a | b):
                sets.join(i, j)
    return own, sets


def chain_rows():
    """Groups whose members link only through others, and one that needs rings and blocks."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 10**9)}" for _ in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), rng.choice([1, 3, 5, 6])):
            w[k] = f"x{rng.randint(0, 10**9)}"
        rows.append((100 + i, " ".join(w)))
    slide = [f"v{k}" for k in range(260)]
    rows += [(300 + i, " ".join(slide[6 * i : 6 * i + 100])) for i in range(24)]
    return rows


def test_jaccard_join(spark, monkeypatch):
    for small, rings in ((64, 8192), (4, 8)):
        monkeypatch.setattr(jaccard_join, "SMALL_CELL", small)
        monkeypatch.setattr(jaccard_join, "RING_ROWS", rings)
        rows = edge_texts() + chain_rows()
        docs = edge_docs(spark).select("doc_id", "text").unionByName(spark.createDataFrame(chain_rows(), "doc_id long, text string"))
        own, sets = near(rows)
        want = sorted([(str(i), len(s), str(None if i is None else sets.find(i))) for i, s in own])
        got = sorted([(str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.joined(docs).collect()])
        assert got == want


def test_texts_of_middling_cells_are_read_for_documents_with_a_partner_only(spark, monkeypatch):
    """A passage that many unlike documents share moves no text; families around the limit are linked as before."""
    rng = random.Random(8)
    passage = [f"p{k}" for k in range(14)]
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(40)] + passage + [f"u{i}y{k}" for k in range(40)])) for i in range(14)]
    for family in range(4):
        base = [f"f{family}w{k}" for k in range(80 + 20 * family)]
        for i in range(14):
            w = [f"z{rng.randint(0, 10**9)}" if rng.random() < rng.choice([0.01, 0.04]) else x for x in base]
            rows.append((100 + 100 * family + i, " ".join(w[: len(w) - 12 * (i % 3)])))
    for name, value in (("SMALL_CELL", 4), ("BLOCK", 4)):
        monkeypatch.setattr(jaccard_join, name, value)
    real, moved, open_cells = shared.stored, set(), []

    def watched(df, name):
        out = real(df, name)
        if name == "region-blocks":
            moved.update(i for r in out.select("ids").collect() for i in r["ids"])
        if name == "jaccard-blocks":
            open_cells.append(out.count())
        return out

    monkeypatch.setattr(shared, "stored", watched)
    own, sets = near(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.joined(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: sets.find(i) for i, _ in own}
    assert open_cells[0] and not moved & set(range(14))


def test_one_of_each(spark):
    docs = edge_docs(spark)
    own, sets = near(edge_texts())
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    want = {i for i, _ in own if i is not None and sets.find(i) == i}
    got = [r["doc_id"] for r in out.select("doc_id").collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2
    assert jaccard_join.one_of_each(empty_docs(spark)).count() == 0


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_stored_tables_leave_no_shuffles_and_can_be_dropped(spark):
    before = shuffle_files(spark)
    keyed = spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(5, "k")
    table = shared.stored(keyed.join(keyed.groupBy("k").count(), "k"), "test-table")
    assert shuffle_files(spark) <= before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert table.count() == 1000
    folder = Path(urlparse(table.inputFiles()[0]).path).parent
    shared.dropped(table)
    assert not folder.exists()
    other = f"{shared.new_folder(spark, 'test-other')}/below"
    spark.range(3).write.parquet(other)
    with pytest.raises(ValueError):
        shared.dropped(spark.read.parquet(other))
    assert spark.read.parquet(other).count() == 3


def test_jaccard_join_deletes_tables_that_nothing_reads(spark):
    """Texts, prefixes and cells go once what is made of them is stored, and so do rounds of components."""
    folder = Path(shared.shared_folder(spark))
    before = set(folder.iterdir())
    docs = spark.createDataFrame(chain_rows(), "doc_id long, text string")
    assert jaccard_join.joined(docs).count() == len(chain_rows())
    left = [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before]
    assert not set(left) & {"jaccard-texts", "jaccard-pairs", "region-blocks", "shingle-prefixes", "shingle-cells"}
    assert left.count("stars") == 2


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(150)] + [(2000, 2000 + i) for i in range(50)]
    sets = Sets()
    for a, b in links:
        sets.join(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for a, b in links for x in (a, b) if a != b}


def vectors(spark, extra=()):
    rng = np.random.default_rng(6)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 16))
        for i in range(120):
            rows.append((len(rows), (centres[i % 6] + rng.normal(size=16) * 0.35 * (i % 4)).astype(np.float32).tolist(), label))
    rows += [(1000 + i, rows[7][1], 0) for i in range(30)] + [(1100, [2 * x for x in rows[7][1]], 0), (1101, rows[7][1], 1)]
    rows += [(1200, None, 0), (1201, [0.0] * 16, 0), (1202, [float("nan")] + [1.0] * 15, 0), (1203, [float("inf")] * 16, 0), (1204, [None] + [1.0] * 15, 0), (1205, [], 0)]
    rows += [(1206, [1.0, 2.0], 0), (1207, [2.0, 4.0], 0), (1208, [1e-30, 2e-30], 0), (1209, [1e30, 2e30], 0), (1000, rows[7][1], 0)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, rep string")


@pytest.mark.parametrize("block", [1024, 16])
def test_grid_join(spark, block, monkeypatch):
    monkeypatch.setattr(grid_join, "FANOUT", 2)
    rows, table = vectors(spark)
    fine = [(i, np.array(v, np.float64), label) for i, v, label in rows if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    sets, count = Sets(), [0] * len(fine)
    for x, (i, a, la) in enumerate(fine):
        for y, (j, b, lb) in enumerate(fine):
            if x < y and la == lb and len(a) == len(b) and (a / np.linalg.norm(a)) @ (b / np.linalg.norm(b)) >= 0.93:
                sets.join(i, j)
                count[x] += 1
                count[y] += 1
    links = {}
    for (i, _, _), n in zip(fine, count):
        links[i] = n
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in grid_join.linked(table, block=block).collect()}
    assert got == {(i, links.get(i, 0), sets.find(i), sets.find(i) == i) for i, _, _ in rows}
    assert grid_join.linked(table.limit(0)).count() == 0


def test_repeated_values_are_counted_in_little_memory():
    """Sorted in place: the peak beside the input is one copy and its marks, not several copies."""
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.integers(0, 1 << 60, 1 << 19), rng.integers(0, 5000, 1 << 14)]).astype(np.uint64)
    own, count = np.unique(values, return_counts=True)
    held = np.split(values.copy(), 8)
    tracemalloc.start()
    found, n = jaccard_join.repeated(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held == [] and (found == own[count > 1]).all() and (n == count[count > 1]).all()
    assert peak < 1.5 * values.nbytes
    assert [len(x) for x in jaccard_join.repeated([np.zeros(0, np.uint64)])] == [0, 0]


def test_text_slices_are_half_a_megabyte_by_default(spark):
    """Workers hold arrays of many times the size of a slice."""
    rows = spark.createDataFrame([(i, "x" * 100_000) for i in range(12)], "doc_id long, text string").coalesce(1)
    sizes = shared.over_text(rows, ["doc_id", "text"], lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long")
    assert sorted(r["n"] for r in sizes.collect()) == [2, 5, 5]
