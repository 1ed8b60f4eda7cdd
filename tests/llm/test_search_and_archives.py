"""Ranked search, collocations and archives against brute force and round trips."""

from __future__ import annotations

import gzip
import io
import math
import random
import re
import tracemalloc
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from perkline.llm import collocations, lexical_search, quotient_filter, shared, warc
from tests.llm.helpers import LOWER, edge_docs, edge_texts, empty_docs, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def test_terms_are_those_of_the_pattern():
    texts = [t for _, t in edge_texts()] + ["A-b_c9é\x7fZ", "`x{y}", "naïve—dash 3.14"]
    found = lexical_search.terms(pa.array(texts, pa.string()))
    raw = found.data.tobytes()
    assert [raw[a:b].decode() for a, b in zip(found.starts, found.ends)] == [w for t in texts for w in TERM.findall(t or "")]


def best_documents(docs, items, k=10):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(i, Counter(split(t))) for i, t in docs]
    filled, length = sum(1 for _, b in bags if b), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    own = {}
    for i, t in items:
        own.setdefault(i, set()).update(split(t))
    out = []
    for i, ws in own.items():
        rows = []
        for doc_id, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * filled) // max(1, length)
            score = sum(math.floor(1000 * math.log((2 * filled + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 8 * m)) for w in ws if w in bag)
            if score > 0:
                rows.append((-score, doc_id is None, doc_id or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_terms", [1 << 20, 40])
def test_search_is_exact(spark, block_terms):
    items = [(1, "ka lo MIST tuing"), (2, None), (3, ""), (4, edge_texts()[8][1]), (4, "kana"), (None, "rést"), (None, "ha"), (5, "nothinglikeit"), (6, "日本 é ½"), (7, "one, two")]
    items += [(100 + i, prose(random.Random(i), 30)) for i in range(40)]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, rank string, score long")
    got = lexical_search.search(edge_docs(spark), table, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == best_documents(edge_texts(), items)


def test_search_of_nothing(spark):
    table = spark.createDataFrame([(1, "ka")], "item_id int, text string")
    assert lexical_search.search(empty_docs(spark), table).collect() == []
    assert lexical_search.search(edge_docs(spark), table.limit(0)).collect() == []
    assert lexical_search.search(edge_docs(spark).filter("doc_id < 3"), table).collect() == []


def test_partial_sums_stay_whole():
    """Weights so large that a tile is cut into single terms."""
    rng = np.random.default_rng(3)
    weight = rng.integers(1 << 31, 1 << 32, 50)
    at, item = np.tile(np.arange(50), 2), np.repeat([0, 1], 50)
    tile = lexical_search.Tile(np.arange(2), item, at, weight)
    assert tile.wide == 2
    places, doc = np.tile(np.arange(50), 3), np.repeat(np.arange(3), 50)
    impact = rng.integers(1, 10**6, 150)
    want = [[sum(int(weight[a]) * int(v) for a, d, v in zip(places, doc, impact) if d == col) for col in range(3)] for _ in range(2)]
    assert tile.scores(places, doc, impact, 3).tolist() == want


def test_best_keeps_ties_by_id():
    best = lexical_search.Best(2)
    best.take(np.array([5, 5, 5]), np.array([False, True, False]), np.array([9, 0, 7]))
    assert best.doc.tolist() == [7, 9] and best.floor == 5
    best.take(np.array([5, 4]), np.array([False, False]), np.array([8, 1]))
    assert best.doc.tolist() == [7, 8]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 64), st.integers(1, 5), st.integers(0, 6), st.integers(0, 10**9))
def test_filters_lose_nothing(width, n, shard_bits, seed):
    rng = np.random.default_rng(seed)
    bits = n * width
    shard_bits = min(shard_bits, bits - 1)
    ids = [rng.integers(0, (1 << width) - 1, 300, np.uint64, endpoint=True) % np.uint64(max(1, min((1 << width) - 1, 7))) if k % 2 else rng.integers(0, (1 << width) - 1, 300, np.uint64, endpoint=True) for k in range(n)]
    want = Counter(zip(*(i.tolist() for i in ids)))
    turn = quotient_filter.Permutation(bits)
    lanes = turn.there(quotient_filter.pack(ids, width))
    halves = [quotient_filter.counted([lane[a:b] for lane in lanes]) for a, b in ((0, 120), (120, 300))]
    by_shard = {}
    for part in halves:
        for f in quotient_filter.sharded(*part, bits, shard_bits):
            by_shard.setdefault(f.shard, []).append(quotient_filter.Filter.of(f.row(bits, shard_bits), bits, shard_bits))
    got = Counter()
    for filters in by_shard.values():
        own = quotient_filter.merged(filters)
        got.update(dict(zip(zip(*(c.tolist() for c in quotient_filter.unpack(turn.back(own.lanes), width, n))), own.counts.tolist())))
    assert got == want


def test_filters_are_put_together_in_little_memory():
    """Beside the runs there is one range at a time and what has been made of them; it was four times the runs."""
    rng = np.random.default_rng(3)
    runs = [quotient_filter.counted([rng.integers(0, 1 << 60, 1 << 18, np.uint64), rng.integers(0, 1 << 40, 1 << 18, np.uint64)]) for _ in range(8)]
    filters = [quotient_filter.Filter(0, *run) for run in runs]
    size = sum(x.nbytes for lanes, counts in runs for x in [*lanes, counts])
    tracemalloc.start()
    try:
        own = quotient_filter.merged(filters)
        assert tracemalloc.get_traced_memory()[1] < 2.6 * size
        want = quotient_filter.counted([np.concatenate(x) for x in zip(*(f.lanes for f in filters))], np.concatenate([f.counts for f in filters]))
        assert all((a == b).all() for a, b in zip([*own.lanes, own.counts], [*want[0], want[1]]))
        del own, want
        tracemalloc.reset_peak()
        assert sum(len(counts) for _, counts in quotient_filter.ranges(runs)) >= max(len(c) for _, c in runs)
        assert tracemalloc.get_traced_memory()[1] < size
    finally:
        tracemalloc.stop()


def test_filters_are_small():
    """A dense filter takes far less than the packed n-grams and counts themselves."""
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 26, 1 << 20, np.uint64))
    turn = quotient_filter.Permutation(26)
    own = quotient_filter.Filter(0, *quotient_filter.counted(turn.there([keys])))
    assert sum(map(len, own.row(26, 0)[3:])) < 3 * len(keys)


def phrases_of(rows, least, top):
    """(lang, rank, phrase, a, l, r, n, score) by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, 6) for i in range(len(ws) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(lang, p[i : i + k]) for (lang, p), a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if f[lang, p[i : i + k]] <= a}
    out = []
    for lang in n:
        rows = []
        for (own, p), a in candidates.items():
            if own == lang and (own, p) not in gone:
                cuts = [((1000 * a * n[lang]) // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [collocations.VOCABULARY, 0])
def test_collocations_by_plain_counting(spark, vocabulary):
    rows = [(["en", "de", None][k % 3], t) for k, (_, t) in enumerate(edge_texts())] + [("und", "ha ha! ha ha"), ("en", "Ka-Lo x\x0bka-lo X;ka-lo x")]
    table = spark.createDataFrame([(lang, t, "clash", 7) for lang, t in rows], "lang string, text string, word string, n long")
    got = collocations.collocations(table, least=4, top=25, vocabulary=vocabulary)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = phrases_of(rows, 4, 25)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50


def test_collocations_are_counted_over_many_slices(spark, monkeypatch):
    monkeypatch.setattr(collocations, "PENDING", 50)
    monkeypatch.setattr(collocations, "HELD", 100)
    monkeypatch.setattr(collocations, "SHARD_WORDS", 500)
    rng = random.Random(9)
    rows = [("en", prose(rng, 200)) for _ in range(40)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string").repartition(6), least=5)
    assert sorted(tuple(r) for r in got.collect()) == phrases_of(rows, 5, 2000)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(empty_docs(spark)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).collect() == []


def page_rows():
    long = "é" * 700 + "x" * 5000
    rows = [(1, "http://a.example/1", long), (2, None, long), (3, "http://a.example/ä b\r\nX: y", "short"), (4, "u", "short"), (5, "", None), (6, "u", ""), (7, "u", "y" * 100), (9, "u", "y" * 100), (8, "u", "y" * 100)]
    return [*rows, (7, "u", "y" * 100), (None, "u", "y" * 100), (None, "u", "z" * 300), (None, "v", "z" * 300), (10, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 40), (11, "u", "w" * 99), (12, "u", "w" * 99)]


def expected_records(rows, least=100):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= least and (html or "") in first and (i is None or i > first[html or ""])
        out.append((i, len(raw), sha256(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_archives_give_back_every_page(spark, chunk):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash", 1, b"x") for r in rows], "page_id long, url string, html string, digest string, chunk int, data binary").repartition(3)
    manifest = warc.write(pages, shared.new_folder(spark, "warc-test"), chunk=chunk, file_bytes=2000)
    chunks = warc.read(manifest, chunk=chunk).cache()
    assert sorted((tuple(r) for r in warc.records(chunks).collect()), key=str) == expected_records(rows)
    assert warc.dangling(chunks).isEmpty()
    parts = {}
    for r in chunks.filter("record_type = 'response'").orderBy("path", "record", "chunk").collect():
        own = parts.setdefault((r.path, r.record), [r.page_id, b"", -1])
        own[1] += bytes(r.data)
        assert r.chunk == own[2] + 1 and len(r.data) <= chunk
        own[2] = r.chunk
        assert (r.payload_bytes, r.payload_digest) == (len(own[1]), sha256(own[1]).hexdigest())
    html = {(i, (h or "").encode()) for i, _, h in rows}
    assert {(i, raw) for i, raw, _ in parts.values()} <= html
    assert {raw for _, raw, _ in parts.values()} == {raw for _, raw in html}
    assert chunks.filter("record_type = 'revisit' and data is not null").isEmpty()
    assert manifest.agg(F.sum("records")).first()[0] == len(rows) + manifest.count()
    chunks.unpersist()


def test_archives_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write(pages, shared.new_folder(spark, "warc-test"))
    assert manifest.collect() == [] and warc.records(warc.read(manifest)).collect() == []


def archive(payload: bytes, digest: str | None = None, packed: bool = True) -> bytes:
    out = io.BytesIO()
    writer = warc.Writer(out)
    writer.begin(1, "http://a.example/", len(payload), sha256(payload).hexdigest())
    for at in range(0, len(payload), 1000):
        writer.chunk(payload[at : at + 1000])
    writer.end()
    raw = out.getvalue()
    return raw if packed else gzip.decompress(raw)


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others_are_read_too(packed):
    payload = random.Random(4).randbytes(10_000)
    extra = b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    raw = archive(payload, packed=packed) + (gzip.compress(extra) if packed else extra)
    rows = list(warc.chunk_rows(io.BytesIO(raw), "p", 700))
    kinds = [r["record_type"] for r in rows if r["last"]]
    assert kinds == ["warcinfo", "response", "metadata"]
    assert b"".join(r["data"] for r in rows if r["record_type"] == "response") == payload
    assert rows[-1]["data"] == b"hello"


def test_damaged_archives_are_found():
    plain = archive(b"a" * 5000, packed=False)
    with pytest.raises(ValueError, match="damaged"):
        list(warc.chunk_rows(io.BytesIO(plain.replace(b"a" * 5000, b"a" * 4999 + b"b")), "p"))
    for cut in (len(plain) - 3, len(plain) - 100, 40):
        with pytest.raises(ValueError):
            list(warc.chunk_rows(io.BytesIO(plain[:cut]), "p"))
    packed = archive(b"a" * 5000)
    with pytest.raises(ValueError):
        list(warc.chunk_rows(io.BytesIO(packed[:-6]), "p"))
    writer = warc.Writer(io.BytesIO())
    writer.begin(1, None, 3, sha256(b"abc").hexdigest())
    writer.chunk(b"abd")
    with pytest.raises(ValueError):
        writer.end()
