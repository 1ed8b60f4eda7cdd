"""Classifier, languages, suffix tree, line rules and the pipeline."""

from __future__ import annotations

import collections
import math
import random
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from perkline.llm import byte_cnn, language_masks, line_rules, queries, shared, suffix_tree
from tests.llm.helpers import LOWER, edge_docs, edge_texts, empty_docs, prose, words

ROOT = Path(__file__).resolve().parents[2]
DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="driver tables are absent")


def test_places_cover_every_byte():
    sizes = [0, 1, 3, 8, 130, 384, 512, 513, 2000]
    at = np.concatenate([[0], np.cumsum(sizes)])
    _, spots, first_place, first_chunk = byte_cnn.places(np.zeros(at[-1], np.uint8), at)
    seen = np.zeros(at[-1] + byte_cnn.WIDTH, bool)
    for k in range(byte_cnn.WIDTH):
        seen[spots + k] = True
    assert seen[: at[-1]].all()
    chunks = np.diff(first_chunk)
    assert chunks[0] == 0 and (chunks[1:] > 0).all() and first_place[-1] == len(spots)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    texts = [prose(random.Random(i), 60).encode() for i in range(4)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    raw, label = np.frombuffer(b"".join(texts), np.uint8), np.array([0.0, 1, 1, 0])
    net = byte_cnn.new_network(1)
    net.out = rng.normal(size=net.out.shape).astype(np.float32)
    for part in net.parts():
        part += rng.normal(0, 0.05, part.shape).astype(np.float32)

    def loss():
        p = byte_cnn.scores(net, raw, at)
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for part, grad in zip(net.parts(), byte_cnn._gradients(net, raw, at, label)):
        spot = np.unravel_index(np.argmax(np.abs(grad)), grad.shape)
        old = part[spot]
        part[spot] = old + 2e-3
        up = loss()
        part[spot] = old - 2e-3
        down = loss()
        part[spot] = old
        assert (up - down) / 4e-3 == pytest.approx(grad[spot], rel=0.1, abs=1e-3)


def test_classifier_learns_and_takes_edge_cases(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 80) if i % 2 else " | ".join(prose(rng, 2) for _ in range(40))) for i in range(240)]
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(None, "a", "x"), (900, None, "x")], "doc_id long, text string, l string")
    labels = spark.createDataFrame([(i, i % 2, None) for i, _ in rows] + [(0, None, 1), (900, 5, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held_out = byte_cnn.fold(F.col("doc_id"), 3, 1)
    net = byte_cnn.fit(docs, labels, held_out=held_out)
    got = {r["doc_id"]: r for r in byte_cnn.scored(docs, net).collect()}
    test = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(test) > 50 and np.mean([got[i]["predicted"] == i % 2 for i in test]) > 0.95
    assert byte_cnn.kept(docs, net).columns == docs.columns
    edge = byte_cnn.scored(edge_docs(spark), net).collect()
    assert len(edge) == len(edge_texts()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in edge)
    by_text = collections.defaultdict(set)
    for r in edge:
        by_text[r["doc_id"]].add(r["score"])
    assert len(by_text[10]) == 1 and by_text[30] == by_text[31] and by_text[0] == by_text[1]
    assert byte_cnn.kept(edge_docs(spark), net).columns == edge_docs(spark).columns
    none = byte_cnn.fit(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in byte_cnn.scored(docs, none).collect()} == {1.0}
    assert byte_cnn.scored(empty_docs(spark), byte_cnn.fit(empty_docs(spark), labels.limit(0))).count() == 0


def test_languages(spark):
    rng = random.Random(2)
    sounds = {"aa": "bdgaeo", "bb": "ptkiuü", "cc": "mnlaeí"}

    def text(lang, n):
        return " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    docs = spark.createDataFrame([*rows, (500, None, "aa"), (501, "12 !", "bb"), (502, text("aa", 30), None)], "doc_id long, text string, lang string")
    masks = language_masks.learned(docs.filter("doc_id % 4 != 0"))
    assert masks.langs == ["aa", "bb", "cc"]
    got = {r["doc_id"]: r for r in language_masks.identified(docs, masks).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows) and got[502]["lang_pred"] == "aa"
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0) for i in (500, 501))
    edge = language_masks.identified(edge_docs(spark), masks).collect()
    assert len(edge) == len(edge_texts()) and all(0 <= r["score"] <= 1 for r in edge)
    assert language_masks.kept(edge_docs(spark), masks).columns == edge_docs(spark).columns
    nothing = language_masks.learned(empty_docs(spark))
    assert {r["lang_pred"] for r in language_masks.identified(docs, nothing).collect()} == {"und"}
    assert language_masks.identified(empty_docs(spark), masks).count() == 0


def test_masks_give_all_languages_of_a_gram(spark):
    docs = spark.createDataFrame([(1, "abc abd", "x"), (2, "abc xyz", "y")], "doc_id long, text string, lang string")
    masks = language_masks.learned(docs)
    grams = language_masks.trigrams(["abc", "abd", "xyz"])
    bits = masks.look_up(grams[0])[:, 0]
    inner = {t: int(b) for g, t, b in zip(*grams[:2], bits) if g >> 42 != 32 and g & (1 << 21) - 1 != 32}
    assert inner == {0: 3, 1: 1, 2: 2}


def test_suffix_tree_scores(spark):
    rng = random.Random(11)
    follow = {"a": "b", "b": "c", "c": "a"}

    def text():
        w, out = rng.choice("abc"), []
        for _ in range(60):
            out.append(w)
            w = follow[w] if rng.random() < 0.9 else rng.choice("abc") + rng.choice("xyzXYZ")
            w = w if w in follow or rng.random() < 0.5 else rng.choice("abc")
            if w not in follow:
                out.append(w)
                w = rng.choice("abc")
        return " ".join(out)

    rows = [(i, text()) for i in range(300)] + [(400 + i, t) for i, t in edge_texts() if i is not None] + [(None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_tree.scored(docs, byte_cnn.fold(F.col("doc_id"), 7, 2)).collect()
    assert len(got) == len(rows)
    counts, own = collections.Counter(), {}
    for i, t in rows:
        own.setdefault(i, []).append([*words((t or "").translate(LOWER)), "\n"])
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(own[i][-1])
    total, kinds = sum(counts.values()), len(counts)
    for r in got:
        fits = [w for w in own[r["doc_id"]] if len(w) == r["n_tokens"]]
        assert any(r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)) for w in fits)
        assert r["train_tokens"] == total and r["score"] <= 0 and r["n_known"] <= r["n_tokens"]
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert len(held) > 20 and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)
    assert suffix_tree.scored(empty_docs(spark), F.lit(False)).count() == 0
    assert {r["score"] for r in suffix_tree.scored(docs, F.lit(True)).collect()} == {0.0}


def test_suffix_tree_deletes_its_tables_when_the_answers_are_stored(spark):
    folder = Path(shared.shared_folder(spark))
    before = set(folder.iterdir())
    docs = spark.createDataFrame([(i, "a b c " * 20) for i in range(30)], "doc_id long, text string")
    assert suffix_tree.scored(docs, F.lit(False)).count() == 30
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before} == {"answers"}


def test_distributions_sum_to_one(spark):
    docs = spark.createDataFrame([(i, "a b " * 30 + "c " * (i % 3) + f"r{i}") for i in range(40)], "doc_id long, text string")
    counts, tree = suffix_tree.learned(docs)
    assert any(n["stays"].any() for n in tree.nodes)
    known = {r["key"]: r["n"] for r in counts.collect()}
    from perkline.llm.words import words as hashed
    import pyarrow as pa

    for context in ("a", "b", "a b", "c"):
        total = 0.0
        symbols = ["a", "b", "c", *[f"r{i}" for i in range(40)], None, "unknown"]
        for s in symbols:
            found = hashed(pa.array([context if s is None else f"{context} {s}"]))
            ids, is_word, _ = suffix_tree._symbols(tree, found.hashes, found.first)
            count = np.full(len(ids), tree.documents)
            count[is_word] = [known.get(int(h.view(np.int64)), 0) for h in found.hashes]
            p = suffix_tree.probabilities(tree, ids, is_word, count)
            total += p[len(context.split())]
        assert total == pytest.approx(1, abs=1e-9)


def plain_tree(texts, depth):
    """Probabilities by dictionaries: (tokens -> list of probabilities), and the retained contexts."""
    lines = [[*words((t or "").translate(LOWER)), None] for t in texts]
    n = collections.Counter(tuple(w[i - d : i + 1]) for w in lines for i in range(len(w)) for d in range(min(i, depth) + 1))
    tokens, kinds = sum(map(len, lines)), sum(len(k) == 1 for k in n)
    once, twice = (sum(v == x for k, v in n.items() if len(k) == 1 and k != (None,)) for x in (1, 2))
    discount = once / (once + 2 * twice) if once else 0.5
    spare = {}

    def p(context, symbol):
        if not context:
            seen = n.get((symbol,), 0)
            return (seen - discount) / tokens if seen else max(discount * kinds / tokens, 1 / (tokens + 1))
        lower = p(context[1:], symbol)
        if context not in spare:
            return lower
        seen = n.get((*context, symbol), 0)
        return (max(seen - 0.75, 0) / n[context] if seen >= 2 else 0) + spare[context] * lower

    for d in range(1, depth + 1):
        nexts = collections.defaultdict(list)
        for k, v in n.items():
            if len(k) == d + 1 and v >= 2:
                nexts[k[:-1]].append((k[-1], v))
        more = {}
        for context, follow in nexts.items():
            total, suffix = n[context], [p(context[1:], s) for s, _ in follow]
            gain = sum(v * math.log(v / total / q) for (_, v), q in zip(follow, suffix))
            rest = 1 - sum(v for _, v in follow) / total
            gain += total * rest * math.log(rest / max(1 - sum(suffix), 1e-9)) if rest > 1e-9 else 0
            if gain > 0.5 * len(follow) * math.log(max(total, 2)):
                more[context] = 1 - sum(v - 0.75 for _, v in follow) / total
        spare.update(more)
    return (lambda t: [p(tuple(w[max(0, i - depth) : i]), w[i]) for w in [[*words((t or "").translate(LOWER)), None]] for i in range(len(w))]), spare


def test_suffix_tree_grows_with_the_corpus(spark):
    """Contexts and next words far below 1e-4 of the tokens count, at every depth, as in plain Python."""
    def corpus(n):
        rng = random.Random(6)
        return [prose(rng, 120) + f" rare{i // 4} then{i // 4} last{i // 4} " + prose(rng, 60) for i in range(n)]

    kept = {}
    for n in (300, 600):
        texts = corpus(n)
        docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
        counts, tree = suffix_tree.learned(docs)
        chances, spare = plain_tree(texts, suffix_tree.DEPTH)
        assert [len(x["stays"]) for x in tree.nodes] == [sum(len(c) == d for c in spare) for d in range(1, suffix_tree.DEPTH + 1)]
        assert {(f"rare{i}",) for i in range(n // 4)} | {(f"rare{i}", f"then{i}") for i in range(n // 4)} <= {*spare}
        got = {r["doc_id"]: r["score"] for r in suffix_tree.scored(docs, F.lit(False)).collect()}
        for i in range(0, n, 29):
            assert got[i] == pytest.approx(sum(math.log10(x) for x in chances(texts[i])), abs=1e-6)
        kept[n] = len(spare)
    assert 4 < 1e-4 * sum(len(words(t)) for t in texts)
    assert kept[600] > 1.5 * kept[300]
    held = spark.createDataFrame([(0, texts[0]), (1, "rare3 then3 last3"), (2, "ka then3 last3 nowhere"), (3, None)], "doc_id long, text string")
    both = docs.select((F.col("doc_id") + 100).alias("doc_id"), "text").unionByName(held)
    got = {r["doc_id"]: r["score"] for r in suffix_tree.scored(both, F.col("doc_id") < 100).collect()}
    for i, t in held.collect():
        assert got[i] == pytest.approx(sum(math.log10(x) for x in chances(t)), abs=1e-6)


def test_line_rules_against_sql(spark):
    rng = random.Random(4)
    common = "Home | About us | Contact"
    rows = [(i, f"{common}\n{prose(rng, 70)}", "en", "a", 0) for i in range(45)] + [(100 + i, "\n".join([common, "All  rights RESERVED 2024"] * 8) + "\nx y", "en", "a", 0) for i in range(30)]
    rows += [(200, "a b c " * 40, "en", None, 0), (201, prose(rng, 49), "en", None, 0), (202, "same line here\n\n" * 30, "de", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").unionByName(edge_docs(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cursor = con.execute(line_rules.ORACLE)
    names = [c[0] for c in cursor.description]
    want = sorted((dict(zip(names, r)) for r in cursor.fetchall()), key=str)
    out = line_rules.judge(docs)
    got = sorted(({c: r[c] for c in names} for r in out.collect()), key=str)
    assert got == want
    depleted = {r["doc_id"] for r in got if not r["kept"] and not r["base_failed"]}
    assert depleted <= set(range(100, 130)) and all(r["kept"] for r in got if r["doc_id"] is not None and r["doc_id"] < 45 and r["doc_id"] >= 12 and r["n_words"] > 60)
    assert line_rules.judge(empty_docs(spark)).count() == 0
    clash = line_rules.judge(edge_docs(spark), host="host")
    assert clash.count() == len(edge_texts())


def test_line_rules_run_no_python(spark):
    plan = line_rules.judge(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@needs_data
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kind, sizes = docs.dtypes, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).toPandas(), docs.schema)
        assert docs.dtypes == kind
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.8 * sizes[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    again = corpus_pipeline.run(spark, DATA).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_the_rest_does_without_the_subpackage(monkeypatch):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op1_pattern_packing" in entry.queries()
    every = len(entry.queries())
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    assert len(entry.queries()) == every - 1 and "pipeline" not in entry.queries()
    monkeypatch.setitem(sys.modules, "perkline.llm.queries", None)
    assert entry.queries() and not any(n.startswith("op1_") for n in entry.queries()) and "pipeline" not in entry.queries()
    for path in (ROOT / "perkline").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "perkline.llm" not in path.read_text()
