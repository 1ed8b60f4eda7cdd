"""Keyword patterns, contained names, deep pages, counterfactual chunks and file checksums against plain loops."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from perkline import dims
from perkline.operators import catalog, fairness, ledger, quality
from perkline.operators import scoring as sc
from perkline.sources import files


def first_category(name, words):
    return next((c for c, kws in words.items() if any(k in name.lower() for k in kws)), None) if name is not None else None


@pytest.mark.parametrize("seed", range(4))
def test_keyword_patterns_find_the_first_category(spark, seed):
    """Keywords that begin, hold and overlap each other, with characters that mean something in patterns."""
    rng = random.Random(seed)
    words = {f"cat{i}": ["".join(rng.choice("ab.( é") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 4))] for i in range(6)}
    if seed == 3:
        words["any"] = ["zzz", ""]
    names = [None, "", *["".join(rng.choice("aAb.( éx") for _ in range(rng.randint(1, 12))) for _ in range(300)]]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string").withColumn("c", sc.merchant_category(F.col("name"), words)).collect()
    assert [r["c"] for r in sorted(rows)] == [first_category(n, words) for n in names]


def test_the_fixed_keywords(spark):
    names = [f"THE {w.upper()} 12" for ws in dims.MERCHANT_WORDS.values() for w in ws] + ["nothing of it"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string").withColumn("c", sc.merchant_category(F.col("name"))).collect()
    assert [r["c"] for r in sorted(rows)] == [first_category(n, dims.MERCHANT_WORDS) for n in names]


def test_shadowed_cards_are_those_inside_curated_names(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    curated = [(f"k{i}", " ".join(word() for _ in range(3)), rng.choice(["X", "y", None, ""])) for i in range(40)]
    cards = [(f"c{i}", rng.choice([None, "", " ".join(word() for _ in range(rng.randint(1, 2))), rng.choice(curated)[1].upper()]), rng.choice(["x", "Y ", None, ""])) for i in range(300)]
    schema = "card_id string, card_name string, issuer string"
    got = {r["card_id"] for r in catalog.without_shadowed(spark.createDataFrame(cards, schema), spark.createDataFrame(curated, schema)).collect()}
    key = lambda s: "".join(ch for ch in (s or "").lower() if ch.isalnum())

    def shadowed(name, issuer):
        n, i = key(name), key(issuer)
        return bool(n and i) and any(i == key(ci) and (n == key(cn) or n in key(cn) and len(n) / len(key(cn)) < 0.85) for _, cn, ci in curated)

    assert got == {i for i, name, issuer in cards if not shadowed(name, issuer)}
    assert 20 < len(got) < 290


def test_pages_however_deep(spark):
    rng = random.Random(1)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(3000)) if i % 40 else None, 1.0, 2.0) for i in range(3000)]
    d = spark.createDataFrame(rows, "id int, ts timestamp, reward_earned double, estimated_savings double").repartition(4).cache()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or dt.datetime(2024, 1, 1)).timestamp(), r[0]))
    for no, size in ((1, 20), (17, 33), (150, 20), (151, 20), (10**6, 20)):
        got = ledger.page(d, no, size, "id", chunk_values=100).collect()
        assert [r["id"] for r in got] == [r[0] for r in want[(no - 1) * size : no * size]]
        assert all(r["total"] == 3000 and r["has_next"] == (no * size < 3000) and r["total_rewards"] == 3000.0 for r in got)
    d.unpersist()


def test_counterfactuals_in_chunks(spark):
    rows = [(i, f"v{i % 30}" if i % 31 else None, float(i)) for i in range(200)]
    d = spark.createDataFrame(rows, "id int, kind string, x double")
    got = sorted((r["id"], r["kind"], r["original_value"]) for r in fairness.counterfactuals(d, ["kind"], per_chunk=4).collect() if r["original_value"])
    assert got == sorted((i, f"v{k}", v) for i, v, _ in rows if v for k in range(30) if f"v{k}" != v)
    assert fairness.counterfactuals(d.where("kind is null"), ["kind"]).count() == 0


def test_prompt_advice_by_measure(spark):
    d = spark.createDataFrame([("explanation_length_gap", True), ("readability", True), ("detail", False), ("other", True)], "name string, is_biased boolean")
    assert {r["name"]: r["suggestion"] for r in fairness.prompt_advice(d).collect()} == {"explanation_length_gap": dims.PROMPT_ADVICE[0][1], "readability": dims.PROMPT_ADVICE[1][1]}


def test_manifests_read_files_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "SLICE_BYTES", 1000)
    content = {"a b.bin": random.Random(1).randbytes(10_001), "sub/x%20y.txt": b"\n", "sub/z.gz": b"not really packed"}
    for name, raw in content.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(raw)
    rows = files.manifest(spark, str(tmp_path)).collect()
    assert {r["path"].split(f"{tmp_path}/")[1]: (r["bytes"], r["sha256"]) for r in rows} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in content.items()}
    assert [r["path"] for r in rows] == sorted(r["path"] for r in rows)


def test_card_rule_details(spark):
    rows = [(i, f"n{i}" if i % 4 else None, [0.5, 12.345, 11.0][i % 3], str(i * 1000), 0.5) for i in range(12)]
    d = spark.createDataFrame(rows, "ord int, card_name string, base_reward_rate double, annual_fee string, welcome_bonus_roi double")
    got = {r["check_name"]: (r["count"], r["max_value"], r["card_names"]) for r in quality.card_rule_details(d, "ord").collect()}
    assert got == {"domain_reward_rate_too_high": (8, 12.35, ["n1", "n2", None, "n5", "n7"]), "domain_annual_fee_extreme": (6, 11000.0, [])}
    assert quality.card_rule_details(d.limit(0), "ord").count() == 0
