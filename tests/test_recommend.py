"""Best cards of a catalogue against plain loops over all of it."""

from __future__ import annotations

import glob
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from perkline import dims
from perkline.operators import modeling, recommend
from perkline.sources import sinks

CATS = recommend.CATEGORIES


def up(x, digits):
    return math.floor(x * 10**digits + (0.5 + 1e-6)) / 10**digits


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.booleans())
def test_the_band_has_everyones_first(seed, k, high):
    """Whatever is spent and whatever the personas, the first k of all are in the band."""
    rng = np.random.default_rng(seed)
    n, dims_ = int(rng.integers(1, 400)), int(rng.integers(1, 4))
    rates = rng.integers(0, 4, (n, dims_)) / 2.0
    fee = rng.integers(0, 4, n) * 95.0
    ids = [f"c{x}" for x in rng.permutation(n)]
    kept = set(recommend.band(rates, fee, ids, k, high).tolist())
    for _ in range(12):
        spend = rng.integers(0, 3, dims_) * 50.0
        factor = float(rng.choice([0.5, 0.8])) if high else float(rng.choice([1.0, 2.0]))
        boost = float(rng.choice([1.0, 1.5]))
        raw = [up(float(r @ spend) / 100, 8) for r in rates]
        order = sorted(range(n), key=lambda i: (-up(raw[i] * boost - (factor - 1) * fee[i] / 12, 4), -raw[i], fee[i], ids[i]))
        assert set(order[:k]) <= kept


def catalogue(rng, n):
    rows = []
    for i in range(n):
        bonuses = {c: rng.choice([1.0, 2.0, 3.0, 4.5]) for c in ("dining", "travel", "gas", "drugstore") if rng.random() < 0.4}
        rows.append((f"c{i:04d}", f"Card {i}", rng.choice([0.0, 0.0, 95.0, 250.0, 550.0]), rng.choice([None, 1.0, 1.5, 2.0]), bonuses, "x"))
    return rows


CARD_SCHEMA = "card_id string, card_name string, annual_fee double, base_rate double, bonuses map<string,double>, rank string"


def first_cards(cards, amounts, personas, without=(), k=10):
    """(card, raw, score) of the first k cards for amounts by category, by a loop over all cards."""
    total = {}
    for c, a in amounts:
        total[c] = total.get(c, 0.0) + a
    main = min(total, key=lambda c: (-total[c], c))
    known = [p for p in sorted(set(personas)) if p in dims.PERSONAS]
    boost = sum(dims.PERSONAS[p][2].get(main, 1.0) for p in known) / len(known) if known else 1.0
    fee_x = sum(dims.PERSONAS[p][1] for p in known) / len(known) if known else 1.0
    out = []
    for cid, _, fee, base, bonuses, _ in cards:
        if cid in without:
            continue
        base = 1.0 if base is None else base
        raw = sum(a * bonuses.get(c, base) / 100 for c, a in total.items())
        score = up(raw * boost - (fee_x - 1) * fee / 12, 4) if known else up(raw, 8)
        out.append((-score, -up(raw, 8), fee, cid, raw))
    return [(cid, round(raw, 6), -s) for s, _, _, cid, raw in sorted(out)[:k]]


@pytest.mark.parametrize("limits", [None, (40, 16)])
def test_finder_and_portfolio(spark, monkeypatch, limits):
    if limits:  # several rounds and blocks
        monkeypatch.setattr(recommend, "FINAL_ROWS", limits[0])
        monkeypatch.setattr(recommend.best, "__defaults__", (recommend.TOP, limits[1]))
    rng = random.Random(7)
    cards = catalogue(rng, 300)
    people = [f"u{i}" for i in range(40)]
    spend = {u: [(c, rng.choice([10.0, 50.0, 120.0])) for c in rng.sample(["dining", "travel", "gas", "groceries", "other"], rng.randint(0, 4))] for u in people}
    saved = {u: rng.sample([c[0] for c in cards] + ["closed"], rng.choice([0, 0, 3, 40])) for u in people}
    personas = {u: rng.sample([*dims.PERSONAS, "gamer"], rng.randint(0, 3)) for u in people}
    monthly = {u: rng.choice([None, 0.0, -5.0, 500.0]) for u in people}
    args = (
        spark.createDataFrame([(u, monthly[u]) for u in people], "user_id string, monthly_spend double"),
        spark.createDataFrame([(u, c, a) for u in people for c, a in spend[u]], "user_id string, category string, amount double"),
        spark.createDataFrame([(u, c, i) for u in people for i, c in enumerate(saved[u] * 2)], "user_id string, card_id string, saved_order int"),
        spark.createDataFrame([(u, p) for u in people for p in personas[u]], "user_id string, persona string"),
        spark.createDataFrame(cards, CARD_SCHEMA),
    )
    for full in (True, False):
        got = {}
        for r in recommend.portfolio(*args, full_catalogue=full, k=4).orderBy("user_id", "rank").collect():
            got.setdefault(r.user_id, []).append((r.card_id, round(r.raw_reward, 6), r.score))
            assert r.is_generic == (not saved[r.user_id]) and r["rank"] == len(got[r.user_id])
        for u in people:
            amounts = spend[u] or [("other", monthly[u] if monthly[u] and monthly[u] > 0 else 100.0)]
            if full or not saved[u]:
                want = first_cards(cards, amounts, personas[u], saved[u], 4)
            else:
                want = first_cards([c for c in cards if c[0] in saved[u]], amounts, personas[u], (), len(cards))
            assert got.get(u, []) == want, u


def test_purchases_refunds_and_nothing(spark):
    rng = random.Random(3)
    cards = catalogue(rng, 120)
    rows = [(i, f"u{i % 5}", rng.choice([25.0, -40.0, 0.0, None, 300.0]), rng.choice(["dining", "Gas", "", None, "rockets"]), rng.choice(["Shell station", "nowhere", None])) for i in range(60)]
    personas = {"u0": ["student"], "u1": ["traveler"], "u2": ["family", "traveler"], "u3": ["gamer"]}
    got = recommend.for_purchases(
        spark.createDataFrame(rows, "id long, user_id string, amount double, category string, merchant string"),
        spark.createDataFrame([(u, p) for u, ps in personas.items() for p in ps], "user_id string, persona string"),
        spark.createDataFrame(cards, CARD_SCHEMA), ["id"], k=3,
    )
    found = {}
    for r in got.orderBy("id", "rank").collect():
        found.setdefault(r.id, []).append((r.category_used, r.card_id, round(r.raw_reward, 6), r.score))
    for i, user, amount, category, merchant in rows:
        used = category.lower() if category else "gas" if merchant == "Shell station" else "other"
        want = first_cards(cards, [(used, amount or 0.0)], personas.get(user, []), (), 3)
        assert found[i] == [(used, *x) for x in want], i


def test_no_cards_no_users(spark):
    none = spark.createDataFrame([], CARD_SCHEMA)
    users = spark.createDataFrame([("u", 10.0)], "user_id string, monthly_spend double")
    empty = [spark.createDataFrame([], s) for s in ("user_id string, category string, amount double", "user_id string, card_id string", "user_id string, persona string")]
    assert recommend.portfolio(users, *empty, none).collect() == []
    cards = spark.createDataFrame(catalogue(random.Random(1), 5), CARD_SCHEMA)
    assert recommend.portfolio(users.limit(0), *empty, cards).collect() == []
    assert recommend.portfolio(users, *empty, cards).count() == 5


def saved_trees(folder):
    """Trees of a saved forest as nested nodes, read from its files."""
    import pandas as pd

    rows = pd.concat([pd.read_parquet(f) for f in glob.glob(f"{folder}/stages/1_*/data/*.parquet")])
    trees = {}
    for tree, node in zip(rows["treeID"], rows["nodeData"]):
        trees.setdefault(tree, {})[node["id"]] = node
    return trees.values()


def test_a_saved_forest_predicts_what_its_trees_say(spark):
    rng = random.Random(5)
    rows = [(f"u{i}", rng.random(), rng.random(), None if i % 50 == 0 else 0.01 + 0.01 * (i % 7 > 3)) for i in range(300)]
    frame = spark.createDataFrame([(u, a, b + (y or 0) * 40, y) for u, a, b, y in rows], "user_id string, a double, b double, point_value double")
    folder = sinks.work_folder(spark, "forest")
    modeling.train_point_value(frame, ["a", "b"], folder, model=modeling.candidates("point_value", trees=5)["random_forest"])
    got = {r.user_id: r.point_value for r in modeling.predicted_point_values(frame, folder).collect()}

    def walk(nodes, x, i=0):
        node = nodes[i]
        if node["leftChild"] < 0:
            return node["prediction"]
        low = x[node["split"]["featureIndex"]] <= node["split"]["leftCategoriesOrThreshold"][0]
        return walk(nodes, x, node["leftChild"] if low else node["rightChild"])

    trees = list(saved_trees(folder))
    for r in frame.collect():
        assert got[r.user_id] == pytest.approx(sum(walk(t, (r.a, r.b)) for t in trees) / len(trees))
    assert len({round(v, 6) for v in got.values()}) > 5
    extra = modeling.predicted_point_values(frame.drop("b").withColumnRenamed("point_value", "z"), folder)
    assert extra.count() == 300


def test_rows_that_hide_no_card_cost_no_step_of_python():
    """Hidden cards are set for all rows at once; what most rows have, none, leaves the scores untouched."""
    value, place = np.arange(12.0).reshape(4, 3), {"a": 0, "b": 1, "c": 2}
    without = pa.array([None, ["x", "c", "a"], [], ["b", "b", None]], pa.list_(pa.string()))
    shown, left = recommend._shown(value, without, place)
    assert left.tolist() == [3, 1, 3, 2]
    assert np.isinf(shown).tolist() == [[False] * 3, [True, False, True], [False] * 3, [False, True, False]]
    assert (shown[~np.isinf(shown)] == value[~np.isinf(shown)]).all()
    tail, left = recommend._shown(value[:2], without.slice(2), place)
    assert left.tolist() == [3, 2] and np.isinf(tail).sum() == 1
    for none in (without.slice(0, 1), pa.array([None, []], pa.list_(pa.string()))):
        part = value[: len(none)]
        same, left = recommend._shown(part, none, place)
        assert same is part and left.tolist() == [3] * len(none)
