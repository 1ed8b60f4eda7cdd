from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkline import dims
from perkline.operators import scoring as sc

JAN, APR = dt.date(2024, 1, 15), dt.date(2024, 4, 15)
ROT = sc.Card("rot", base_rate=1.0, bonuses={"gas": 2.0}, rotating={"Q1": (["groceries"], 5.0)})
GOLD = sc.Card("gold", annual_fee=250.0, base_rate=1.0, bonuses={"dining": 4.0}, caps={"dining": 100.0})

# (case, card, amount, category, day, foreign, options, expected reward)
CASES = [
    ("base", sc.Card("c", base_rate=1.5), 80.0, "gas", JAN, 0, {}, 1.2),
    ("default when rates are missing", sc.Card("c"), 200.0, "gas", JAN, 0, {}, 2.0),
    ("category bonus", GOLD, 50.0, "dining", JAN, 0, {}, 2.0),
    ("rotating in its quarter", ROT, 100.0, "groceries", JAN, 0, {}, 5.0),
    ("rotating out of its quarter", ROT, 100.0, "groceries", APR, 0, {}, 1.0),
    ("bonus beside rotating", ROT, 100.0, "gas", JAN, 0, {}, 2.0),
    ("zero amount", GOLD, 0.0, "dining", JAN, 1, {"amortize_months": 12}, 0.0),
    ("foreign fee", sc.Card("f", base_rate=2.0, foreign_fee_pct=3.0), 100.0, "travel", JAN, 1, {}, -1.0),
    ("no foreign fee at home", sc.Card("f", base_rate=2.0, foreign_fee_pct=3.0), 100.0, "travel", JAN, 0, {}, 2.0),
    ("amortised fee", sc.Card("a", annual_fee=360.0, base_rate=2.0), 100.0, "gas", JAN, 0, {"amortize_months": 12}, 1.0),
    ("monthly credit", sc.Card("k", base_rate=1.0, credits={"dining": (10.0, "monthly")}), 100.0, "dining", JAN, 0, {"with_credits": True}, 3.5),
    ("quarterly credit", sc.Card("k", base_rate=1.0, credits={"dining": (30.0, "quarterly")}), 100.0, "dining", JAN, 0, {"with_credits": True}, 3.5),
    ("annual credit", sc.Card("k", base_rate=1.0, credits={"dining": (96.0, "annual")}), 100.0, "dining", JAN, 0, {"with_credits": True}, 3.0),
    ("credit capped at the purchase", sc.Card("k", base_rate=1.0, credits={"dining": (40.0, "monthly")}), 2.0, "dining", JAN, 0, {"with_credits": True}, 2.02),
    ("credit of another category", sc.Card("k", base_rate=1.0, credits={"gas": (40.0, "monthly")}), 100.0, "dining", JAN, 0, {"with_credits": True}, 1.0),
]


@pytest.mark.parametrize("name,card,amount,category,day,foreign,options,expected", CASES, ids=[c[0] for c in CASES])
def test_golden_rewards(spark, name, card, amount, category, day, foreign, options, expected):
    t = spark.createDataFrame([(amount, category, day, foreign)], "amount double, category string, txn_date date, is_foreign int")
    got = sc.score_portfolio(t, [card], **options).first()["reward_amount"]
    assert got == pytest.approx(expected, abs=1e-4)


def test_check_cases_counts_passes(spark):
    d = sc.check_cases(spark.createDataFrame([(1.0, 1.00005), (1.0, 1.1)], "actual double, expected double"))
    assert [r["passed"] for r in d.collect()] == [True, False]


def test_ranking_breaks_ties_by_fee_then_id(spark):
    t = spark.createDataFrame([("t1", 100.0, "gas", JAN)], "id string, amount double, category string, txn_date date")
    cards = [sc.Card("z", base_rate=2.0), sc.Card("b", annual_fee=95.0, base_rate=2.0), sc.Card("a", base_rate=2.0), sc.Card("top", annual_fee=500.0, base_rate=3.0)]
    ranked = sc.rank_portfolio(t, cards).orderBy("rank").collect()
    assert [r["card_id"] for r in ranked] == ["top", "a", "z", "b"]
    assert sc.best_card(t, cards).first()["best_card_id"] == "top"
    assert sc.rank_portfolio(t, cards, top_k=2).count() == 2


def test_refunds_zero_and_missing_amounts_rank_as_scored(spark):
    cards = [sc.Card("a", annual_fee=95.0, base_rate=1.0, bonuses={"gas": 3.0}), sc.Card("b", base_rate=2.0), ROT]
    rows = [(i, a, c, d) for i, (a, c, d) in enumerate((a, c, d) for a in (50.0, -20.0, 0.0, None) for c in ("gas", "groceries", "zoo", None) for d in (JAN, APR))]
    t = spark.createDataFrame(rows, "id int, amount double, category string, txn_date date")
    scored = {}
    for r in sc.score_portfolio(t, cards, foreign=None).collect():
        scored.setdefault(r["id"], []).append((-r["reward_amount"] if r["reward_amount"] is not None else 0.0, r["annual_fee"], r["card_id"]))
    ranked = {}
    for r in sc.rank_portfolio(t, cards).orderBy("id", "rank").collect():
        ranked.setdefault(r["id"], []).append(r["card_id"])
    best = {r["id"]: r["best_card_id"] for r in sc.best_card(t, cards).collect()}
    for i in scored:
        want = [c for _, _, c in sorted(scored[i])]
        assert ranked[i] == want and best[i] == want[0]


def _capped(rows, cap, bonus, base):
    spent, out = 0.0, []
    for amount in rows:
        left = max(cap - spent, 0.0)
        out.append(amount * (base if left <= 0 or left < amount else bonus) / 100)
        spent += max(amount, 0.0)
    return out


def test_caps_follow_a_running_tracker(spark):
    amounts = [30.0, 40.0, 25.0, 10.0, 50.0, -5.0, 2.0]
    rows = [(f"t{i}", "u", a, "dining", dt.date(2024, 1, 1 + i)) for i, a in enumerate(amounts)]
    t = spark.createDataFrame(rows, "transaction_id string, user_id string, amount double, category string, txn_date date")
    got = sc.score_with_caps(t, [GOLD]).orderBy("transaction_id").collect()
    assert [round(r["reward_amount"], 6) for r in got] == [round(x, 6) for x in _capped(amounts, 100.0, 4.0, 1.0)]
    assert got[3]["spent_before"] == 95.0 and got[3]["remaining_cap"] == 5.0 and got[3]["is_capped"]


def test_caps_reset_by_period(spark):
    rows = [("t1", "u", 90.0, "dining", dt.date(2023, 12, 31)), ("t2", "u", 90.0, "dining", dt.date(2024, 1, 1))]
    t = spark.createDataFrame(rows, "transaction_id string, user_id string, amount double, category string, txn_date date")
    assert not any(r["is_capped"] for r in sc.score_with_caps(t, [GOLD], period=F.year("txn_date")).collect())
    assert sum(r["is_capped"] for r in sc.score_with_caps(t, [GOLD]).collect()) == 1


def test_mcc_mapping_prefers_exact_codes(spark):
    codes = {5812: "dining", 5462: "dining", 3100: "travel", 3400: "general", 5817: "streaming", 4121: "travel", 9999: "general"}
    df = spark.createDataFrame([(k,) for k in codes], "m int")
    assert {r["m"]: r["c"] for r in df.select("m", sc.mcc_category(F.col("m")).alias("c")).collect()} == codes
    assert df.where("m = 9999").select(sc.mcc_category(F.col("m"), {9999: "special"}).alias("c")).first()["c"] == "special"


def test_category_precedence(spark):
    df = spark.createDataFrame([("Uber Eats", None), ("Uber", None), ("Shop", "GAS"), ("Shop", ""), ("Corner Cafe", "gas")], "m string, h string")
    first = [r["c"] for r in df.select(sc.resolve_category(F.col("m"), F.col("h")).alias("c")).collect()]
    words = [r["c"] for r in df.select(sc.resolve_category(F.col("m"), F.col("h"), hint_first=False).alias("c")).collect()]
    assert first == ["dining", "travel", "gas", "other", "gas"]
    assert words == ["dining", "travel", "gas", "other", "dining"]


def test_welcome_bonus_eligibility(spark):
    rows = [(True, False, 30, 90), (True, True, 30, 90), (True, None, 91, None), (True, None, 90, None), (False, False, 1, 90), (None, None, None, None)]
    df = spark.createDataFrame(rows, "b boolean, r boolean, t int, w int")
    e = sc.welcome_bonus_eligible(F.col("b"), F.col("r"), F.col("t"), F.col("w"))
    assert [r["x"] for r in df.select(e.alias("x")).collect()] == [True, False, False, True, False, False]


def test_personas_average_and_ignore_unknown(spark):
    ranked = spark.createDataFrame(
        [("u", "a", 10.0, 120.0, 1, "dining"), ("u", "b", 9.0, 0.0, 2, "dining"), ("n", "a", 10.0, 120.0, 1, "dining")],
        "user_id string, card_id string, reward_amount double, annual_fee double, rank int, category string",
    )
    personas = spark.createDataFrame([("u", "student"), ("u", "traveler"), ("u", "gamer"), ("n", "gamer")], "user_id string, persona string")
    got = {(r["user_id"], r["card_id"]): r for r in sc.apply_personas(ranked, personas, ["user_id"]).collect()}
    assert got["u", "a"]["category_boost"] == pytest.approx(1.1) and got["u", "a"]["fee_multiplier"] == pytest.approx(1.25)
    assert got["u", "a"]["adjusted_reward"] == pytest.approx(11.0 - 0.25 * 120 / 12)
    assert got["u", "b"]["rank"] == 1 and got["u", "a"]["rank"] == 2
    assert got["n", "a"]["adjusted_reward"] == 10.0 and got["n", "a"]["rank"] == 1


def test_unusable_predictions_fall_back(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-1.0,), (0.0,), (0.02,)], "p double")
    assert [r["x"] for r in df.select(sc.usable_point_value(F.col("p")).alias("x")).collect()] == [1.0, 1.0, 1.0, 1.0, 0.02]


def test_profile_purchases(spark):
    raw = spark.createDataFrame([("u", " Dining ", "100"), ("u", "pets", "50"), ("u", "gas", "-5"), ("u", "x", "abc")], "user_id string, raw_category string, raw_amount string")
    spend = sc.normalize_spend(raw)
    assert {r["category"]: r["amount"] for r in spend.collect()} == {"dining": 100.0, "other": 50.0}
    profiles = spark.createDataFrame([("u", 400.0), ("v", None)], "user_id string, monthly_spend double")
    got = {(r["user_id"], r["merchant"]): r["amount"] for r in sc.profile_purchases(profiles, spend).collect()}
    assert got["u", "monthly_spend_remainder"] == 250.0 and got["v", "default_spend"] == 1000.0


def test_savings_against_first_flat_card(spark):
    cat = sc.card_frame(spark, sc.curated_portfolio())
    saved = spark.createDataFrame([("u", "amex_gold", 1), ("u", "citi_double_cash", 2), ("v", "amex_gold", 1)], "user_id string, card_id string, saved_order int")
    spend = spark.createDataFrame([("u", "dining", 200.0), ("u", "gas", 100.0), ("v", "dining", 200.0)], "user_id string, category string, amount double")
    base = sc.baseline_cards(saved, cat)
    got = {(r["user_id"], r["card_id"]): r for r in sc.savings(spend, saved.select("user_id", "card_id"), cat, base).collect()}
    assert got["u", "amex_gold"]["monthly_uplift"] == pytest.approx(200 * 0.02 - 100 * 0.01)
    assert got["u", "amex_gold"]["net_annual_benefit"] == pytest.approx(3 * 12 - 250)
    assert got["v", "amex_gold"]["baseline_card_id"] is None and got["v", "amex_gold"]["monthly_uplift"] == pytest.approx(6.0)


def test_default_spend_scales():
    s = sc.default_spend(2000.0)
    assert s["groceries"] == 800.0 and sum(s.values()) == pytest.approx(2000.0)


def test_ranking_counts_the_foreign_fee(spark):
    cards = [sc.Card("a", base_rate=2.0, foreign_fee_pct=3.0), sc.Card("b", base_rate=1.5)]
    t = spark.createDataFrame([(1, 100.0, "x", JAN, 1), (2, 100.0, "x", JAN, 0)], "id int, amount double, category string, txn_date date, is_foreign int")
    assert {r["id"]: (r["best_card_id"], round(r["best_reward"], 6)) for r in sc.best_card(t, cards).collect()} == {1: ("b", 1.5), 2: ("a", 2.0)}
    assert [r["card_id"] for r in sc.rank_portfolio(t, cards).where("id = 1").orderBy("rank").collect()] == ["b", "a"]


def test_ranking_counts_credits_amortised_fees_and_caps(spark):
    cards = [sc.Card("gold", annual_fee=360.0, base_rate=1.0, bonuses={"gas": 4.0}, caps={"gas": 500.0}, credits={"zoo": (8.0, "monthly")}), sc.Card("flat", base_rate=1.5)]
    t = spark.createDataFrame([(1, 200.0, "gas", 100.0), (2, 200.0, "gas", 400.0), (3, 10.0, "gas", 0.0), (4, 10.0, "zoo", 0.0)], "id int, amount double, category string, spent double")
    got = {r["id"]: r["best_card_id"] for r in sc.best_card(t, cards, day=None, amortize_months=12, with_credits=True, spent="spent").collect()}
    assert got == {1: "gold", 2: "flat", 3: "flat", 4: "gold"}


def test_portfolios_have_no_size_limit(spark):
    t = spark.createDataFrame([(1.0, "gas")], "amount double, category string")
    assert sc.best_card(t, [sc.Card(str(i), base_rate=i / 100) for i in range(600)], day=None).first()["best_card_id"] == "599"


def test_card_tables_rank_like_portfolios(spark):
    own = [sc.Card(f"c{i}", annual_fee=float(i % 4), base_rate=(i % 7) / 2, bonuses={"gas": float(i % 5)} if i % 3 else {}, foreign_fee_pct=float(i % 2) * 2) for i in range(40)]
    table = spark.createDataFrame([(c.card_id, c.annual_fee, c.base_rate, dict(c.bonuses), c.foreign_fee_pct) for c in own], "card_id string, annual_fee double, base_rate double, bonuses map<string,double>, foreign_fee_pct double")
    t = spark.createDataFrame([(i, 10.0 + i, c, f) for i, (c, f) in enumerate((c, f) for c in ("gas", "zoo", None) for f in (0, 1, None))], "id int, amount double, category string, is_foreign int")
    want = [(r["id"], r["rank"], r["card_id"]) for r in sc.rank_portfolio(t, own, top_k=4, day=None).collect()]
    got = sc.rank_card_table(t, table, top_k=4).collect()
    assert sorted((r["id"], r["rank"], r["card_id"]) for r in got) == sorted(want)
    assert sc.rank_card_table(t, table.limit(0)).count() == 0
    back = t.withColumn("amount", F.when(F.col("id") % 3 == 0, -F.col("amount")).when(F.col("id") % 3 == 1, 0.0).when(F.col("id") < 8, F.col("amount")))
    want = [(r["id"], r["rank"], r["card_id"]) for r in sc.rank_portfolio(back, own, top_k=4, day=None).collect()]
    got = sc.rank_card_table(back, table, top_k=4).collect()
    assert sorted((r["id"], r["rank"], r["card_id"]) for r in got) == sorted(want) and len(want) == 36


def test_only_the_first_cards_of_a_task_are_sorted_and_purchases_stay_where_they_are(spark):
    rows = [(f"c{i * 7919 % 4000}", None if i % 50 == 0 else float(i % 3), float(i % 4) / 2, {"gas": float(i % 5)} if i % 3 else {}, float(i % 2) * 2) for i in range(4000)]
    table = spark.createDataFrame(rows, "card_id string, annual_fee double, base_rate double, bonuses map<string,double>, foreign_fee_pct double").repartition(3)
    best = sc.best_by_category(table, top_k=7)
    want = []
    for c in ("", "gas"):
        for abroad in (False, True):
            for sign in (1, -1, 0):
                net = [(-sign * (b.get(c, r) - (x if abroad else 0.0)), f is not None, f or 0.0, i) for i, f, r, b, x in rows]
                want += [(c, abroad, sign, k + 1, n[3]) for k, n in enumerate(sorted(net)[:7])]
    assert sorted((r["category"], r["foreign"], r["sign"], r["rank"], r["card_id"]) for r in best.collect()) == sorted(want)
    pages = list(sc._first_of_pages(iter(pd.DataFrame({"card_id": [f"c{i}" for i in at], "name_order": [f"c{i}" for i in at], "annual_fee": 0.0, "fee_order": 0.0, "fee": 1.0, "rates": [[float(i % 9)] for i in at]}) for at in (range(0, 500), range(500, 1000))), 7))
    assert sum(map(len, pages)) == 6 * 7
    t = spark.createDataFrame([(1, 10.0, "gas", 0)], "id int, amount double, category string, is_foreign int")
    assert "SortMergeJoin" not in sc.rank_card_table(t, table)._jdf.queryExecution().toString()


def test_finder_leaves_out_the_wallet(spark):
    users = spark.createDataFrame([("u",), ("v",)], "user_id string")
    saved = spark.createDataFrame([("u", "amex_gold")], "user_id string, card_id string")
    got = sc.finder(users, saved, sc.curated_portfolio())
    assert got.where("user_id = 'u'").count() == len(dims.CURATED_CARDS) - 1 and got.where("user_id = 'v'").count() == len(dims.CURATED_CARDS)
