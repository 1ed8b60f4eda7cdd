from __future__ import annotations

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from perkline.operators import catalog, cleaning, features
from perkline.operators import scoring as sc

CARDS = "ord int, card_id string, card_name string, issuer string, annual_fee string, reward_rates map<string,double>, welcome_bonus string, discontinued boolean"


def cards(spark, rows):
    return spark.createDataFrame(rows, CARDS)


BASE = [
    (1, "a", "Gold Card®", "amex", "250", {"universal_base_rate": 2.0}, "$200 bonus", False),
    (2, "b", "gold  card", "AMEX", "95", None, "60,000 points after $4,000 spend in 3 months", None),
    (3, "c", "Blue", "chase", "1000", {}, None, True),
    (4, "d", "Red", "chase", "-50", {}, None, True),
    (5, "e", "Green", None, "0", {}, None, True),
]


def test_cards_dedupe_by_name_and_issuer_when_ids_are_unique(spark):
    got = cleaning.clean_cards(cards(spark, BASE), F.col("ord")).orderBy("ord").collect()
    assert [r["card_id"] for r in got] == ["a", "e"]
    assert got[0]["issuer"] == "AMERICAN EXPRESS" and got[0]["card_name_original"] == "Gold Card®" and got[0]["welcome_bonus_unit"] == "dollars"
    assert got[1]["issuer"] == "UNKNOWN" and got[1]["reward_rates"] == {"universal_base_rate": 1.0} and got[1]["is_active"] == 0


def test_cards_dedupe_by_id_when_ids_repeat(spark):
    rows = [*BASE, (6, "a", "Other", "chase", "10", {"x": 1.0}, None, False)]
    assert cleaning.has_repeated_ids(cards(spark, rows))
    got = cleaning.dedupe_cards(cleaning.standardize_cards(cards(spark, rows)), F.col("ord"))
    assert sorted(r["ord"] for r in got.collect()) == [1, 2, 3, 4, 5]


def test_card_report_keeps_two_missing_counts(spark):
    rep = {r["rule"]: r["n"] for r in cleaning.card_report(cards(spark, BASE), F.col("ord")).collect()}
    assert (rep["initial_count"], rep["after_dedup"], rep["missing_reward_rates"], rep["empty_reward_rates"]) == (5, 4, 0, 3)
    assert (rep["annual_fee_removed"], rep["final_count"]) == (2, 2)


def test_transactions(spark):
    rows = [
        ("t1", "u", "2024-01-05", "", "m", 5812, 100.0),
        ("t2", "u", "2024-01-05", None, "m", 5812, 100.0),
        ("t3", "u", "2024-01-05", " Gas ", "m", 1234, None),
        ("t4", "u", "2024-01-05", "gas", "m", None, 0.0),
        ("t5", "u", "2030-01-05", "gas", "m", 5812, 5.0),
        ("t6", "u", "bad", "gas", "m", 5812, 5.0),
        ("t7", "u", "2001-01-05", "gas", "m", 5812, 20000.0),
        ("t8", "u", "2024-01-05", "gas", "m", 5812, -1.0),
    ]
    raw = spark.createDataFrame(rows, "transaction_id string, user_id string, date_text string, category string, merchant string, mcc_code int, amount double")
    got = {r["transaction_id"]: r for r in cleaning.clean_transactions(raw, "2024-06-01").collect()}
    assert sorted(got) == ["t1", "t2", "t3", "t4", "t7"]
    assert got["t1"]["category"] == got["t2"]["category"] == "unknown" and got["t3"]["category"] == "gas"
    assert (got["t1"]["is_potential_duplicate"], got["t2"]["is_potential_duplicate"]) == (0, 1)
    assert got["t1"]["is_round_amount"] == 1 and got["t7"]["is_old_transaction"] == 1 and got["t7"]["suspicious"] == 1
    assert not got["t3"]["mcc_valid"] and not got["t4"]["mcc_valid"]
    rep = {r["rule"]: r["n"] for r in cleaning.transaction_report(raw, "2024-06-01").collect()}
    assert (rep["negative_amounts"], rep["future_dates"], rep["invalid_dates"], rep["missing_categories"], rep["final_count"]) == (1, 1, 1, 2, 5)


def test_users_take_the_median_of_kept_rows(spark):
    rows = [(1, "u1", "100", "high_roller"), (2, "u1", "900000", "x"), (3, "u2", None, "x"), (4, "u3", "300", "high_roller")]
    df = spark.createDataFrame(rows, "ord int, user_id string, monthly_budget string, archetype string")
    got = {r["user_id"]: r["monthly_budget"] for r in cleaning.clean_users(df, F.col("ord")).collect()}
    assert got == {"u1": 100.0, "u2": 200.0, "u3": 300.0}


def test_catalogue_overlay(spark):
    feed = spark.createDataFrame(
        [
            ("nerdwallet", 1, "Gold", "AMERICAN_EXPRESS", "2x", 5.0), ("issuers", 2, "Capital One Venture", "Capital One", "2%", 95.0),
            ("creditcardbonuses_api", 3, "Own Card", "Bank", "1.5%", -5.0), ("issuers", 4, "own  card", " bank ", "9%", 1.0),
            ("issuers", 5, "Best for: x", "Bank", "2%", 1.0), ("issuers", 6, "Odd", "Bank", "40%", 1.0), ("issuers", 7, "Amex Gold", "Chase", "3%", 1.0),
        ],
        "source string, ord int, name string, issuer string, base_reward_rate string, annual_fee double",
    )
    merged = catalog.merge_feeds(feed)
    assert sorted(r["ord"] for r in merged.collect()) == [1, 2, 3, 6, 7]
    loaded = catalog.loadable_cards(merged)
    assert {r["card_id"]: (r["base_rate"], r["annual_fee"]) for r in loaded.collect()}["own_card"] == (1.5, 0.0)
    curated = sc.card_frame(spark, sc.curated_portfolio()).drop("bonuses")
    ids = {r["card_id"] for r in catalog.overlay(loaded, curated).collect()}
    assert {"capital_one_venture", "own_card", "amex_gold"} <= ids and "gold" not in ids and "odd" not in ids
    assert len(ids) == 9 + 2


def txns(spark):
    rows = [
        ("t1", "u", dt.date(2024, 1, 6), "dining", "m1", 5812, 10.0, "A", 0), ("t2", "u", dt.date(2024, 1, 8), "dining", "m1", 5812, 30.0, "B", 1),
        ("t3", "u", dt.date(2024, 2, 10), "gas", "m2", 5541, 20.0, "A", 0), ("t4", "u", dt.date(2024, 2, 10), "gas", "m3", 5541, 40.0, "A", 0),
        ("t5", "v", dt.date(2024, 3, 1), "zoo", "m9", 7999, 5.0, "C", 0),
    ]
    return spark.createDataFrame(
        rows, "transaction_id string, user_id string, txn_date date, category string, merchant string, mcc_code int, amount double, card_used string, suspicious int"
    )


def test_user_features(spark):
    got = {r["user_id"]: r for r in features.user_features(txns(spark)).collect()}
    u, v = got["u"], got["v"]
    assert (u["dining_total_spent"], u["gas_txn_count"], u["travel_total_spent"], u["total_spending"]) == (40.0, 2, 0.0, 100.0)
    assert u["spending_diversity"] == pytest.approx(-(0.4 * math.log2(0.4) + 0.6 * math.log2(0.6)), abs=1e-8)
    assert u["weekend_spending_ratio"] == 0.75 and u["median_transaction_amount"] == 25.0
    assert (u["peak_spending_month"], u["peak_spending_day"], u["primary_card"], u["primary_mcc"], u["favorite_merchant"]) == (1, 5, "A", 5541, "m1")
    assert u["card_switch_rate"] == pytest.approx(2 / 3) and u["repeat_merchant_ratio"] == 0.25 and u["avg_spending_per_mcc"] == 25.0
    assert (u["num_suspicious"], u["suspicious_rate"]) == (1, 0.25)
    assert v["card_switch_rate"] == 0.0 and v["transaction_amount_std"] is None and v["spending_diversity"] == 0.0


def test_card_features_default_when_columns_are_missing(spark):
    d = features.card_features(spark.createDataFrame([("a", 95.0)], "card_id string, annual_fee double")).first()
    assert (d["base_reward_rate"], d["welcome_bonus_days"], d["num_credits"], d["currency"], d["is_mid_tier"]) == (0.0, 90, 0, "POINTS", 1)
    assert d["bonus_difficulty"] == "none" and d["net_value_annual"] == -95.0


def test_card_value(spark):
    offers = '[{"spend": 4000, "amount": [{"amount": 50000}], "days": 90}]'
    row = [("a", 95.0, "MILES", '{"universal_base_rate": 2}', offers, '[{"value": 50}]', True)]
    d = features.card_features(
        spark.createDataFrame(row, "card_id string, annual_fee double, currency string, reward_rates string, offers string, credits string, is_annual_fee_waived boolean")
    ).first()
    assert d["welcome_bonus_value_usd"] == pytest.approx(600.0) and d["welcome_bonus_roi"] == pytest.approx(0.15) and d["bonus_difficulty"] == "medium"
    assert (d["effective_annual_fee"], d["effective_fee_year1"], d["net_value_annual"]) == (45.0, -50.0, 455.0)
    assert d["net_value_year1"] == pytest.approx(500 + 50 + 600)


def test_quartiles_are_value_cuts(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 100]], "b double")
    got = [(r["b"], r["q"]) for r in features.quantile_label(df, "b", "q", features.QUARTER_LABELS).orderBy("b").collect()]
    assert [q for _, q in got] == ["Q1_low"] * 4 + ["Q3_medium_high"] * 2 + ["Q4_high"] * 2


def test_one_hot_nulls_are_zero(spark):
    df = spark.createDataFrame([("a",), (None,), ("z",)], "c string").withColumns(features.one_hot("c", ["a", "b"], "c"))
    assert [(r["c_a"], r["c_b"]) for r in df.collect()] == [(1, 0), (0, 0), (0, 0)]


def test_missing_columns_are_a_plan_time_error(spark):
    from perkline.operators import quality

    with pytest.raises(ValueError, match="amount"):
        quality.require_columns(spark.range(1), ["amount"], "transactions")


def test_users_with_few_and_many_purchases_get_the_same_features(spark):
    """One shuffle for users that fit into a task, blocks for larger ones; gaps, NaN and equal counts included."""
    rng = random.Random(5)
    kinds, some = ["dining", "gas", "pets", None], lambda x, share=0.1: None if rng.random() < share else x
    rows = [
        (some(f"u{rng.randrange(60) ** 2 // 60}", 0.01), some(dt.date(2023, 1, 1) + dt.timedelta(rng.randrange(500))), i, rng.choice(kinds), some(rng.choice([rng.randrange(900) / 4, -3.0, -0.0])),
         some(f"c{rng.randrange(3)}"), some(rng.choice([5812, 999, 41])), some(f"m{rng.randrange(30)}é"), some(rng.randrange(2)))
        for i in range(3000)
    ]
    rows += [("nan", dt.date(2023, 1, 1), 9000, "gas", float("nan"), "c", 1, "m", 1), ("nan", None, 9001, "gas", 2.0, None, None, None, None), ("bare", None, 9002, None, None, None, None, None, None)]
    d = spark.createDataFrame(rows, "user_id string, txn_date date, transaction_id long, category string, amount double, card_used string, mcc_code int, merchant string, suspicious int").repartition(5)

    def table(most):
        out = features.user_features(d, most=most)
        return out.schema, {r["user_id"]: [repr(round(x, 8)) if isinstance(x, float) else x for x in r] for r in out.collect()}

    (schema, few), (other, cut), (_, mixed) = table(50_000), table(0), table(60)
    assert schema.simpleString() == other.simpleString()
    assert few == cut and mixed == cut and len(few) > 40
    plan = features._of_few(d, features.FEATURE_CATEGORIES, "user_id", ["txn_date", "transaction_id"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1 and "Aggregate" not in physical and "Window" not in physical
