from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from perkline.functions import html, nested, text, wording


def one(spark, schema, row, expr):
    return spark.createDataFrame([row], schema).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("Chase Sapphire Preferred®", "Chase Sapphire Preferred"),
        ("AMEX  Gold   Card™", "AMEX Gold Card"),
        ("chili's rewards credit card", "Chili'S Rewards"),
        ("  usb\taaa  visa ", "USB AAA Visa"),
        ("Credit Card", ""),
        (None, ""),
    ],
)
def test_card_names(spark, raw, clean):
    assert one(spark, "s string", (raw,), text.clean_card_name(F.col("s"))) == clean


@pytest.mark.parametrize(
    "raw,name",
    [("amex", "AMERICAN EXPRESS"), ("chase_bank", "CHASE BANK"), (" capital  one ", "CAPITAL ONE"), ("Wells_Fargo", "WELLS FARGO"), (None, "UNKNOWN")],
)
def test_issuers(spark, raw, name):
    assert one(spark, "s string", (raw,), text.standard_issuer(F.col("s"))) == name


@pytest.mark.parametrize(
    "raw,want",
    [
        ("60,000 points after $4,000 spend in 3 months", (60000, "points", 4000, 90)),
        ("$750 bonus", (750, "dollars", None, None)),
        ("60000 miles", (60000, "miles", None, None)),
        ("up to $200 back in 6 weeks", (200, "dollars", None, 42)),
        ("nothing", (None, "points", None, None)),
        (None, (None, "points", None, None)),
    ],
)
def test_welcome_bonus(spark, raw, want):
    b = one(spark, "s string", (raw,), text.parse_welcome_bonus(F.col("s")))
    assert (b["amount"], b["unit"], b["spend_requirement"], b["time_days"]) == want


def test_rates_and_money(spark):
    rate = lambda s: one(spark, "s string", (s,), text.parse_rate(F.col("s")))
    assert [rate(s) for s in ("1.5%", "2x", "3", "25", "none", None)] == [1.5, 2.0, 3.0, None, None, None]
    assert one(spark, "s string", ("$1,250",), text.money(F.col("s"))) == 1250.0
    assert one(spark, "s string", ("2.0% flat",), text.numeric_like(F.col("s"))) == 2.0
    assert one(spark, "s string", ("Amex Gold!",), text.slug(F.col("s"))) == "amex_gold"
    assert one(spark, "s string", ("!!",), text.slug(F.col("s"))) == "unknown_card"
    assert one(spark, "a string, b string", ("", " The  Bank "), text.merge_key(F.col("a"), F.col("b"))) == "the bank"


def test_bonus_text(spark):
    e = text.bonus_text(F.col("a"), F.col("s"), F.col("d"))
    assert one(spark, "a double, s double, d double", (70000.0, 5000.0, 180.0), e) == "70,000 bonus after $5,000 spend in 180 days"
    assert one(spark, "a double, s double, d double", (0.0, 0.0, 0.0), e) is None


def test_reward_phrases_last_wins(spark):
    s = "Earn 5% cash back on travel. 3X points on dining, and 4X on dining, 2% back on " + "x" * 40 + "."
    got = {r["category"]: (r["rate"], r["type"]) for r in one(spark, "s string", (s,), text.reward_rate_phrases(F.col("s")))}
    assert got["travel"] == (5.0, "cashback") and got["dining"] == (4.0, "points") and len(got) == 2


def _syllables(word):
    w, count, prev = word.lower(), 0, False
    for ch in w:
        v = ch in "aeiouy"
        count += v and not prev
        prev = v
    if w.endswith("e") and count > 1:
        count -= 1
    return max(count, 1)


@pytest.mark.parametrize(
    "s",
    [
        "The cake was made by the baker. It's gone!", "Eee eye use one's whole life; rhythm 123 tee tree re-use? ", "", "...", "a\n b. \n .c",
        "Queue outside the café, please be there", "e", "the", "able candle strengths xyz'e",
    ],
)
def test_whole_text_syllables_match_word_by_word(spark, s):
    import re

    words = re.findall(r"[A-Za-z0-9']+", s)
    n = max(len(words), 1)
    sent = max(len([x for x in re.split(r"[.!?]+", s) if x.strip()]), 1)
    syl = max(sum(_syllables(w) for w in words), 1)
    ease = 206.835 - 1.015 * (n / sent) - 84.6 * (syl / n)
    got = one(spark, "s string", (s,), text.reading_ease(F.col("s"), digits=6))
    assert got["ease"] == pytest.approx(ease, abs=1e-5)
    tokens = s.split()
    m = one(spark, "s string", (s,), text.text_measures(F.col("s")))
    k = max(len(tokens), 1)
    vow = sum(max(1, sum(c in "aeiou" for c in w.lower())) for w in tokens)
    stops = max(s.count(".") + s.count("!") + s.count("?"), 1)
    assert m["words"] == len(tokens)
    assert m["grade"] == pytest.approx(0.39 * k / stops + 11.8 * vow / k - 15.59)


def test_claims_and_flags(spark):
    c = one(spark, "s string", ("Earns 3x and $50, not 9x",), text.claim_check(F.col("s"), F.array(F.lit(3.0)), F.array(F.lit(50.004))))
    assert (c["total"], c["supported"], c["passed"]) == (3, 2, False)
    assert one(spark, "s string", ("no numbers",), text.claim_check(F.col("s"), F.array(F.lit(3.0)), F.array(F.lit(1.0))))["score"] == 1.0
    two = F.array(F.lit("a"), F.lit("b"))
    f = one(spark, "s string", ("Gold Card earns 4x",), text.quality_flags(F.col("s"), two, two, two, F.lit("gold card"), F.lit(3.0)))
    assert f.asDict() == {"length_ok": True, "relevance_ok": True, "pros_cons_ok": True, "hallucination_guard_ok": False}


@pytest.mark.parametrize(
    "raw,rate",
    [
        ('{"universal_base_rate": 2.0, "dining": 4}', 2.0), ('{"base": "1.5"}', 1.5), ('{"rates": [{"rate": 2}, {"value": 5}]}', 5.0),
        ("[1, 3, 2]", 3.0), ('{"categories": []}', None), ("not json", None), ("", None), (None, None),
    ],
)
def test_base_rate_shapes(spark, raw, rate):
    assert one(spark, "s string", (raw,), nested.base_rate_from_json(F.col("s"))) == rate


def test_offers_and_credits(spark):
    raw = '[{"spend": 4000, "amount": [{"amount": 60000}], "days": 120}, {"spend": 1}]'
    assert tuple(one(spark, "s string", (raw,), nested.first_offer(F.col("s")))) == (4000.0, 60000.0, 120)
    assert tuple(one(spark, "s string", ("[]",), nested.first_offer(F.col("s")))) == (0.0, 0.0, 90)
    assert tuple(one(spark, "s string", (None,), nested.first_offer(F.col("s")))) == (0.0, 0.0, 90)
    credits = '[{"value": 10}, {"value": null}, {"description": "x", "value": 2.5}]'
    assert tuple(one(spark, "s string", (credits,), nested.credit_totals(F.col("s")))) == (12.5, 3)
    assert tuple(one(spark, "s string", ("oops",), nested.credit_totals(F.col("s"))))[1] == 0


def test_best_offer_keeps_the_earlier_of_equals(spark):
    schema = "o array<struct<spend:double,amount:array<struct<amount:double>>,days:int>>"
    offers = [(1000.0, [(500.0,)], 90), (1000.0, [(500.0,)], 60), (0.0, [(900.0,)], 30)]
    best = one(spark, schema, (offers,), nested.best_offer(F.col("o"), F.col("o")))
    assert tuple(best) == (500.0, 1000.0, 60.0)
    assert one(spark, schema, ([],), nested.best_offer(F.col("o"), F.col("o"))) is None


def test_card_lists(spark):
    for raw, want in [("['A','B']", ["A", "B"]), ("[]", []), ("x, y ,", ["x", "y"]), (None, [])]:
        assert one(spark, "s string", (raw,), nested.card_list(F.col("s"))) == want


def test_highlights_and_explanations(spark):
    e = wording.reward_highlights(F.col("b"), F.lit(1.0), F.lit(0.0))
    assert one(spark, "b map<string,double>", ({"gas": 3.0, "dining": 4.5},), e) == ["4.5x dining", "3x gas", "1% on everything else", "No annual fee"]
    assert one(spark, "x double", (0.254,), wording.money_text(F.col("x"))) == "$0.25"
    assert one(spark, "x double", (1234.5,), wording.money_text(F.col("x"))) in ("$1,235", "$1,234")
    hl = F.array(F.lit("4x dining"), F.lit("1% on everything else"))
    pros, cons = wording.pros_and_cons(hl, F.lit(4.0), F.lit(95.0), F.lit(200.0), F.lit("dining"), F.lit("gas"), F.lit(2))
    got = spark.range(1).select(pros.alias("p"), cons.alias("c"), wording.best_for(F.array(F.lit("traveler")), F.lit(True), F.lit("dining")).alias("b")).first()
    assert len(got["p"]) == 2 and got["p"][0].startswith("4x dining") and "more than offsets the $95" in got["p"][1]
    assert got["c"] == ["$95/year annual fee requires consistent spending to offset", "No bonus rate for gas — your #2 spending category"]
    assert got["b"] == "Traveler spenders focused on dining"


PAGE = """<html><head><style>p{}</style><script type="application/ld+json">{"@type":"CreditCard","name":"Chase Freedom","url":"/f","offers":{"price":"$95"},"aggregateRating":{"ratingValue":"4.5","reviewCount":"12"}}</script></head>
<body><!-- no annual fee --><a href="/cards/x">go</a><h2>Amex <b>Gold</b></h2><p>Pay $250 annual fee. Earn 4x points. Get 60,000 points bonus</p><img class="i" src="http://i/x.png"></body></html>"""


def test_page_listing(spark):
    got = one(spark, "h string", (PAGE,), html.card_listing(F.col("h"), F.lit("http://s")))
    assert (got["name"], got["issuer"], got["annual_fee"], got["detail_url"], got["image_url"], got["n_links"]) == (
        "Amex Gold", "American Express", 250, "http://s/cards/x", "http://i/x.png", 1,
    )
    assert got["base_reward_rate"] == "4x points" and got["welcome_bonus"] == "60,000 points"
    ld = one(spark, "h string", (PAGE,), html.json_ld_cards(F.col("h")))
    assert len(ld) == 1 and (ld[0]["name"], ld[0]["issuer"], ld[0]["annual_fee"], ld[0]["rating"]) == ("Chase Freedom", "Chase", 95.0, "4.5")
