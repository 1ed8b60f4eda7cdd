"""The chunked helpers against brute force, with one key holding most rows."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from perkline.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        value = rnd.choice([None, 0.0, -3.5, 1e9, -1e-6, rnd.uniform(-50, 50), float(rnd.randint(-5, 5))])
        rows.append((i, key, value, rnd.randint(0, 40), rnd.choice("xyz")))
    return rows, spark.createDataFrame(rows, "id long, k string, v double, day int, c string").repartition(6)


def _close(a, b):
    return a == pytest.approx(b, rel=1e-12, abs=1e-12)


def _quantile(values, p):
    s = sorted(values)
    h = p * (len(s) - 1)
    lo = int(h)
    hi = min(lo + 1, len(s) - 1)
    return s[lo] + (s[hi] - s[lo]) * (h - lo)


def test_quantiles_match_sorting(skewed):
    rows, df = skewed
    got = {r["k"]: r for r in ordered.quantiles(df, ["k"], "v", {"a": 0.0, "b": 0.37, "c": 0.5, "d": 1.0}).collect()}
    for k in {r[1] for r in rows}:
        vals = [r[2] for r in rows if r[1] == k and r[2] is not None]
        assert got[k]["n_values"] == len(vals)
        for name, p in (("a", 0.0), ("b", 0.37), ("c", 0.5), ("d", 1.0)):
            assert _close(got[k][name], _quantile(vals, p))


def test_global_median(skewed):
    rows, df = skewed
    vals = [r[2] for r in rows if r[2] is not None]
    assert _close(ordered.quantiles(df, [], "v", {"m": 0.5}).first()["m"], statistics.median(vals))


def test_infinities_are_ordered_and_nan_is_missing(spark):
    vals = [float("inf"), float("-inf"), float("nan"), 1.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = ordered.pick_ranks(df, [], "v", {"lo": lambda n: F.lit(0), "hi": lambda n: n - 1}).first()
    assert (r["n_values"], r["lo"], r["hi"]) == (3, float("-inf"), float("inf"))


@pytest.mark.parametrize("name", ["log", "epoch", "ids", "offset"])
def test_range_chunk_follows_the_data(spark, name):
    rnd = random.Random(1)
    vals = {
        "log": [0.0, 1e-300, -1e-300, 1e300, -1e300, *[rnd.uniform(-1e4, 1e4) for _ in range(995)]],
        "epoch": [1.7e9 + 60.0 * i for i in range(10_000)],
        "ids": [float(i) for i in range(20_000)],
        "offset": [0.0, *[1e12 + i for i in range(9_999)]],
    }[name]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    chunks = [r["c"] for r in ordered.range_chunk(df, "v", "c", chunk_values=len(vals) // 250).orderBy("v").collect()]
    assert chunks == sorted(chunks)
    assert len(set(chunks)) > 200 and max(chunks.count(c) for c in set(chunks)) < len(vals) / 25
    got = ordered.quantiles(df, [], "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    assert all(_close(got[k], _quantile(vals, p)) for k, p in (("a", 0.1), ("b", 0.5), ("c", 0.999)))


@pytest.mark.parametrize("values", [[f"txn_{i:07d}" for i in range(20_000)], ["same"] * 300 + [None, ""] + [f"x{i}" for i in range(100)]])
def test_range_chunk_of_texts(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v string, i int")
    rows = ordered.range_chunk(df, "v", "c").where("v is not null").orderBy("v").collect()
    chunks = [r["c"] for r in rows]
    assert chunks == sorted(chunks)
    if len(values) > ordered.DRAWN:
        assert len(set(chunks)) > 900 and max(chunks.count(c) for c in set(chunks)) < 120
    assert ordered.range_chunk(df, "v", "c").where("v is null and c is not null").count() == 0


def test_chunks_follow_the_number_of_values(spark):
    small = ordered.range_chunk(spark.range(1000).toDF("v"), "v", "c").agg(F.max("c")).first()[0]
    cut = ordered.range_chunk(spark.range(100_000).toDF("v"), "v", "c", chunk_values=1000).groupBy("c").count().agg(F.count("*"), F.max("count")).first()
    assert small == 0 and 95 <= cut[0] <= 101 and cut[1] <= 1300


def test_one_user_with_all_purchases_on_one_day(spark):
    """The day is cut by what comes next in the order, into parts that hold their share; sums stay exact."""
    rows = [(("u" if i % 10 else f"v{i % 7}"), 1, f"t{i:06d}" if i % 50 else None, i % 23) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k string, day int, id string, amount long").repartition(5)
    order = [F.col("day"), F.col("id"), F.col("amount")]
    got = ordered.running_before(df, ["k"], F.col("day"), order, F.col("amount"), "before", within="id")
    want, sums = {}, {}
    for k, day, i, a in sorted(rows, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or "", r[3])):
        if i is not None:
            want[k, i] = sums.get(k, 0)
        sums[k] = sums.get(k, 0) + a
    assert {(r["k"], r["id"]): r["before"] for r in got.where("id is not null").collect()} == want
    parts = ordered.range_chunk(df, "id", "c").groupBy("k", "day", "c").count().where("c is not null").agg(F.max("count")).first()[0]
    assert parts < 200


def test_running_before_and_row_index(skewed):
    rows, df = skewed
    order = [F.col("day"), F.col("id")]
    run = ordered.running_before(df, ["k"], F.col("day"), order, F.col("id"), "before")
    run = ordered.row_index(run, ["k"], F.floor(F.col("day") / 7), order, "i")
    got = {r["id"]: (r["before"], r["i"]) for r in run.collect()}
    assert len(got) == len(rows)
    for k in {r[1] for r in rows}:
        total = 0
        for i, r in enumerate(sorted((r for r in rows if r[1] == k), key=lambda r: (r[3], r[0])), 1):
            assert got[r[0]] == (total, i)
            total += r[0]


def test_change_counts(skewed):
    rows, df = skewed
    got = {r["k"]: (r["n_rows"], r["n_changes"]) for r in ordered.change_counts(df, ["k"], F.col("day"), [F.col("day"), F.col("id")], "c").collect()}
    for k in {"hot", "a", "b"}:
        seq = [r[4] for r in sorted((r for r in rows if r[1] == k), key=lambda r: (r[3], r[0]))]
        assert got[k] == (len(seq), sum(1 for x, y in zip(seq, seq[1:]) if x != y))


def test_first_per_key_and_mark_repeats(skewed):
    rows, df = skewed
    first = {r["k"]: r["id"] for r in ordered.first_per_key(df, ["k"], [F.col("day"), F.col("id")]).collect()}
    marked = {r["id"]: r["again"] for r in ordered.mark_repeats(df, ["k", "c"], [F.col("id")], "again").collect()}
    seen = set()
    for r in rows:
        assert marked[r[0]] == int((r[1], r[4]) in seen)
        seen.add((r[1], r[4]))
    for k in first:
        assert first[k] == min((r[3], r[0]) for r in rows if r[1] == k)[1]


def test_first_per_key_keeps_maps(spark):
    df = spark.createDataFrame([(1, "a", {"x": 1.0}), (2, "a", {"y": 2.0})], "o int, k string, m map<string,double>")
    assert ordered.first_per_key(df, ["k"], [F.col("o")]).first()["m"] == {"x": 1.0}


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [5.0, 1.0, 1.0, 3.0, 5.0, 5.0]], "v double")
    got = {r["v"]: r["r"] for r in ordered.average_ranks(df, "v", "r").collect()}
    assert got == {1.0: 1.5, 3.0: 3.0, 5.0: 5.0}


def _many(spark):
    rows = [(None if u == 3 else f"u{u}", i % 17, f"t{i * 31 % 101}", None if i % 11 == 0 else float((i * 7) % 13) - 3.0) for u in range(6) for i in range(150 if u < 2 else 9)]
    return spark.createDataFrame(rows, "user string, day int, id string, amount double")


def test_small_keys_in_one_piece_give_what_cut_keys_give(spark):
    d = _many(spark)
    marked = ordered.mark_large(d, ["user"], "large", 20).where("large").select("user").distinct()
    assert sorted(r["user"] for r in marked.collect()) == ["u0", "u1"]
    ranks = {"low": lambda n: F.floor(n / 4), "mid": lambda n: F.floor(n / 2)}
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(ordered.pick_ranks(d, ["user"], "amount", ranks, 20, many=True)) == rows(ordered.pick_ranks(d, ["user"], "amount", ranks, 20))
    place = [F.col("day"), F.col("id"), F.col("amount")]
    cents = F.coalesce(F.col("amount"), F.lit(0.0)).cast("long")
    cut = [ordered.running_before(d, ["user"], F.col("day"), place, cents, "b", "id", 20, many=m) for m in (True, False)]
    assert rows(cut[0]) == rows(cut[1]) and cut[0].count() == d.count()
    changes = [ordered.change_counts(d, ["user"], F.col("day"), place, "amount", 20, many=m) for m in (True, False)]
    assert rows(changes[0]) == rows(changes[1])


def test_user_blocks_cut_large_users_only(spark):
    from perkline.operators import features

    txns = _many(spark).select(F.col("user").alias("user_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).alias("txn_date"), F.col("id").alias("transaction_id"), "amount", F.lit("gas").alias("category"), F.col("id").alias("card_used"), F.lit(1).alias("mcc_code"), F.col("id").alias("merchant"))
    plan = features.user_features(txns)._jdf.queryExecution().toString()
    assert "__large" in plan


def test_rows_of_a_common_category_are_not_sorted(spark):
    from perkline.operators import scaling

    d = spark.range(300).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("part "), F.col("id"))).alias("part"))
    params = scaling.fit(d.where("part IS NULL OR part < 'part 2'"), scaling.Plan(onehot=["part"]), "lines")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scaling.onehot_sparse(d, params, "lines", "part", "code")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin [__t" in plan
        codes = {r["part"]: r["code"] for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    known = sorted(p for p in codes if p and p < "part 2")
    assert codes[None]["position"] == 0 and [codes[p]["position"] for p in known] == list(range(1, len(known) + 1))
    assert codes["part 200"]["position"] is None and codes["part 200"]["size"] == len(known) + 1


@pytest.mark.parametrize("name", ["user_frequencies", "ledger_insights", "running_spend"])
def test_purchases_are_put_together_once(spark, name):
    from perkline.plans.registry import load_all

    plan = load_all()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan
