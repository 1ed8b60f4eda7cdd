from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from perkline.operators import drift, fairness, modeling, profiling, quality, scaling


def test_suite_counts_and_mostly(spark):
    df = spark.createDataFrame([(1, 5.0, "a1"), (1, 2000.0, None), (2, None, "b")], "id int, fee double, code string")
    R = quality.Rule
    rules = [R("not_null", "code"), R("unique", "id"), R("between", "fee", low=0, high=1000, mostly=0.5), R("between", "fee", low=5, strict=True), R("matches", "code", pattern=r"^[a-z]\d$"), R("exists", "gone"), R("columns", values=("id", "fee", "code"))]
    got = {(r["rule"], r["column"]): r for r in quality.run_suite(df, rules, "d").where("not (rule = 'between' and evaluated = 99)").collect() if r["rule"] != "between"}
    assert (got["not_null", "code"]["broken"], got["unique", "id"]["broken"], got["matches", "code"]["evaluated"]) == (1, 2, 2)
    assert not got["exists", "gone"]["passed"] and got["columns", "*"]["passed"]
    between = sorted(((r["broken"], r["passed"]) for r in quality.run_suite(df, rules, "d").where("rule = 'between'").collect()))
    assert between == [(1, False), (1, True)]


def test_anomaly_checks(spark):
    rows = [(float(i % 10), None if i < 25 else "x") for i in range(100)] + [(1e6, "x")] * 10
    df = spark.createDataFrame(rows, "v double, s string")
    miss = quality.missing_values(df, "d").collect()
    assert [(r["column"], r["severity"], r["observed"]) for r in miss] == [("s", "CRITICAL", 25.0)]
    iqr = quality.outliers_iqr(df, "d").first()
    assert (iqr["severity"], iqr["observed"]) == ("WARNING", 10.0)
    assert quality.outliers_iqr(spark.createDataFrame([(1.0,)] * 9 + [(5.0,)], "v double"), "d").count() == 0
    v = quality.schema_violations(df, "d", ["v", "gone"], {"s": "numeric"})
    assert {(r["column"], r["severity"]) for r in v.collect()} == {("gone", "CRITICAL"), ("s", "WARNING")}
    gate = quality.critical_gate(miss and quality.missing_values(df, "d")).first()
    assert not gate["passed"] and quality.critical_gate(quality.missing_values(df, "d"), enforce=False).first()["passed"]


def test_row_contracts(spark):
    rows = [("txn_1", "user_1", "dining", 5812, 1.0), ("x", "u", "pets", 1, 0.0), (None, "user_2", None, None, None)]
    df = spark.createDataFrame(rows, "transaction_id string, user_id string, category string, mcc_code int, amount double")
    good, bad = quality.split_rows(df, quality.transaction_reasons())
    assert good.count() == 1
    assert {tuple(r["reject_reasons"]) for r in bad.collect()} == {
        ("user_id", "transaction_id", "category", "mcc_code", "amount"), ("transaction_id", "category", "mcc_code", "amount"),
    }


def _ks(a, b):
    pts = sorted(set(a) | set(b))
    return max(abs(sum(x <= p for x in a) / len(a) - sum(x <= p for x in b) / len(b)) for p in pts)


def test_ks_matches_brute_force(spark):
    rnd = random.Random(3)
    a, b = [rnd.gauss(0, 1) for _ in range(300)], [rnd.gauss(0.4, 1) for _ in range(200)] + [0.0] * 30
    got = drift.ks_test(spark.createDataFrame([(x,) for x in a], "v double"), spark.createDataFrame([(x,) for x in b], "v double"), ["v"]).first()
    assert got["ks_statistic"] == pytest.approx(_ks(a, b)) and got["p_value"] < 0.01 and (got["ref_count"], got["cur_count"]) == (300, 230)
    same = drift.ks_test(spark.createDataFrame([(x,) for x in a], "v double"), spark.createDataFrame([(x,) for x in a], "v double"), ["v"]).first()
    assert same["ks_statistic"] == 0.0 and same["p_value"] == 1.0


def test_chi_square_tail(spark):
    df = spark.createDataFrame([(3.841, 1.0), (18.307, 10.0), (0.1, 3.0)], "x double, k double")
    got = [r["p"] for r in df.select(drift.chi2_p("x", F.col("k")).alias("p")).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-4) and got[1] == pytest.approx(0.05, abs=1e-4) and got[2] == pytest.approx(0.99184, abs=1e-4)


def test_metric_drift_from_zero_is_infinite(spark):
    p = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "k string, v double")
    c = spark.createDataFrame([("a", 0.1), ("c", 0.0)], "k string, v double")
    got = {r["k"]: (r["relative"], r["verdict"]) for r in drift.metric_drift(p, c, ["k"], "v").collect()}
    assert got["a"] == (math.inf, "regression") and got["b"] == (-1.0, "improvement") and got["c"] == (0.0, "stable")


def test_bias_on_imbalanced_groups(spark):
    rows = [(g, b) for g, n, b in [("18-25", 150, 3000.0), ("26-35", 30, 5000.0), ("36-50", 15, 8000.0), ("51-65", 5, 15000.0)] for _ in range(n)]
    df = spark.createDataFrame(rows, "age_group string, monthly_budget double")
    got = {(r["name"], r["detail"]): r for r in fairness.data_bias_scan(df, ["age_group"], ["monthly_budget"]).collect()}
    assert got["underrepresentation", "51-65"]["value"] == pytest.approx(0.025)
    assert got["representation_imbalance", ""]["value"] == 30.0
    assert got["outcome_disparity", "monthly_budget: 51-65 vs 18-25"]["value"] == 5.0
    imb = {r["slice_value"]: r for r in fairness.slices(df, ["age_group"], ["monthly_budget"]).collect()}
    assert imb["36-50"]["count"] == 15 and imb["36-50"]["fraction"] == 0.075 and imb["36-50"]["imbalance"] == 30.0
    up = fairness.oversample(df.withColumn("id", F.monotonically_increasing_id()).persist(), "age_group", F.col("id"))
    assert {r["age_group"]: r["count"] for r in up.groupBy("age_group").count().collect()} == {g: 150 for g in ("18-25", "26-35", "36-50", "51-65")}
    w = fairness.sample_weights(df, "age_group")
    assert w.agg(F.avg("weight")).first()[0] == pytest.approx(1.0)


def test_one_row_grows_past_a_copy_block(spark, monkeypatch):
    monkeypatch.setattr(fairness, "COPIES_PER_BLOCK", 7)
    df = spark.createDataFrame([(i, "big") for i in range(50)] + [(100, "one"), (101, "two"), (102, "two"), (103, "two")], "id long, g string")
    up = fairness.oversample(df, "g", F.col("id"))
    per = {(r["g"], r["id"]): r["count"] for r in up.groupBy("g", "id").count().collect()}
    assert per["one", 100] == 50 and sorted(per["two", i] for i in (101, 102, 103)) == [16, 17, 17]
    assert fairness.undersample(df, "g", F.col("id"), ratio=2).groupBy("g").count().orderBy("g").collect()[0]["count"] == 2


def test_classification_fairness(spark):
    rows = [("a", 1, 1)] * 6 + [("a", 0, 0)] * 4 + [("b", 1, 0)] * 5 + [("b", 0, 1)] * 1 + [("b", 0, 0)] * 4
    df = spark.createDataFrame(rows, "g string, y int, p int")
    got = {r["name"]: r["value"] for r in fairness.classification_fairness(df, "g", "y", "p").collect()}
    assert got["demographic_parity_difference"] == pytest.approx(0.5) and got["equalized_odds_difference"] == pytest.approx(1.0)
    assert got["accuracy_difference"] == pytest.approx(0.6) and got["accuracy_ratio"] == pytest.approx(0.4)


def test_custom_group_metric(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 9.0), ("b", 2.0), ("b", 2.0)], "g string, v double")
    assert fairness.group_difference(df, "g", "v", metric=F.max).first()["value"] == pytest.approx(7 / 9)


def test_gates(spark):
    m = spark.createDataFrame([("dp", True, 0.2), ("eo", False, 0.9)], "name string, is_biased boolean, value double")
    assert not fairness.bias_gate(m).first()["passed"] and fairness.bias_gate(m, limit=0.3).first()["passed"]
    v = spark.createDataFrame([("r2", 0.5)], "metric string, value double")
    assert fairness.metric_gate(v, {"r2": 0.4}).first()["passed"] and not fairness.metric_gate(v, {"r2": 0.4, "ndcg": 0.1}).first()["passed"]


def test_scaling_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 3.0, "x", "p"), (3.0, 3.0, None, "q"), (5.0, 3.0, "y", "p")], "a double, b double, c string, d string")
    plan = scaling.Plan(standard=["a", "nope"], minmax=["b"], onehot=["c"], label=["d"])
    scaling.fit(df, plan, "t").write.parquet(str(tmp_path / "params"))
    params = spark.read.parquet(str(tmp_path / "params"))
    book = scaling.collect_params(params, "t")
    out = scaling.label_join(scaling.transform(df, book), params, "t", "d").orderBy("a")
    assert out.columns == ["a", "b", "c_<MISSING>", "c_x", "c_y", "d"]
    first = out.first()
    assert first["a"] == pytest.approx(-2 / math.sqrt(8 / 3)) and first["b"] == 0.0 and (first["c_x"], first["d"]) == (1, 0)
    unseen = spark.createDataFrame([(1.0, 3.0, "new", "zz")], df.schema)
    r = scaling.transform(unseen, book).first()
    assert (r["c_x"], r["c_y"], r["c_<MISSING>"]) == (0, 0, 0)
    assert scaling.label_join(unseen, params, "t", "d").first()["d"] == -1
    back = scaling.inverse_label(out, params, "t", "d", "d", "x").orderBy("a")
    assert [x["x"] for x in back.collect()] == ["p", "q", "p"]
    many = spark.createDataFrame([(f"user_{i:06d}",) for i in range(20_000)], "d string")
    wide = scaling.fit(many, scaling.Plan(label=["d"]), "m")
    coded = scaling.label_join(many.withColumn("text", F.col("d")), wide, "m", "d").collect()
    assert all(r["d"] == int(r["text"][5:]) for r in coded) and len(coded) == 20_000


def test_flips_take_any_number_of_values(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(1200)], "id long, c string").where("id < 1200")
    assert fairness.counterfactuals(df.where("id < 40"), ["c"]).count() == 40 * 39
    assert fairness.counterfactuals(df, ["c"]).groupBy("id").count().where("count = 1199").count() == 1200


def test_split_is_stratified_and_exact(spark):
    df = spark.createDataFrame([(i, "a" if i < 100 else "b") for i in range(120)], "id long, y string")
    got = {(r["stratum"], r["split"]): r["count"] for r in modeling.split(df, "y", "id").groupBy("stratum", "split").count().collect()}
    assert got == {("a", "train"): 70, ("a", "val"): 15, ("a", "test"): 15, ("b", "train"): 14, ("b", "val"): 3, ("b", "test"): 3}
    with pytest.raises(ValueError):
        modeling.split(df, "y", "id", train=0.9)


def test_ranking_metrics(spark):
    df = spark.createDataFrame([(i, float(i), float(v)) for i, v in enumerate([1, 9, 3, 8, 7, 2])], "id long, y double, p double")
    true_top, pred = [5, 4, 3], [1, 3, 4]
    rel = [1.0 if i in true_top else 0.0 for i in pred]
    dcg = sum(r / math.log2(i + 2) for i, r in enumerate(rel))
    got = modeling.ranking_metrics(df, "y", "p", "id", 3).first()
    assert got["ndcg_at_k"] == round(dcg / sum(1 / math.log2(i + 2) for i in range(3)), 4)
    assert (got["precision_at_k"], got["recall_at_k"], got["mrr"], got["map_at_k"]) == (0.6667, 0.6667, 0.5, round((1 / 2 + 2 / 3) / 3, 4))


def test_training_and_metrics(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 3), 2.0 * (i % 7)) for i in range(140)], "id long, a double, b double, y double")
    train, val = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    board, fitted = modeling.train_all(train, val, ["a", "b"], "y", modeling.candidates("y", trees=5, rounds=3))
    rows = board.collect()
    assert rows[-1]["model"] == "mean_baseline" and rows[0]["rmse"] < rows[-1]["rmse"] and set(fitted) == {r["model"] for r in rows}
    assert modeling.regression_metrics(df.withColumn("p", F.col("y")), "y", "p").first()["r2"] == 1.0


def test_describe_and_histogram(spark):
    df = spark.createDataFrame([(float(i), "a" if i % 3 else None) for i in range(10)], "v double, s string")
    d = profiling.describe(df).first()
    assert (d["count"], d["q25"], d["q50"], d["max"]) == (10, 2.25, 4.5, 9.0)
    t = profiling.describe_text(df, ["s"]).first()
    assert (t["count"], t["missing"], t["distinct"], t["top"], t["freq"]) == (6, 4, 1, "a", 6)
    assert {r["bin"]: r["n"] for r in profiling.histogram(df, "v", 3).collect()} == {0: 3, 1: 3, 2: 4}


def test_columns_without_values_on_one_side_are_not_tested(spark):
    a = spark.createDataFrame([("x", None), ("y", None), ("x", None)], "p string, q string")
    b = spark.createDataFrame([("x", "k"), ("y", "l")], "p string, q string")
    per, verdict = drift.dataset_drift(a, b, [], ["p", "q"])
    assert [r["column"] for r in per.collect()] == ["p"]
    assert verdict.first()["columns"] == 1
    assert drift.chi_square(a.limit(0), b, ["p"]).count() == 0
