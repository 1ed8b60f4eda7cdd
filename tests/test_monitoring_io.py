from __future__ import annotations

import datetime as dt
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from perkline.operators import ledger, monitoring
from perkline.sources import files, sinks
from perkline.streaming import streams

LOG = {
    "timestamp": "2024-03-01T10:00:00Z", "request_id": "r1", "user_hash": "h", "top_card": "Gold", "model_version": "m1", "is_personalized": True,
    "input_features": {"spending_categories": {"dining": 10.0}, "monthly_spend": 50.0, "preferred_rewards": ["travel"], "transaction_history_count": 2},
    "predicted_scores": [{"card_name": "Gold", "rank": 1, "deterministic_score": 1.0, "blended_score": 2.0}],
    "latency_breakdown_ms": {"total": 12.0, "rank": 1.0}, "request_status": "success",
}


def test_log_frames_from_json_with_bad_lines(spark, tmp_path):
    day = tmp_path / "dt=2024-03-01"
    day.mkdir()
    (day / "a.json").write_text(json.dumps(LOG) + "\n{broken\n")
    old = tmp_path / "dt=2024-01-01"
    old.mkdir()
    (old / "a.json").write_text(json.dumps(LOG) + "\n")
    logs = files.read_logs(spark, str(tmp_path), "2024-02-24", "2024-03-01")
    assert logs.count() == 1
    assert "PartitionFilters: [isnotnull(dt" in logs._jdf.queryExecution().executedPlan().toString()
    f = monitoring.input_frame(logs, ["dining", "gas"], ["travel", "cash"]).first()
    assert (f["spend_dining"], f["spend_gas"], f["pref_travel"], f["pref_cash"]) == (10.0, 0.0, 1, 0)
    p = monitoring.prediction_frame(logs).first()
    assert (p["personalization_score"], p["blended_score"]) == (0.0, 2.0)
    assert monitoring.latency_frame(logs).first()["normalize_ms"] == 0.0
    assert monitoring.metadata_frame(logs).first()["is_personalized"]


def test_two_percentile_definitions(spark):
    vals = [float(v) for v in range(1, 21)] + [0.0]
    df = spark.createDataFrame([(v,) for v in vals], "total_ms double")
    idx = monitoring.indexed_percentiles(df, [], "total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}).first()
    assert (idx["p50"], idx["p95"], idx["p99"]) == (11.0, 20.0, 20.0)
    lin = monitoring.linear_percentiles(df, [], "total_ms", {"p95": 0.95}).first()
    assert lin["p95"] == pytest.approx(19.0)
    b = monitoring.budget_percentile(df.where("total_ms > 0"), "total_ms", 18.0).first()
    assert b["p95_ms"] == 19.0 and not b["passed"]


def test_task_regression_needs_ratio_and_seconds(spark):
    rows = [("slow", i, 10.0) for i in range(10)] + [("slow", 10, 16.0)] + [("tiny", i, 1.0) for i in range(3)] + [("tiny", 3, 4.0)] + [("new", 0, 9.0)]
    df = spark.createDataFrame(rows, "task string, run int, duration_sec double")
    got = {r["task"]: r["regression"] for r in monitoring.task_regressions(df).collect()}
    assert got == {"slow": True, "tiny": False, "new": False}


def test_champion_rules(spark):
    runs = spark.createDataFrame([("champion", 0.8), ("old", 0.9)], "model_status string, ndcg double")
    assert monitoring.promote(0.8, runs, "ndcg").first()["promote"] and not monitoring.promote(0.7, runs, "ndcg").first()["promote"]
    assert monitoring.promote(0.7, runs, "ndcg", maximize=False).first()["promote"]
    assert monitoring.promote(0.1, runs.where("model_status = 'none'"), "ndcg").first()["promote"]


def test_ledger_pages_and_entries(spark):
    rows = [(f"l{i}", "u", 10.0, 1.0, 0.5, dt.datetime(2024, 1, 1 + i), "gas", "a", "A", "portfolio") for i in range(5)]
    led = spark.createDataFrame(rows, "id string, user_id string, amount double, reward_earned double, estimated_savings double, ts timestamp, category string, chosen_card_id string, chosen_card_name string, source_flow string")
    p = ledger.page(led, 2, 2, "id").collect()
    assert [r["id"] for r in p] == ["l2", "l1"] and p[0]["has_next"] and p[0]["total"] == 5
    assert len(ledger.page(led, 0, 0, "id").collect()) == 5 and not ledger.page(led, 3, 2, "id").first()["has_next"]
    saved = spark.createDataFrame([("u", "a"), ("u", "a")], "user_id string, card_id string")
    e = ledger.build_entries(led, saved, spark.createDataFrame([("u",)], "user_id string"))
    assert e.count() == 5 and e.first()["card_was_saved"]
    fees = spark.createDataFrame([("a", 95.0)], "card_id string, annual_fee double")
    t = ledger.totals(led, fees).first()
    assert (t["fee_adjusted_savings"], t["effective_rate"]) == (2.5 - 95.0, 10.0)


def test_offers_in_both_payload_shapes(spark, tmp_path):
    card = {"name": "Gold", "issuer": "x", "terms": {"spend": 5}}
    (tmp_path / "wrapped.json").write_text(json.dumps({"offers": [card, card], "fetched_at": "now"}))
    (tmp_path / "bare.json").write_text(json.dumps([{**card, "source": "own", "offers": [{"spend": 1}]}]))
    d = files.read_feeds(spark, {"api": str(tmp_path / "wrapped.json"), "issuers": str(tmp_path / "bare.json"), "none": str(tmp_path / "absent.json")})
    assert {(r["source"], r["terms.spend"]) for r in d.collect()} == {("api", 5), ("own", 5)} and d.count() == 3
    assert files.read_csv(spark, str(tmp_path / "absent.csv"), "a int") is None


def test_runs_are_replaced_not_doubled(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    for run in ("r1", "r2", "r2"):
        path = sinks.write_run({"t": df}, str(tmp_path), run)["t"]
    back = spark.read.parquet(path)
    assert back.count() == 4 and files.latest_snapshot(back).count() == 2
    runs = spark.createDataFrame([("r1", "final"), ("r2", "checkpoint"), ("r2", "final")], "run_id string, stage string")
    assert tuple(files.latest_run(runs).first()) == ("r2", "final")


def test_fingerprint_ignores_order_not_content(spark):
    df = spark.range(100).withColumn("m", F.create_map(F.lit("k"), F.col("id")))
    a = sinks.fingerprint(df).first()
    assert a == sinks.fingerprint(df.repartition(9).orderBy(F.desc("id"))).first()
    assert a["fingerprint"] != sinks.fingerprint(df.where("id <> 5").unionByName(df.where("id = 6"))).first()["fingerprint"]


class _Session:
    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}


def test_work_folder_follows_the_cluster_setting():
    assert sinks.work_folder(_Session(spark_checkpoint_dir="s3a://shared/x"), "n").startswith("s3a://shared/x/perkline-n-")
    with pytest.raises(ValueError):
        sinks.work_folder(_Session(spark_master="yarn"), "n")
    assert sinks.work_folder(_Session(spark_master="local[2]"), "n")


def _write(spark, rows, path):
    spark.createDataFrame(rows, "id long, ts timestamp, kind string, amount double").coalesce(1).write.mode("append").parquet(path)


def test_cap_state_carries_across_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    t0 = dt.datetime(2024, 1, 1)
    schema = "id long, ts timestamp, kind string, amount double"
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def drain():
        s = streams.file_stream(spark, src, schema, max_files=1)
        d = streams.spend_before(s, ["kind"], ["ts", "id"], "amount", ["id", "amount"], "id long, amount double, kind string, spent_before double")
        return streams.run_available(d, out, ck)

    _write(spark, [(2, t0 + dt.timedelta(2), "a", 5.0), (1, t0 + dt.timedelta(1), "a", 10.0), (3, t0, "b", 1.0)], src)
    drain()
    _write(spark, [(4, t0 + dt.timedelta(3), "a", -4.0), (5, t0 + dt.timedelta(4), "a", 2.5), (6, t0 + dt.timedelta(5), "a", 1.0)], src)
    got = {r["id"]: r["spent_before"] for r in drain().collect()}
    assert got == {1: 0.0, 2: 10.0, 3: 0.0, 4: 15.0, 5: 15.0, 6: 17.5}


def test_alerts_stay_silent_for_an_hour_from_the_first(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = "id long, ts timestamp, kind string, amount double"

    def drain():
        s = streams.file_stream(spark, src, schema, max_files=1)
        return streams.run_available(streams.dedupe_alerts(s, "ts", keys=["kind"]), out, ck)

    for minutes in (0, 30, 200, 205):
        _write(spark, [(minutes, t0 + dt.timedelta(minutes=minutes), "a", 0.0)], src)
        rows = drain()
    assert sorted(r["id"] for r in rows.collect()) == [0, 200]


def _parts(spark, folder, rows, schema, files):
    spark.createDataFrame(rows, schema).repartition(files).write.mode("append").parquet(folder)


class _Handle:
    """A state store in memory that notes the most rows it was given or gave out at once."""

    def __init__(self):
        self.values, self.timers, self.most = {}, [], 0

    def getValueState(self, name, schema, ttl=None):
        return _Value(self)

    def getMapState(self, name, key, value, ttl=None):
        return _Map(self)

    def registerTimer(self, at):
        self.timers.append(at)


class _Value:
    def __init__(self, handle):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class _Map:
    def __init__(self, handle):
        self.rows = {}

    def updateValue(self, key, value):
        assert key not in self.rows
        self.rows[key] = value

    def getValue(self, key):
        return self.rows[key]

    def removeKey(self, key):
        del self.rows[key]


@pytest.mark.parametrize("crowded", [False, True])
def test_a_hot_key_is_taken_in_order_a_few_rows_at_a_time(crowded):
    """Fifty times the rows that are held at once, half of them in one short burst."""
    rng = random.Random(3)
    t0 = pd.Timestamp("2024-01-01")
    times = [t0 + pd.Timedelta(microseconds=rng.randrange(10**13 if not crowded or i % 2 else 10**4)) for i in range(5000)] + [pd.NaT]
    rows = pd.DataFrame({"ts": pd.Series(times).astype("datetime64[us]"), "id": range(len(times)), "_x": 1.0})

    class Seen(streams.InOrder):
        def step(self, key, rows, carried):
            self.sizes.append(len(rows))
            return rows, (carried[0] + len(rows) if carried else len(rows),)

    step = Seen(["ts", "id", "_x"], "ts", ["ts", "id"], "n long", most=100)
    step.sizes, handle = [], _Handle()
    step.init(handle)
    frames = (rows.iloc[i : i + 75].set_axis(["ts", "id", "_2"], axis=1) for i in range(0, len(rows), 75))
    got = pd.concat(list(step.handleInputRows(("k",), frames, None)))
    assert got["id"].tolist() == rows.sort_values(["ts", "id"], na_position="first")["id"].tolist()
    assert max(step.sizes) <= 100 and not step.held.rows and step.carry.get() == (len(rows),)


def test_streams_with_hot_keys_and_ended_periods(spark, tmp_path):
    """A key with a third of the rows over several micro-batches; state goes with its year, and quiet alerts are forgotten."""
    rng = random.Random(8)
    t0 = dt.datetime(2022, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=i * 2, minutes=rng.randrange(50)), "hot" if i % 3 == 0 else f"k{i % 40}", float(rng.randrange(1, 900)) / 10) for i in range(9000)]
    src, schema = str(tmp_path / "in"), "id long, ts timestamp, kind string, amount double"
    for year in (2022, 2023, 2024):
        _parts(spark, src, [r for r in rows if r[1].year == year], schema, 1)

    def stream():
        s = streams.file_stream(spark, src, schema, max_files=1)
        return s.withColumns({"year": F.year("ts"), "ends": F.make_timestamp(F.year("ts") + 1, *[F.lit(x) for x in (1, 1, 0, 0, 0)])})

    want, sums = {}, {}
    for i, ts, kind, amount in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = round(sums.get((kind, ts.year), 0), 2)
        sums[kind, ts.year] = want[i] + amount
    d = streams.spend_before(stream(), ["kind", "year"], ["ts", "id"], "amount", ["id"], "id long, kind string, year int, spent_before double", until="ends", most=100)
    out, ck = str(tmp_path / "spend"), str(tmp_path / "spend-ck")
    assert {r["id"]: round(r["spent_before"], 2) for r in streams.run_available(d, out, ck).collect()} == want
    left = spark.read.format("statestore").option("path", ck).option("stateVarName", "carry").load().select("key.year").distinct().collect()
    assert [r[0] for r in left] == [2024]

    a = streams.dedupe_alerts(streams.file_stream(spark, src, schema, max_files=1), "ts", keys=["kind"], quiet_seconds=86_400, most=100)
    out, ck = str(tmp_path / "alerts"), str(tmp_path / "alerts-ck")
    got = sorted(r["id"] for r in streams.run_available(a, out, ck).collect())
    sent, last = [], {}
    for i, ts, kind, _ in sorted(rows, key=lambda r: r[1]):
        if kind not in last or ts - last[kind] >= dt.timedelta(days=1):
            sent.append(i)
            last[kind] = ts
    assert got == sorted(sent)
    left = spark.read.format("statestore").option("path", ck).option("stateVarName", "carry").load().count()
    newest = max(r[1] for r in rows)
    assert left == sum(1 for t in last.values() if t + dt.timedelta(days=1) > newest - dt.timedelta(hours=1))


def test_spending_buckets_share_state_calls(spark, tmp_path, monkeypatch):
    """Many users in one micro-batch are few groups; their spend is carried on, whatever the id."""
    monkeypatch.setattr(streams, "GROUPS", 16)
    t0, schema = dt.datetime(2024, 1, 1), "id long, ts timestamp, user long, kind string, amount double"
    users = [None, 2**53 + 1, 2**53 + 2, *range(400)]
    row = lambda i, day, at, n, user: (i, t0 + dt.timedelta(days=day, hours=at), user, "a" if n % 3 else "b", n + 0.25)
    first = [row(n * 10 + at, 0, at, n, user) for n, user in enumerate(users) for at in (2, 1)]
    later = [row(n * 10 + 5, 3, 0, n, user) for n, user in enumerate(users)]
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for rows in (first, later):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        s = streams.file_stream(spark, src, schema, max_files=1)
        got = streams.run_available(
            streams.spend_before(s, ["user", "kind"], ["ts", "id"], "amount", ["id"], "id long, user long, kind string, spent_before double"), out, ck
        ).collect()
    found = {r["id"]: (r["user"], r["kind"], r["spent_before"]) for r in got}
    want = {}
    for n, user in enumerate(users):
        kind = "a" if n % 3 else "b"
        want |= {n * 10 + 1: (user, kind, 0.0), n * 10 + 2: (user, kind, n + 0.25), n * 10 + 5: (user, kind, 2 * n + 0.5)}
    assert found == want
    state = spark.read.format("statestore").option("path", ck).option("stateVarName", "carry").load().count()
    assert 0 < state <= 2 * 16


def test_a_failing_stream_raises(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    _write(spark, [(1, dt.datetime(2024, 1, 1), "a", 1.0)], src)
    s = streams.file_stream(spark, src, "id long, ts timestamp, kind string, amount double").withColumn("bad", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception):
        streams.run_available(s, out, ck)


@pytest.mark.parametrize("parts", [1, 3])
def test_streams_read_single_files_and_folders(spark, tmp_path, parts):
    rows = [(i, dt.datetime(2024, 1, 1), "a", 1.0) for i in range(9)]
    table = spark.createDataFrame(rows, "id long, ts timestamp, kind string, amount double")
    path = tmp_path / "events.parquet"
    if parts == 1:
        table.toPandas().to_parquet(path, coerce_timestamps="us")
    else:
        table.repartition(parts).write.parquet(str(path))
    beside = table.limit(1).toPandas()
    beside.to_parquet(tmp_path / "events.parquet.bak", coerce_timestamps="us")
    got = streams.run_available(streams.file_stream(spark, f"{tmp_path}/events.parque[t]", table.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert got.count() == 9


def test_a_period_without_requests_is_zero(spark):
    numbers = ["llm_calls", "llm_successes", "llm_fallbacks", "llm_tokens", "is_personalized"]
    cols = ["day date", "request_status string", "total_ms double", "explanation_latency_ms double", "llm_model string", "llm_prompt_version string", *[f"{n} long" for n in numbers]]
    cols += [f"{s} double" for s in monitoring.STAGES if s not in ("total_ms",)]
    empty = spark.createDataFrame([], ", ".join(dict.fromkeys(cols)))
    r = monitoring.period_report(empty, "2024-01-01", "2024-01-07").first().asDict()
    assert r["request_count"] == 0 and r["error_rate"] == 0.0 and r["personalization_rate"] == 0.0 and r["avg_per_day"] == 0.0
    assert r["model_names"] == "" and all(v is not None for v in r.values())


def test_pages_follow_a_key(spark):
    rows = [(dt.datetime(2024, 1, 1 + i % 5), i) for i in range(23)]
    d = spark.createDataFrame(rows, "ts timestamp, id int")
    want = sorted(rows, key=lambda r: (-r[0].timestamp(), r[1]))
    got, last = [], {"ts": dt.datetime(2999, 1, 1), "id": 0}
    while page := ledger.page_after(d, last, 5, "id").collect():
        got += [(r["ts"], r["id"]) for r in page]
        last = page[-1].asDict()
    assert got == want
