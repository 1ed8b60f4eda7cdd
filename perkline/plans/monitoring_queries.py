"""Request monitoring, task timing, history and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from perkline import dims
from perkline.operators import ledger as lg
from perkline.operators import modeling
from perkline.operators import monitoring as mo
from perkline.operators import scoring as sc
from perkline.plans.registry import query
from perkline.sources import sinks

R = lambda c, n=8: F.round(c, n).alias(c)
START, END = "2023-12-30", "2024-02-01"
POS = lambda c: f"coalesce(avg({c}) FILTER ({c} > 0), 0)"
AGG = f"""count(*) AS request_count, count(*) FILTER (coalesce(request_status, 'success') <> 'error') AS success_count, count(*) FILTER (request_status = 'error') AS error_count,
  round(count(*) FILTER (request_status = 'error') / count(*), 8) AS error_rate, round(avg(is_personalized), 8) AS personalization_rate,
  {', '.join(f'round({POS(s)}, 8) AS mean_{s}' for s in mo.STAGES)},
  coalesce(sum(llm_calls), 0)::BIGINT AS llm_calls, coalesce(sum(llm_successes), 0)::BIGINT AS llm_successes, coalesce(sum(llm_fallbacks), 0)::BIGINT AS llm_fallbacks, coalesce(sum(llm_tokens), 0)::BIGINT AS llm_tokens,
  round(CASE WHEN sum(llm_calls) > 0 THEN sum(llm_successes) / sum(llm_calls) ELSE 0 END, 8) AS llm_success_rate, round(coalesce(sum(llm_tokens), 0) / 1000.0::DOUBLE * 0.005::DOUBLE, 8) AS llm_cost_usd, round({POS('explanation_latency_ms')}, 8) AS mean_explanation_ms"""


def _ix(p: float) -> str:
    return f"round(list_sort(list(total_ms) FILTER (total_ms > 0))[least(floor(count(*) FILTER (total_ms > 0) * {p}::DOUBLE), count(*) FILTER (total_ms > 0) - 1)::BIGINT + 1], 3)"


LAT = f"""round(avg(total_ms) FILTER (total_ms > 0), 3) AS mean_ms, round(min(total_ms) FILTER (total_ms > 0), 3) AS min_ms, round(max(total_ms) FILTER (total_ms > 0), 3) AS max_ms,
  round(median(total_ms) FILTER (total_ms > 0), 3) AS median_ms, {_ix(0.5)} AS p50_ms, {_ix(0.95)} AS p95_ms, {_ix(0.99)} AS p99_ms"""
NAMES = "string_agg(DISTINCT llm_model, ',' ORDER BY llm_model) AS model_names, string_agg(DISTINCT llm_prompt_version, ',' ORDER BY llm_prompt_version) AS prompt_versions"
RATES = ["error_rate", "personalization_rate", "llm_success_rate", "llm_cost_usd", "mean_explanation_ms", *[f"mean_{s}" for s in mo.STAGES]]
COUNTS = ["request_count", "success_count", "error_count", "llm_calls", "llm_successes", "llm_fallbacks", "llm_tokens"]
LATS = ["mean_ms", "min_ms", "max_ms", "median_ms", "p50_ms", "p95_ms", "p99_ms"]


@query(
    "daily_metrics",
    "MON4 MON5 MON6 MON7 DAT4 SET3",
    f"""WITH d AS (SELECT day, {AGG}, {LAT}, {NAMES} FROM requests WHERE day BETWEEN DATE '{START}' AND DATE '{END}' GROUP BY 1), s AS (SELECT CAST(range AS DATE) AS day FROM range(DATE '{START}', DATE '{END}' + INTERVAL 1 DAY, INTERVAL 1 DAY))
   SELECT CAST(s.day AS VARCHAR) AS day, {', '.join(f'coalesce({c}, 0) AS {c}' for c in [*COUNTS, *RATES, *LATS])}, coalesce(model_names, '') AS model_names, coalesce(prompt_versions, '') AS prompt_versions FROM s LEFT JOIN d ON d.day = s.day""",
    "requests",
)
def daily_metrics(t):
    d = mo.daily_metrics(t("requests"), START, END)
    return d.select(F.col("day").cast("string").alias("day"), *COUNTS, *[R(c) for c in RATES], *LATS, "model_names", "prompt_versions")


@query(
    "period_report",
    "MON4 MON7 MON8",
    f"SELECT {AGG}, {LAT}, {NAMES}, round(count(*) / 34, 8) AS avg_per_day FROM requests WHERE day BETWEEN DATE '{START}' AND DATE '{END}'",
    "requests",
)
def period_report(t):
    d = mo.period_report(t("requests"), START, END)
    return d.select(*COUNTS, *[R(c) for c in RATES], *LATS, "model_names", "prompt_versions", R("avg_per_day"))


@query(
    "flow_shares",
    "MON5 MON8",
    "SELECT coalesce(recommendation_flow, 'predict') AS flow, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 8) AS share_pct FROM requests GROUP BY 1",
    "requests",
)
def flow_shares(t):
    return mo.flow_shares(t("requests")).select("flow", "n", R("share_pct"))


@query(
    "daily_flow_and_card_counts",
    "MON5",
    """SELECT CAST(day AS VARCHAR) AS day, 'flow' AS kind, coalesce(recommendation_flow, 'predict') AS item, count(*) AS n FROM requests GROUP BY 1, 3
    UNION ALL SELECT CAST(day AS VARCHAR), 'card', top_card, count(*) FROM requests WHERE top_card <> '' AND top_card <> 'none' GROUP BY 1, 3""",
    "requests",
)
def daily_flow_and_card_counts(t):
    r = t("requests")
    a = mo.counts_by_day(r, mo.flow_name(), "item").withColumn("kind", F.lit("flow"))
    b = mo.top_cards(r, ["day"]).withColumnRenamed("top_card", "item").withColumn("kind", F.lit("card"))
    return a.unionByName(b.select(*a.columns)).withColumn("day", F.col("day").cast("string"))


@query(
    "top_cards",
    "TOP3 MON2",
    "SELECT top_card, count(*) AS n FROM requests WHERE top_card <> '' AND top_card <> 'none' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "requests",
)
def top_cards(t):
    return mo.top_cards(t("requests"), k=10)


@query(
    "window_summary",
    "MON2",
    """SELECT count(*) AS total_records, round(quantile_cont(total_ms, 0.5), 2) AS p50_ms, round(quantile_cont(total_ms, 0.95), 2) AS p95_ms, round(quantile_cont(total_ms, 0.99), 2) AS p99_ms, round(avg(total_ms), 2) AS mean_ms, round(avg(is_personalized), 4) AS personalization_rate FROM requests""",
    "requests",
)
def window_summary(t):
    return mo.window_summary(t("requests"))


@query(
    "performance_snapshot",
    "MON3 MAT2",
    f"""SELECT round(quantile_cont(total_ms, 0.5), 8) AS p50, round(quantile_cont(total_ms, 0.95), 8) AS p95, round(quantile_cont(total_ms, 0.99), 8) AS p99, count(*) AS total_requests, round(avg(total_ms), 8) AS latency_mean, round(stddev_samp(total_ms), 6) AS latency_std,
     {', '.join(f'round(avg(coalesce({s}, 0)), 8) AS stage_{s}' for s in mo.STAGES)}, round(avg(blended_score), 8) AS score_mean, round(stddev_samp(blended_score), 6) AS score_std, min(blended_score) AS score_min, max(blended_score) AS score_max,
     round(avg(is_personalized), 8) AS personalization_rate, (SELECT round(sum(-(n / t) * log2(n / t + 1e-10)), 6) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM requests GROUP BY top_card)) AS top_card_entropy, quantile_cont(total_ms, 0.95) > 10000 AS latency_alert FROM requests""",
    "requests",
)
def performance_snapshot(t):
    d = mo.performance_snapshot(t("requests"))
    six = {"latency_std", "score_std", "top_card_entropy"}
    keep = {"total_requests", "score_min", "score_max", "latency_alert"}
    return d.select(*[F.col(c) if c in keep else R(c, 6 if c in six else 8) for c in d.columns])


@query(
    "latency_benchmark",
    "MON10",
    """SELECT count(*) AS n_requests, round(avg(value), 3) AS mean_ms, round(median(value), 3) AS p50_ms, round(list_sort(list(value))[least(count(*) - 1, greatest(0, floor(count(*) * 0.95::DOUBLE) - 1))::BIGINT + 1], 3) AS p95_ms, round(max(value), 3) AS max_ms,
     list_sort(list(value))[least(count(*) - 1, greatest(0, floor(count(*) * 0.95::DOUBLE) - 1))::BIGINT + 1] <= 2000 AS passed FROM events""",
)
def latency_benchmark(t):
    return mo.budget_percentile(t("events"), "value", 2000.0)


@query(
    "day_keys",
    "DAT3",
    """SELECT CASE WHEN l_partkey % 31 = 0 THEN 'unknown' WHEN l_partkey % 37 = 0 THEN '2031-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def day_keys(t):
    ts = F.when(F.col("date_text") == "not-a-date", F.col("date_text")).otherwise(F.concat(F.col("date_text"), F.lit("T10:00:00Z")))
    return t("raw_transactions").groupBy(mo.day_key(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "model_versions",
    "SET3",
    "SELECT DISTINCT model_version FROM requests WHERE model_version IS NOT NULL",
    "requests",
)
def model_versions(t):
    return mo.distinct_sorted(t("requests"), "model_version")


RUNS = "r AS (SELECT task, run, max(duration_sec) AS d FROM task_timings GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY run DESC) AS i FROM r), b AS (SELECT task, median(d) AS base, count(*) AS nb FROM k WHERE i BETWEEN 2 AND 11 GROUP BY 1)"


@query(
    "task_regressions",
    "WIN7 MON11",
    f"WITH {RUNS} SELECT k.task, CAST(run AS VARCHAR) AS run, d AS current_sec, round(base, 8) AS baseline_sec, nb AS baseline_runs, round((d - base) / base, 8) AS ratio, (d - base) / base >= 0.2 AND d - base >= 5 AS regression FROM k LEFT JOIN b ON b.task = k.task WHERE i = 1",
    "task_timings",
)
def task_regressions(t):
    d = mo.task_regressions(mo.task_runs(t("task_timings")))
    return d.select("task", F.col("run").cast("string").alias("run"), "current_sec", R("baseline_sec"), "baseline_runs", R("ratio"), "regression")


@query(
    "slowest_tasks",
    "TOP5",
    "SELECT task, event_id, duration_sec FROM task_timings ORDER BY duration_sec DESC, event_id LIMIT 5",
    "task_timings",
)
def slowest_tasks(t):
    return mo.slowest(t("task_timings"), 5).select("task", "event_id", "duration_sec")


@query(
    "critical_path",
    "TOP5",
    "SELECT CAST(run AS VARCHAR) AS run, round(max(epoch_us(started_at) / 1e6 + duration_sec) - min(epoch_us(started_at) / 1e6), 2) AS critical_path_sec FROM task_timings GROUP BY 1",
    "task_timings",
)
def critical_path(t):
    return mo.critical_path(t("task_timings")).select(F.col("run").cast("string").alias("run"), R("critical_path_sec", 2))


@query(
    "best_runs",
    "TOP6 TOP8",
    "SELECT trial, metric FROM trials ORDER BY metric, trial LIMIT 7",
    "trials",
)
def best_runs(t):
    return mo.best_run(t("trials").select("trial", "metric"), "metric", "trial", maximize=False, k=7)


@query(
    "champion_check",
    "TOP6",
    """SELECT max(metric) FILTER (trial % 10 = 0) AS champion_metric, 1000 >= max(metric) FILTER (trial % 10 = 0) AS promote FROM trials""",
    "trials",
)
def champion_check(t):
    runs = t("trials").withColumn("model_status", F.when(F.col("trial") % 10 == 0, "champion").otherwise("archived"))
    return mo.promote(1000.0, runs, "metric")


HIST = "h AS (SELECT task, run AS ts, count(*) AS total, round(avg(duration_sec), 6) AS mean FROM task_timings GROUP BY 1, 2)"


def _history(t):
    return t("task_timings").groupBy("task", F.col("run").alias("ts")).agg(F.count(F.lit(1)).alias("total"), F.round(F.avg("duration_sec"), 6).alias("mean"))


@query(
    "history_changes",
    "WIN8 SNK6",
    f"""WITH {HIST}, p AS (SELECT *, lag(total) OVER (PARTITION BY task ORDER BY ts) AS previous FROM h) SELECT task, CAST(ts AS VARCHAR) AS ts, total, previous, total - previous AS delta,
     round(CASE WHEN previous IS NOT NULL THEN CASE WHEN previous > 0 THEN (total - previous) / previous * 100 ELSE 0 END END, 8) AS pct_change FROM p""",
    "task_timings",
)
def history_changes(t):
    d = mo.with_previous(_history(t), "task", "ts", "total")
    return d.select("task", F.col("ts").cast("string").alias("ts"), "total", "previous", "delta", R("pct_change"))


@query(
    "history_latest",
    "SNK6 SRC5",
    f"WITH {HIST} SELECT task, CAST(ts AS VARCHAR) AS ts, total FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY ts DESC) AS k FROM h) WHERE k = 1",
    "task_timings",
)
def history_latest(t):
    return mo.latest(_history(t), "task", "ts").select("task", F.col("ts").cast("string").alias("ts"), "total")


@query(
    "metric_trend",
    "WIN10",
    "WITH h AS (SELECT part_no AS version, started_at AS ts, event_id, duration_sec AS value FROM task_timings WHERE task = 'view') SELECT version, value FROM (SELECT *, row_number() OVER (PARTITION BY version ORDER BY ts DESC, event_id, value) AS k FROM h) WHERE k = 1",
    "task_timings",
)
def metric_trend(t):
    h = t("task_timings").select(F.col("part_no").alias("version"), F.col("started_at").alias("ts"), "event_id", F.col("task").alias("metric"), F.col("duration_sec").alias("value"))
    return mo.metric_trend(h, "view").select("version", "value")


IMP = "lg AS (SELECT l_returnflag AS segment, 'quantity' AS feature, l_quantity - 25 AS value FROM lineitem UNION ALL SELECT l_returnflag, 'discount', l_discount * 100 - 5 FROM lineitem UNION ALL SELECT l_returnflag, 'tax', l_tax * 100 - 4 FROM lineitem)"


def _contrib(t):
    parts = F.array(
        F.struct(F.lit("quantity").alias("feature"), (F.col("l_quantity") - 25).alias("value")),
        F.struct(F.lit("discount").alias("feature"), (F.col("l_discount") * 100 - 5).alias("value")),
        F.struct(F.lit("tax").alias("feature"), (F.col("l_tax") * 100 - 4).alias("value")),
    )
    return t("lineitem").select(F.col("l_returnflag").alias("segment"), F.inline(parts))


@query(
    "feature_importance",
    "WIN9",
    f"WITH {IMP} SELECT segment, feature, round(avg(abs(value)), 8) AS mean_abs, row_number() OVER (PARTITION BY segment ORDER BY avg(abs(value)) DESC, feature)::INT AS rank FROM lg GROUP BY 1, 2",
)
def feature_importance(t):
    return mo.feature_importance(_contrib(t), ["segment"]).select("segment", "feature", R("mean_abs"), "rank")


@query(
    "top_features_by_segment",
    "TOP7",
    f"WITH {IMP}, r AS (SELECT segment, feature, row_number() OVER (PARTITION BY segment ORDER BY avg(abs(value)) DESC, feature) AS k FROM lg GROUP BY 1, 2) SELECT segment, max(feature) FILTER (k = 1) AS top_1, max(feature) FILTER (k = 2) AS top_2 FROM r GROUP BY 1",
)
def top_features_by_segment(t):
    return mo.top_features(mo.feature_importance(_contrib(t), ["segment"]), "segment", 2)


# ------------------------------------------------------------------------------ ledger

SUMS = "round(sum(amount), 2) AS total_spend, round(sum(reward_earned), 2) AS total_reward, round(sum(estimated_savings), 2) AS total_savings, count(*) AS transaction_count"


@query("ledger_by_category", "LED1", f"SELECT user_id, coalesce(category, 'other') AS category, {SUMS} FROM ledger GROUP BY 1, 2", "ledger")
def ledger_by_category(t):
    return lg.by_category(t("ledger"))


BYCARD = f"SELECT user_id, coalesce(chosen_card_id, 'unknown') AS card_id, arg_max(coalesce(chosen_card_name, chosen_card_id, 'unknown'), (ts, id, tie_break)) AS card_name, {SUMS} FROM ledger GROUP BY 1, 2"


@query("ledger_by_card", "LED2", BYCARD, "ledger")
def ledger_by_card(t):
    return lg.by_card(t("ledger"), "ts", "id", "tie_break")


FEES = "fees AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {f}::DOUBLE)" for c, _, _, f, _, _ in dims.CURATED_CARDS) + ") f(card_id, annual_fee))"
TOTALS = f"""{FEES}, t AS (SELECT user_id, round(sum(amount), 2) AS total_spend, round(sum(reward_earned), 2) AS total_rewards, round(sum(estimated_savings), 2) AS total_savings, count(*) AS transaction_count FROM ledger GROUP BY 1),
  c AS (SELECT user_id, sum(annual_fee) AS fee FROM (SELECT DISTINCT user_id, chosen_card_id FROM ledger) u JOIN fees ON fees.card_id = u.chosen_card_id GROUP BY 1),
  tt AS (SELECT t.*, round(total_savings - coalesce(fee, 0), 2) AS fee_adjusted_savings, CASE WHEN total_rewards > 0 THEN CASE WHEN total_spend > 0 THEN total_rewards / total_spend * 100 ELSE 0 END END AS rate FROM t LEFT JOIN c ON c.user_id = t.user_id)"""


def _fees(t):
    return F.broadcast(sc.card_frame(t("users").sparkSession, sc.curated_portfolio()).select("card_id", "annual_fee"))


@query(
    "ledger_totals",
    "LED3",
    f"WITH {TOTALS} SELECT user_id, total_spend, total_rewards, total_savings, fee_adjusted_savings, transaction_count, round(rate, 8) AS effective_rate FROM tt",
    "ledger",
)
def ledger_totals(t):
    return lg.totals(t("ledger"), _fees(t)).withColumn("effective_rate", F.round("effective_rate", 8))


@query(
    "ledger_insights",
    "LED3",
    f"""WITH {TOTALS}, cat AS (SELECT user_id, category, total_spend, row_number() OVER (PARTITION BY user_id ORDER BY total_spend DESC, category) AS k FROM (SELECT user_id, coalesce(category, 'other') AS category, {SUMS} FROM ledger GROUP BY 1, 2)),
   crd AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total_savings DESC, card_id) AS k FROM ({BYCARD}))
   SELECT tt.user_id, cat.category || ': $' || format('{{:,.2f}}', cat.total_spend) AS top_category, crd.card_name || ': $' || format('{{:,.2f}}', crd.total_savings) AS most_savings, CAST(tt.transaction_count AS VARCHAR) AS transactions,
     CASE WHEN rate IS NOT NULL THEN printf('%.2f', rate) || '%' END AS rate FROM tt JOIN cat ON cat.user_id = tt.user_id AND cat.k = 1 JOIN crd ON crd.user_id = tt.user_id AND crd.k = 1""",
    "ledger",
)
def ledger_insights(t):
    """Entries are put together from their tables once; totals, categories and cards read the written table."""
    ledger = modeling.written(t("ledger").drop("merchant", "source_flow"), sinks.work_folder(t.spark, "ledger"))
    return lg.insights(ledger, _fees(t), "ts", "id", "tie_break")


@query(
    "ledger_entries",
    "LED4 JON9 JON10",
    """WITH o AS (SELECT user_id FROM users WHERE ord % 3 <> 0), s AS (SELECT DISTINCT user_id, card_id FROM user_cards)
   SELECT source_flow, l.category, s.card_id IS NOT NULL AS card_was_saved, count(*) AS n FROM (SELECT user_id, chosen_card_id, source_flow, trim(lower(category)) AS category FROM ledger WHERE source_flow IN ('portfolio', 'transaction', 'quick_transaction', 'manual')) l
   JOIN o ON o.user_id = l.user_id LEFT JOIN s ON s.user_id = l.user_id AND s.card_id = l.chosen_card_id GROUP BY 1, 2, 3""",
    "ledger users user_cards",
)
def ledger_entries(t):
    d = lg.build_entries(t("ledger"), t("user_cards"), t("users").where("ord % 3 <> 0"))
    return d.groupBy("source_flow", "category", "card_was_saved").agg(F.count(F.lit(1)).alias("n"))


@query(
    "ledger_page",
    "TOP2",
    """SELECT id, amount, (SELECT count(*) FROM ledger) AS total, 75 < (SELECT count(*) FROM ledger) AS has_next, (SELECT round(sum(reward_earned), 2) FROM ledger) AS total_rewards FROM ledger ORDER BY ts DESC, id, tie_break LIMIT 25 OFFSET 50""",
    "ledger",
)
def ledger_page(t):
    return lg.page(t("ledger"), 3, 25, "id", "tie_break").select("id", "amount", "total", "has_next", "total_rewards")


@query(
    "ledger_deep_page",
    "TOP2",
    """WITH n AS (SELECT count(*) AS n, round(sum(reward_earned), 2) AS r FROM ledger) SELECT id, amount, n AS total, 25 * 400 < n AS has_next, r AS total_rewards FROM ledger, n ORDER BY ts DESC, id, tie_break LIMIT 25 OFFSET 9975""",
    "ledger",
)
def ledger_deep_page(t):
    """Page 400, found through the counts of time ranges."""
    return lg.page(t("ledger"), 400, 25, "id", "tie_break", chunk_values=2000).select("id", "amount", "total", "has_next", "total_rewards")


@query(
    "ledger_export",
    "SNK4",
    """SELECT id, merchant, amount, category, coalesce(chosen_card_id, '') AS chosen_card_id, coalesce(chosen_card_name, '') AS chosen_card_name, reward_earned, estimated_savings, source_flow, chosen_card_id = 'amex_gold' AS card_was_saved, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS "timestamp" FROM ledger""",
    "ledger",
)
def ledger_export(t):
    return lg.export_rows(t("ledger").withColumn("card_was_saved", F.col("chosen_card_id") == "amex_gold"), "id", "tie_break")
