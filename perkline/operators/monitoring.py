"""Request-log metrics, task timings, run comparison and metric history.

Two percentile definitions are kept apart on purpose: ``linear`` interpolates between
neighbours, ``indexed`` takes the value at a sorted index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perkline.operators import ordered

STAGES = ["normalize_ms", "deterministic_ms", "personalization_ms", "rank_ms", "llm_explanation_ms"]
COST_PER_1K_TOKENS = 0.005


# ------------------------------------------------------------------------- log frames


def day_key(ts_text: Column) -> Column:
    """Calendar day of an ISO timestamp text, ``unknown`` when unreadable."""
    return F.coalesce(F.date_format(F.try_to_timestamp(ts_text), "yyyy-MM-dd"), F.lit("unknown"))


def input_frame(logs: DataFrame, categories: Sequence[str], preferences: Sequence[str]) -> DataFrame:
    """One row per request with spend and preference columns, missing values 0.

    ``logs`` has the nested request-log schema of ``sources.files.LOG_SCHEMA``.
    """
    f = "input_features"
    spend = {c: F.coalesce(F.try_element_at(F.col(f"{f}.spending_categories"), F.lit(c)), F.lit(0.0)) for c in categories}
    pref = {p: F.coalesce(F.array_contains(F.col(f"{f}.preferred_rewards"), p), F.lit(False)).cast("int") for p in preferences}
    return logs.select(
        "request_id", "timestamp", "user_hash",
        F.coalesce(F.col(f"{f}.monthly_spend"), F.lit(0.0)).alias("monthly_spend"),
        F.coalesce(F.col(f"{f}.transaction_history_count"), F.lit(0)).alias("transaction_history_count"),
        *[v.alias(f"spend_{c}") for c, v in spend.items()],
        *[v.alias(f"pref_{p}") for p, v in pref.items()],
    )


def prediction_frame(logs: DataFrame) -> DataFrame:
    """One row per predicted card."""
    s = logs.select("request_id", "timestamp", F.explode("predicted_scores").alias("s"))
    return s.select(
        "request_id", "timestamp", F.col("s.card_name").alias("card_name"), F.col("s.rank").alias("rank"),
        *[F.coalesce(F.col(f"s.{c}"), F.lit(0.0)).alias(c) for c in ("deterministic_score", "personalization_score", "blended_score")],
    )


def latency_frame(logs: DataFrame) -> DataFrame:
    m = F.col("latency_breakdown_ms")
    names = ["normalize", "deterministic", "personalization", "rank", "llm_explanation", "total"]
    return logs.select(
        "request_id", "timestamp", *[F.coalesce(F.try_element_at(m, F.lit(n)), F.lit(0.0)).alias(f"{n}_ms") for n in names]
    )


def metadata_frame(logs: DataFrame) -> DataFrame:
    return logs.select(
        "request_id", "timestamp", "model_version", "top_card",
        F.coalesce(F.col("is_personalized"), F.lit(False)).alias("is_personalized"), "explanation_latency_ms",
    )


# ------------------------------------------------------------------------ percentiles


def linear_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    return ordered.quantiles(df, groups, value, probs)


def indexed_percentiles(df: DataFrame, groups: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Value at index min(int(n p), n - 1) of the sorted positive values."""
    ranks = {
        name: (lambda n, p=p: F.least(F.floor(n * F.lit(float(p))), n - 1)) for name, p in probs.items()
    }
    return ordered.pick_ranks(df.where(F.col(value) > 0), groups, value, ranks)


def budget_percentile(df: DataFrame, value: str, budget_ms: float) -> DataFrame:
    """Benchmark summary: p95 at index int(0.95 n) - 1, and whether it meets the budget."""
    p = ordered.pick_ranks(
        df, [], value, {"p95": lambda n: F.least(n - 1, F.greatest(F.lit(0), F.floor(n * F.lit(0.95)) - 1))}
    )
    med = ordered.quantiles(df, [], value, {"p50": 0.5}).select("p50").scalar()
    extra = df.agg(F.struct(F.avg(value).alias("mean"), F.max(value).alias("max")).alias("x")).scalar()
    d = p.withColumn("x", extra).withColumn("p50", med)
    return d.select(
        F.col("n_values").alias("n_requests"), F.round("x.mean", 3).alias("mean_ms"), F.round("p50", 3).alias("p50_ms"),
        F.round("p95", 3).alias("p95_ms"), F.round("x.max", 3).alias("max_ms"), (F.col("p95") <= budget_ms).alias("passed"),
    )


# ----------------------------------------------------------------------- daily metrics


def _positive_mean(c: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def request_aggregates() -> list[Column]:
    """Counts, rates, stage means and model usage; works per day, per period, or on a stream."""
    error = F.col("request_status") == "error"
    calls, tokens = F.coalesce(F.sum("llm_calls"), F.lit(0)), F.coalesce(F.sum("llm_tokens"), F.lit(0))
    ok = F.coalesce(F.sum("llm_successes"), F.lit(0))
    n = F.count(F.lit(1))
    errors = F.count(F.when(error, 1))
    return [
        n.alias("request_count"),
        (n - errors).alias("success_count"),
        errors.alias("error_count"),
        F.coalesce(F.try_divide(errors, n), F.lit(0.0)).alias("error_rate"),
        F.coalesce(F.avg(F.coalesce("is_personalized", F.lit(0)).cast("double")), F.lit(0.0)).alias("personalization_rate"),
        *[_positive_mean(s).alias(f"mean_{s}") for s in STAGES],
        calls.alias("llm_calls"),
        ok.alias("llm_successes"),
        F.coalesce(F.sum("llm_fallbacks"), F.lit(0)).alias("llm_fallbacks"),
        tokens.alias("llm_tokens"),
        F.when(calls > 0, ok / calls).otherwise(F.lit(0.0)).alias("llm_success_rate"),
        (tokens / 1000.0 * COST_PER_1K_TOKENS).alias("llm_cost_usd"),
        _positive_mean("explanation_latency_ms").alias("mean_explanation_ms"),
    ]


def name_sets(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sorted model and prompt versions seen, distinct before they are collected."""
    pairs = df.select(
        *groups, F.explode(F.array(F.struct(F.lit("model").alias("k"), F.col("llm_model").alias("v")), F.struct(F.lit("prompt").alias("k"), F.col("llm_prompt_version").alias("v")))).alias("p")
    ).where("p.v IS NOT NULL").select(*groups, "p.k", "p.v").distinct()
    return pairs.groupBy(*groups).agg(
        *[
            F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("k") == k, F.col("v"))))).alias(name)
            for k, name in (("model", "model_names"), ("prompt", "prompt_versions"))
        ]
    )


def latency_stats(df: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean, median, indexed p50/p95/p99, min and max of positive latencies, 3 decimals."""
    pos = df.where(F.col("total_ms") > 0)
    base = pos.groupBy(*groups).agg(
        F.round(F.avg("total_ms"), 3).alias("mean_ms"), F.round(F.min("total_ms"), 3).alias("min_ms"), F.round(F.max("total_ms"), 3).alias("max_ms")
    )
    q = indexed_percentiles(df, groups, "total_ms", {"p50_ms": 0.50, "p95_ms": 0.95, "p99_ms": 0.99}).drop("n_values")
    m = ordered.quantiles(pos, groups, "total_ms", {"median_ms": 0.5}).drop("n_values")
    for c in ("p50_ms", "p95_ms", "p99_ms"):
        q = q.withColumn(c, F.round(c, 3))
    m = m.withColumn("median_ms", F.round("median_ms", 3))
    if not groups:
        return base.withColumn("q", q.select(F.struct("*")).scalar()).withColumn("m", m.select("median_ms").scalar()).select(
            "mean_ms", "min_ms", "max_ms", F.col("m").alias("median_ms"), "q.*"
        )
    return base.join(q, list(groups), "left").join(m, list(groups), "left")


def daily_metrics(requests: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per day; with bounds every day between them appears, empty days as zeros."""
    d = requests
    if start and end:
        d = d.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    out = d.groupBy("day").agg(*request_aggregates()).join(latency_stats(d, ["day"]), "day", "left").join(name_sets(d, ["day"]), "day", "left")
    if start and end:
        spine = requests.sparkSession.range(1).select(
            F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
        )
        out = spine.join(out, "day", "left")
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() in ("long", "double", "integer")]
    return out.na.fill(0, numbers).na.fill("", ["model_names", "prompt_versions"])


def counts_by_day(requests: DataFrame, column: Column, name: str) -> DataFrame:
    return requests.groupBy("day", column.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def flow_name() -> Column:
    return F.coalesce("recommendation_flow", F.lit("predict"))


def top_cards(requests: DataFrame, groups: Sequence[str] = (), k: int | None = None) -> DataFrame:
    """Cards by how often they came out on top, ``none`` and empty left out."""
    c = requests.where((F.coalesce("top_card", F.lit("")) != "") & (F.col("top_card") != "none"))
    n = c.groupBy(*groups, "top_card").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "top_card").limit(k) if k else n


def period_report(requests: DataFrame, start: str, end: str) -> DataFrame:
    """One row for the period; rates from summed flags, percentiles from raw rows.

    A period without requests gives zeros and empty names.
    """
    d = requests.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    total = d.agg(*request_aggregates())
    lat = latency_stats(d, []).select(F.struct("*")).scalar()
    names = name_sets(d, []).select(F.struct("*")).scalar()
    days = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date")) + 1
    out = total.withColumn("__l", lat).withColumn("__n", names).select(*total.columns, "__l.*", "__n.*")
    numbers = [f.name for f in out.schema.fields if f.dataType.typeName() in ("long", "double", "integer")]
    out = out.na.fill(0, numbers).na.fill("", ["model_names", "prompt_versions"])
    return out.withColumn("avg_per_day", F.col("request_count") / days)


def flow_shares(requests: DataFrame) -> DataFrame:
    n = requests.groupBy(flow_name().alias("flow")).agg(F.count(F.lit(1)).alias("n"))
    total = requests.agg(F.count(F.lit(1))).scalar()
    return n.withColumn("share_pct", F.col("n") / total * 100)


def window_summary(requests: DataFrame) -> DataFrame:
    """Linear latency percentiles, mean and personalisation rate over the window."""
    q = ordered.quantiles(requests, [], "total_ms", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})
    a = requests.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("total_ms").alias("m"), F.avg(F.col("is_personalized").cast("double")).alias("p")).alias("a")).scalar()
    return q.withColumn("a", a).select(
        F.col("a.n").alias("total_records"), *[F.round(c, 2).alias(c) for c in ("p50_ms", "p95_ms", "p99_ms")],
        F.round("a.m", 2).alias("mean_ms"), F.round("a.p", 4).alias("personalization_rate"),
    )


def performance_snapshot(requests: DataFrame, alert_ms: float = 10000.0) -> DataFrame:
    """Latency, stage, score and top-card figures with the latency alert flag."""
    q = ordered.quantiles(requests, [], "total_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    stage = [F.avg(F.coalesce(s, F.lit(0.0))).alias(f"stage_{s}") for s in STAGES]
    a = requests.agg(
        F.struct(
            F.count(F.lit(1)).alias("total_requests"), F.avg("total_ms").alias("latency_mean"), F.stddev_samp("total_ms").alias("latency_std"), *stage,
            F.avg("blended_score").alias("score_mean"), F.stddev_samp("blended_score").alias("score_std"),
            F.min("blended_score").alias("score_min"), F.max("blended_score").alias("score_max"),
            F.avg(F.col("is_personalized").cast("double")).alias("personalization_rate"),
        ).alias("a")
    ).scalar()
    cards = requests.where(F.col("top_card").isNotNull()).groupBy("top_card").agg(F.count(F.lit(1)).alias("n"))
    total = cards.agg(F.sum("n")).scalar()
    p = F.col("n") / F.col("t")
    e = cards.withColumn("t", total).agg(F.sum(-p * F.log2(p + 1e-10))).scalar()
    return q.drop("n_values").withColumn("a", a).withColumn("top_card_entropy", e).select(
        "p50", "p95", "p99", "a.*", "top_card_entropy", (F.col("p95") > alert_ms).alias("latency_alert")
    )


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


# ------------------------------------------------------------------------ task timings


def task_runs(timings: DataFrame) -> DataFrame:
    """Longest duration per task and run."""
    return timings.groupBy("task", "run").agg(F.max("duration_sec").alias("duration_sec"))


def task_regressions(runs: DataFrame, window: int = 10, ratio: float = 0.2, seconds: float = 5.0) -> DataFrame:
    """Latest run against the median of the runs before it, per task.

    Only ``window + 1`` rows per task are kept; Spark applies that limit before the
    shuffle.
    """
    w = W.partitionBy("task").orderBy(F.col("run").desc())
    recent = runs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= window + 1)
    base = recent.where("r > 1").groupBy("task").agg(F.median("duration_sec").alias("baseline_sec"), F.count(F.lit(1)).alias("baseline_runs"))
    cur = recent.where("r = 1").select("task", "run", F.col("duration_sec").alias("current_sec"))
    d = cur.join(base, "task", "left")
    change = F.when(F.col("baseline_sec") > 0, (F.col("current_sec") - F.col("baseline_sec")) / F.col("baseline_sec"))
    return d.withColumn("ratio", change).withColumn(
        "regression", F.coalesce((F.col("ratio") >= ratio) & (F.col("current_sec") - F.col("baseline_sec") >= seconds), F.lit(False))
    )


def slowest(timings: DataFrame, k: int = 5) -> DataFrame:
    return timings.orderBy(F.col("duration_sec").desc(), "event_id").limit(k)


def critical_path(timings: DataFrame, run: str = "run") -> DataFrame:
    """Seconds from the first start to the last end per run."""
    start = F.unix_micros(F.col("started_at").cast("timestamp")) / 1e6
    return timings.groupBy(run).agg((F.max(start + F.col("duration_sec")) - F.min(start)).alias("critical_path_sec"))


# --------------------------------------------------------------------- runs and history


def best_run(runs: DataFrame, metric: str, key: str, maximize: bool = True, k: int = 1) -> DataFrame:
    order = F.col(metric).desc() if maximize else F.col(metric).asc()
    return runs.where(F.col(metric).isNotNull()).orderBy(order, key).limit(k)


def promote(challenger: float | Column, runs: DataFrame, metric: str, maximize: bool = True) -> DataFrame:
    """Whether the challenger replaces the champion; without a champion it does."""
    champ = runs.where(F.col("model_status") == "champion")
    m = champ.agg((F.max(metric) if maximize else F.min(metric)).alias("champion_metric"))
    c = challenger if isinstance(challenger, Column) else F.lit(float(challenger))
    better = (c >= F.col("champion_metric")) if maximize else (c <= F.col("champion_metric"))
    return m.select("champion_metric", F.coalesce(better, F.lit(True)).alias("promote"))


def with_previous(history: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each snapshot beside the one before it, with delta and percent change.

    A dataset has one snapshot per run, so its window is short.
    """
    w = W.partitionBy(key).orderBy(ts)
    d = history.withColumn("previous", F.lag(value).over(w))
    delta = F.col(value) - F.col("previous")
    return d.withColumn("delta", delta).withColumn(
        "pct_change", F.when(F.col("previous").isNotNull(), F.when(F.col("previous") > 0, delta / F.col("previous") * 100).otherwise(F.lit(0.0)))
    )


def latest(history: DataFrame, key: str, ts: str) -> DataFrame:
    return ordered.first_per_key(history, [key], [-F.unix_micros(F.col(ts).cast("timestamp"))])


def metric_trend(history: DataFrame, metric: str, version: str = "version", ts: str = "ts") -> DataFrame:
    """One point per version of a metric, the latest recording of each."""
    d = history.where(F.col("metric") == metric)
    return ordered.first_per_key(d, [version], [-F.unix_micros(F.col(ts).cast("timestamp"))]).orderBy(version)


def feature_importance(long: DataFrame, groups: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Features by mean absolute contribution, ranked within each group.

    ``long`` has (groups, feature, value); the ranked table is one row per feature.
    """
    m = long.groupBy(*groups, "feature").agg(F.avg(F.abs(value)).alias("mean_abs"), F.count(F.lit(1)).alias("n"))
    over = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    return m.withColumn("rank", F.row_number().over(over.orderBy(F.col("mean_abs").desc(), "feature")))


def top_features(ranked: DataFrame, segment: str, k: int = 5) -> DataFrame:
    """One row per segment with its first k features as columns."""
    return ranked.where(F.col("rank") <= k).groupBy(segment).agg(
        *[F.max(F.when(F.col("rank") == i, F.col("feature"))).alias(f"top_{i}") for i in range(1, k + 1)]
    )
