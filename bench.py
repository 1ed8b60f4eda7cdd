"""Headline timings: one JSON line.  BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from perkline.plans.registry import load_all
from perkline.session import build_session

HEADLINE = [
    "best_card_rewards",
    "portfolio_scores",
    "card_rank_counts",
    "capped_rewards",
    "quick_recommendation",
    "savings_calculator",
    "transactions_cleaned",
    "cleaning_report",
    "user_spending_pivot",
    "user_frequencies",
    "user_features",
    "card_features",
    "quality_suites",
    "domain_rules",
    "outliers_iqr",
    "transaction_statistics",
    "ks_drift",
    "slices_by_column",
    "issuer_bias",
    "explanation_bias",
    "daily_metrics",
    "ledger_by_card",
    "page_listings",
    "model_frame",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    names = (list(registry) if chosen == "all" else chosen.split(",")) if chosen else HEADLINE
    for table in ("lineitem", "orders"):
        spark.read.parquet(f"{folder}/{table}.parquet").write.format("noop").mode("overwrite").save()
    registry["spend_normalized"].run(spark, folder).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").split("sf")[-1]}
    if "portfolio_scores" in times:
        out["scored_transactions_per_sec"] = round(rows / times["portfolio_scores"])
        out["card_scores_per_sec"] = round(rows * 9 / times["portfolio_scores"])
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
