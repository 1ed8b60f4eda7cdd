"""List plan operators that would not hold at scale, per registered query."""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from perkline.plans.registry import load_all
from perkline.session import build_session


def main() -> None:
    spark = build_session("audit")
    spark.sparkContext.setLogLevel("ERROR")
    parts = sys.argv[1:]
    for name, q in load_all().items():
        if parts and not any(p in name for p in parts):
            continue
        if name in ("trained_models", "tuned_forest"):
            continue
        plan = q.run(spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
        found = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython") if k in plan]
        lines = plan.split("\n")
        for i, line in enumerate(lines):
            if re.search(r"[:+\- ]Window \[", line):
                below = "\n".join(lines[i : i + 6])
                if "SinglePartition" in below:
                    found.append("Window on one partition: " + line.strip()[:140])
        if found:
            print(name, found)


if __name__ == "__main__":
    main()
