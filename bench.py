"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query of under REPEAT_UNDER seconds runs three times and counts with its median; ``spread`` is its slowest
less its fastest run, so that a change within it isn't taken for a regression.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("fee_reconciliation", "mode_raw_score", "mode_guarded_score", "mode_policy_score", "breakdown_sets",
            "guard_summary", "policy_status_by_field", "review_run", "decision_overlay", "shape_violations", "graph_conformance",
            "mcnemar", "bootstrap_interval", "rep_descriptives", "mann_whitney")


REPEAT_UNDER = 6.0


def main() -> None:
    from twinproof.plans import all_queries
    from twinproof.plans.workload import ANCHORS
    from twinproof.session import get_spark

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    # One small pass first, so that the JVM's start-up is not charged to the first query.
    queries["status_histogram"](spark, sf_dir.rsplit("/", 1)[0] + "/sf0.001" if "/sf" in sf_dir else sf_dir).collect()
    seconds: dict[str, float] = {}
    planning: dict[str, float] = {}
    spread: dict[str, float] = {}
    for name in HEADLINE:
        runs: list[tuple[float, float]] = []
        while len(runs) < (3 if not runs or runs[0][0] < REPEAT_UNDER else 1):
            started = time.perf_counter()
            df = queries[name](spark, sf_dir)
            df._jdf.queryExecution().executedPlan()
            planned = time.perf_counter() - started  # with what a query stores before its last step
            df.write.format("noop").mode("overwrite").save()
            runs.append((time.perf_counter() - started, planned))
        seconds[name], planning[name] = (round(median(r[i] for r in runs), 3) for i in (0, 1))
        spread[name] = round(max(runs)[0] - min(runs)[0], 3)
        print(f"{name}: {seconds[name]}s in the median of {len(runs)}, of which {planning[name]}s before the last job", file=sys.stderr, flush=True)
    count = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
    lines, cells, cases = count("lineitem"), 14 * count("orders"), sum(map(count, ANCHORS))
    rows = {"fee_reconciliation": lines, "mode_raw_score": cases, "mode_guarded_score": cases, "mode_policy_score": cases,
            "breakdown_sets": cases, "guard_summary": cells, "policy_status_by_field": cells, "review_run": cells,
            "decision_overlay": cells, "shape_violations": cells, "graph_conformance": cells}
    print(json.dumps({
        "metric": "total_headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rsplit("/", 1)[-1].removeprefix("sf"),
        "fee_rows_per_sec": round(lines / seconds["fee_reconciliation"]), "planning": planning, "spread": spread,
        "rows_per_sec": {name: round(n / seconds[name]) for name, n in rows.items()},
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
