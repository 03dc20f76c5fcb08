"""Time the headline queries once each and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma-separated prefixes, default the list below).
"""

from __future__ import annotations

import json
import os
import sys
import time

from riskloom.plans import catalogue
from riskloom.session import get_spark

HEADLINE = (
    "a11_insert_if_absent", "c8_clean_transactions", "d1_dedupe_exact", "d2_transaction_order", "d6_join_branches", "d11_as_of_profile", "d12_recent_transactions",
    "e5_base_features", "f6_behavioral_features", "f9_sequence_dataset", "f11_risk_context", "g2_split_by_proportions", "g7_downsample_majority",
    "h3_engineer_features", "i5_check_features", "j1_branch_ap", "j10_reliability_weighted", "k5_calibration_metrics", "l3_average_precision",
    "l12_operating_points", "m1_rule_score", "m3_score_events", "n4_profile_snapshot", "o3_score_drift", "o5_latency_report", "p1_decision_stats", "q1_scenario_audit",
)


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = [p for p in os.environ.get("BENCH_QUERIES", "").split(",") if p]
    spark = get_spark("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = catalogue.queries()
    names = [n for n in queries if any(n.startswith(p) for p in wanted)] if wanted else list(HEADLINE)
    # One small job so that the first query does not pay for starting the session.
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
