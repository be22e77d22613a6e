"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from dqspark.queries import QUERIES
from dqspark.runtime import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))

HEADLINE = [
    "profile_numeric_stats",
    "profile_table",
    "profile_quantiles",
    "profile_by_run",
    "profile_segments",
    "profile_approx",
    "check_contract",
    "check_contract_by_run",
    "flag_rows",
    "rule_referential",
    "detect",
    "drift_segments",
    "history_anomalies",
    "learned_staleness",
    "multivariate_mahalanobis",
    "incident_risk",
    "analyze_table",
    "suggest_contract",
    "data_diff",
    "quality_gate",
    "repair_deduplicate",
    "validate_repair",
    "fault_matrix",
    "downstream_impact",
    "reachable_columns",
    "group_incidents",
    "similar_incidents",
    "rank_hypotheses",
    "notification_queue",
    "outcome_metrics",
    "stream_profile",
    "stream_analyze",
]


def main() -> None:
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = session("dqspark-bench", cores=CPUS, shuffle_partitions=int(CPUS))
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(REPEATS):
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
