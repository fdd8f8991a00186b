"""Headline queries on local Spark; prints one JSON line.

Each query runs once to warm up, then the median of the timed runs counts.
Results go to the `noop` sink: all rows are computed, none are collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from carespark.plans.session import local_session
from gate.catalog import QUERIES

HEADLINE = [
    "vitals_trend", "latest_readings", "clinical_alerts", "alert_history_transform", "enriched_clinical_alerts",
    "fraud_risk", "high_cost_trajectory", "fact_claim", "quality_measures", "star_simulation", "risk_scores",
    "readmit_30d", "readmission_features", "cost_by_category", "high_cost_claimants", "resolve_references",
    "audit_gate", "graph_path", "upsert_latest",
]


def timed(run, spark, folder: str) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(partitions=int(os.environ.get("BENCH_PARTITIONS", "8")))
    result = {}
    for name in names:
        timed(QUERIES[name], spark, folder)
        result[name] = round(statistics.median(timed(QUERIES[name], spark, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(result.values()), 3),
                "unit": "sec",
                "queries": result,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
