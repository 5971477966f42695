"""Headline queries, timed: one warm-up, then the median of three runs.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS] and prints
one line of JSON.  Every run builds the query anew and consumes its whole result.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from aerolith.session import build_session
from aerolith.workload import QUERIES

HEADLINES = [
    "fact_build", "kpi_daily", "kpi_monthly", "incremental_monthly", "scd2_rebuild", "scd2_merge",
    "scd2_point_in_time_join", "as_of_read", "as_of_diff", "dq_report", "dq_unique_combo", "anomaly_zscore",
    "report_busiest_routes", "report_worst_routes", "report_airline_delay", "table_changes",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = build_session("bench", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "4g")})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        run(spark, name, sf_dir)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(3)), 3)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
