"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores. Every query runs twice, whole
result consumed; the second run counts. Progress goes to stderr.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from arledger.session import configure
from checks.queries import REGISTRY

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))

HEADLINES = (
    "clean_claims",
    "apply_filters_combined",
    "topline_current",
    "aging_summary",
    "employee_productivity",
    "employee_collection",
    "latest_claims",
    "topline_portfolio",
    "snapshot_summary",
    "aging_trend",
    "snapshot_deltas",
    "follow_up_stats",
    "follow_up_by_employee",
    "dashboard_cards",
)


def main() -> None:
    spark = configure(
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        query, _ = REGISTRY[name]
        for _ in range(2):
            start = time.perf_counter()
            query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
