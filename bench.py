"""Time the headline queries and print one JSON line.

Reads ``BENCH_SF_DIR`` (a folder of Parquet tables) on ``BENCH_CPUS`` cores.
Every query runs once to warm up, then ``BENCH_RUNS`` times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from registry.queries import QUERIES  # noqa: E402
from tradewind.session import local_session  # noqa: E402

HEADLINE = (
    "silver_orders", "silver_inventory", "silver_stores", "store_performance",
    "product_analysis", "daily_revenue", "inventory_status", "revenue_by_channel",
    "tariff_impact", "store_targets", "channel_roi", "product_margins", "customer_360",
    "health_score", "quarantine_reasons", "file_ingest", "global_rank", "upsert",
    "scd2_history", "run_statistics",
)


def seconds(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tradewind-bench")
    times = {}
    for name in HEADLINE:
        def run(build=QUERIES[name]):
            return build(spark, folder)

        seconds(run)
        times[name] = round(statistics.median(seconds(run) for _ in range(runs)), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of warm medians",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
