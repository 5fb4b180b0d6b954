"""Times the headline queries: one warm-up, then the median of the runs.  Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stackplume.session import build_session  # noqa: E402
from stackplume.testbed import catalog  # noqa: E402

HEADLINE = [
    "D2_city_stats", "D5_composite_target", "D1_impute_station_then_global_median", "D12_pivot_measurements",
    "C1_nearest_site_join", "C2_nearest_distance_in_city", "C4_match_reading", "E1_rolling_mean_rows_7",
    "M1_density_cluster", "P2_build_readings", "P3_build_dataset", "P5_site_risk_scores", "P6_recommendations",
    "P11_tree_plans", "P17_city_day_index", "K1_stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = catalog.load()
    seconds = {}
    for name in names:
        timed = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            timed.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(timed[1:]), 3)
    line = {
        "metric": "total_median_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus), "runs": runs,
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
