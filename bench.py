"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then RUNS times; the median counts.  A
run builds the plan and writes the whole result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from planlens.plans.queries import registered
from planlens.session import build_session

HEADLINE = [
    "review_long",
    "review_wide",
    "sheet_unpivot",
    "indicator_matrix",
    "all_stat",
    "all_by_plan",
    "threat_matrix",
    "inclusion_levels",
    "level_heatmap",
    "condensed_flags",
    "condensed_summary",
    "strategy_table",
    "area_metadata",
    "overview_totals",
    "plan_time_stats",
    "polygon_area",
    "polygon_centroid",
    "plan_size_class",
    "map_points",
    "latitude_density",
    "plan_table",
    "plan_results_wide",
]
RUNS = 5


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    work = tempfile.TemporaryDirectory(prefix="planlens-bench-")  # a local session, so one machine is the cluster
    spark = build_session(
        "planlens-bench",
        f"local[{cpus}]",
        **{
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": work.name,
            "spark.sql.shuffle.partitions": cpus,
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    seconds, building = {}, {}
    for name in HEADLINE:
        times, builds = [], []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            result = known[name](spark, folder)
            builds.append(time.perf_counter() - start)
            result.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        building[name] = round(statistics.median(builds[1:]), 3)
    total = round(sum(seconds.values()), 3)
    result = {"metric": "sum of warm median seconds", "value": total, "unit": "sec", "queries": seconds, "of which building": building, "sf": folder}
    print(json.dumps(result))
    spark.stop()
    work.cleanup()


if __name__ == "__main__":
    main()
