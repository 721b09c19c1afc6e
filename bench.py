"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the local cores (default all).
Each query is materialised in full into a sink that keeps nothing. It runs once untimed, which loads
classes and compiles the generated code, and once timed; the untimed run's seconds are given as "first".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from eventloom.plans import catalog
from eventloom.session import local_session

HEADLINE = [
    "b1_strictly_before",
    "w01_lagged_rolling",
    "w02_traffic_ratios",
    "w03_surface_counts",
    "w14_push_delay_state",
    "w15_rolling_quantiles_asof",
    "w16_arrival_delay_state",
    "w19_occupancy_queue",
    "w22_lane_headway_service",
    "w23_workload",
    "w27_release_bounds",
    "w30_fixed_length_history",
    "j05_asof_with_ties",
    "j09_previous_event",
    "j11_nearest_in_range",
    "a01_group_statistics",
    "a05_time_forward_floor",
    "a07_leave_month_out_encoding",
    "d01_d02_metric_block",
    "d05_tail_metrics",
    "m02_group_ols",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "*")
    spark = local_session(cores)
    catalog.QUERIES["a26c_f06_top_values"](spark, folder).collect()  # starts the session, not timed
    first: dict[str, float] = {}
    times: dict[str, float] = {}
    for name in HEADLINE:
        for seconds in (first, times):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "first": first, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
