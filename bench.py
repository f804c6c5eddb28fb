"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local threads. Each query runs
twice, the better time counts; results go to the no-op sink, so every row is made.
"""

from __future__ import annotations

import json
import os
import time

from meshtally.plans.registered import QUERIES
from meshtally.session import build_session

HEADLINE = [
    "parse_packets", "parse_multi", "packet_status", "packet_status_tb", "packet_status_mixed", "lines_to_pdr",
    "latency_between", "round_trips", "energy_by_hops", "node_mode", "assoc_stats", "mad_filter", "ecdf_total",
    "box_stats_ranges", "fitted_cdf", "kde", "series_align", "compare_runs", "experiment_series", "cfg_merge",
    "dup_rows", "top_n", "state_matrix", "pivot_hops",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    wanted = os.environ.get("BENCH_QUERIES")
    for name in wanted.split(",") if wanted else HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
