"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Every query
runs once untimed, so that class loading and code generation are not measured, and then
once timed, plan building included.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fixture.registry import queries  # noqa: E402
from shoalkit.session import build_session, use_own_folder  # noqa: E402

HEADLINE = [
    "metrics_long", "sampling_events", "abundance_region_status_year", "complete_counts",
    "top_species_region", "top_species", "region_stats", "region_assign_sites", "metric_timeseries", "length_density",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
         # One file of some megabytes is read by all cores.
         "spark.sql.files.maxPartitionBytes": "2m"},
    )
    use_own_folder(spark).sparkContext.setLogLevel("ERROR")
    known, timings = queries(), {}
    names = HEADLINE if len(sys.argv) < 2 else (list(known) if sys.argv[1] == "all" else sys.argv[1:])

    def seconds(name):
        start = time.perf_counter()
        # The whole result is computed and thrown away row by row.
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    for name in names:
        seconds(name)
    for name in names:
        timings[name] = seconds(name)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
