"""Times every registered query and prints one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local cores
(default 8). All queries run once to warm up, then ``BENCH_RUNS`` times in turn (default 3). The figure
of a query is the median of those runs, from building the plan to the last row, with all rows computed
and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from pathlib import Path

from quillmart.plans.registry import queries
from quillmart.plans.session import local_session


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(query) -> float:
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for query in queries().values():
        seconds(query)
    times = {name: [] for name in queries()}
    for _ in range(runs):
        for name, query in queries().items():
            times[name].append(seconds(query))
    medians = {name: round(statistics.median(t), 3) for name, t in times.items()}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total of median warm query times",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "sf": float(Path(sf_dir).name.removeprefix("sf")),
                "cpus": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
