"""Times every registered query and prints one JSON line.

Each query runs once to warm up, then ``BENCH_RUNS`` times, long ones once; the median counts. Results go to the
no-op sink, so all columns of all rows are computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from embergrid.plans.catalog import QUERIES
from embergrid.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
# A query that takes longer to warm up is timed once.
LONG_SECONDS = 20
ONLY = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]


def main() -> None:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    spark = build_session(
        "embergrid-bench",
        **{
            "spark.master": f"local[{CPUS}]",
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = ONLY or list(QUERIES)
    seconds = {}
    for name in names:
        runs = RUNS if run(name) < LONG_SECONDS else 1
        seconds[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total median seconds, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "master": f"local[{CPUS}]",
                "runs": RUNS,
            }
        )
    )


if __name__ == "__main__":
    main()
