"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores, BENCH_RUNS the runs per query (the fastest
counts), BENCH_ONLY a comma-separated choice of queries, BENCH_LIMIT the seconds after which the jobs of a query are
cancelled. Every run is reported on the error stream as it ends; the line counts what finished.
"""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time

from pyspark.sql import SparkSession

from flowsieve.plans.queries import QUERIES
from flowsieve.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
LIMIT = int(os.environ.get("BENCH_LIMIT", "180"))
ONLY = [name for name in os.environ.get("BENCH_ONLY", "").split(",") if name]


def stop_jobs(spark: SparkSession, over: threading.Event) -> None:
    """Cancels what the query runs from its time limit on, until it ends."""
    wait = LIMIT
    while not over.wait(wait):
        spark.sparkContext.cancelAllJobs()
        wait = 1


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the engine
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name, build in QUERIES.items():
        if ONLY and name not in ONLY:
            continue
        for _ in range(RUNS):
            start = time.perf_counter()
            over = threading.Event()
            watch = threading.Thread(target=stop_jobs, args=(spark, over), daemon=True)
            watch.start()
            try:
                build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
                took = round(time.perf_counter() - start, 3)
                times[name] = min(took, times.get(name, took))
                print(f"{name} {took}", file=sys.stderr, flush=True)
            except Exception as error:
                failed[name] = f"{time.perf_counter() - start:.0f} s: {str(error)[:200]}"
                print(f"{name} failed after {failed[name]}", file=sys.stderr, flush=True)
                break
            finally:
                over.set()
                watch.join()
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "failed": failed,
                "sf": float(scale.group(1)) if scale else None,
                "cpus": CPUS,
                "runs": RUNS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
