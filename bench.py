"""Time the registered queries: one JSON line on stdout.

BENCH_SF_DIR   folder of Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default: every registered query)
BENCH_RUNS     timed runs per query, the median counts (default 1)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from broadloom.plans.catalogue import CATALOGUE

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("broadloom-bench")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(CATALOGUE)
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session()
    # Start the JVM, the code generator and the Python workers before the clock runs.
    CATALOGUE["gated_write"].build(spark, SF_DIR).count()
    times, failed = {}, {}
    for name in names:
        took = []
        try:
            for _ in range(runs):
                start = time.perf_counter()
                CATALOGUE[name].build(spark, SF_DIR).write.format("noop").mode("overwrite").save()
                took.append(time.perf_counter() - start)
            times[name] = round(statistics.median(took), 3)
        except Exception as ex:
            failed[name] = f"{type(ex).__name__}: {str(ex)[:200]}"
        print(f"{name} {times.get(name, 'failed')}", file=sys.stderr, flush=True)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": int(CPUS)}
    if failed:
        out["failed"] = failed
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
