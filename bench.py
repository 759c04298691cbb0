"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the data and the cores,
BENCH_RUNS (default 3) the runs of which the median counts; once BENCH_SECONDS (default 900) have gone by, queries run
once. Intermediate tables go after each run, outside the timed part. The spread of the runs is printed beside the median.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from basketry import storage
from verification.queries import QUERIES

HEADLINE = [
    "ingest_purchases",
    "ingest_menu",
    "minmax_features",
    "order_split",
    "user_knn_neighbors",
    "item_knn_neighbors",
    "euclid_knn_neighbors",
    "recommend_user",
    "recommend_item",
    "all_recos_wide",
    "eval_user",
    "eval_item",
    "feedback_rows",
    "user_knn_by_family",
    "recommend_item_all_seeds",
]


def _run(spark, name, folder):
    with storage.scope(spark):
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.time() - start


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("basketry-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    runs, limit = int(os.environ.get("BENCH_RUNS", "3")), float(os.environ.get("BENCH_SECONDS", "900"))
    seconds, spread, begun = {}, {}, time.time()
    # The first query compiles what all share; it does not count.
    _run(spark, "purchase_counts", folder)
    for name in sys.argv[1:] or HEADLINE:
        times = [_run(spark, name, folder)]
        while len(times) < runs and time.time() - begun < limit:
            times.append(_run(spark, name, folder))
        seconds[name] = round(statistics.median(times), 3)
        spread[name] = [round(min(times), 3), round(max(times), 3), len(times)]
        print(name, seconds[name], spread[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "least_most_runs": spread,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
