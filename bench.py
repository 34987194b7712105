"""Headline queries on stored tables; prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from framelens.plans.catalog import QUERIES

ROOT = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = ("window_features", "summary_by", "time_windows", "sliding_windows", "impute_mean", "gaze_window_features",
            "attach_frames", "assign_valid_windows", "extract_normal_frames", "diff_windows", "greedy_match",
            "group_split", "stream_verdict", "nearest_neighbours", "train_random_forest")


def session() -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{CPUS}]").appName("framelens-bench")
               .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false"))
    builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="framelens-bench-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str) -> float:
    """Median of the warm runs; every run builds the plan and writes all rows to a sink that drops them."""
    taken = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        QUERIES[name](spark, ROOT).write.format("noop").mode("overwrite").save()
        taken.append(time.perf_counter() - start)
    return statistics.median(taken[1:])


def main() -> None:
    spark = session()
    names = sys.argv[1:] or HEADLINE
    queries = {name: round(seconds(spark, name), 3) for name in names}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(queries.values()), 3), "unit": "sec",
                      "queries": queries, "sf": os.path.basename(ROOT.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
