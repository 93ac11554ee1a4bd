"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

import importlib
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = ["snap_status", "within_count", "contains_first", "smallest_containing", "room_ambiguity", "group_index", "name_rank_top8", "popular_decay", "maneuvers", "nav_progress", "rate_limit", "asof_fresh", "components", "shortest_path", "route", "room_search", "search_top8", "area_or_near", "network_built", "feature_visibility", "p1_found", "p2_found", "p3_found", "p4_found", "p5_found", "p6_ids", "p7_found", "p8_found", "p8_stats"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = importlib.import_module("__spark_entry__").queries()
    # The session's start and the first Python workers are no query's own time.
    queries["lang_sources"](spark, folder).write.format("noop").mode("overwrite").save()
    queries["within_anti"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in queries:
            continue
        began = time.time()
        try:
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - began, 3)
        except Exception as error:  # a failed query must not hide the others' times
            print(f"{name}: {str(error)[:300]}", file=sys.stderr)
            times[name] = None
        spark.catalog.clearCache()
    total = sum(t for t in times.values() if t is not None)
    print(json.dumps({"metric": "total_seconds", "value": round(total, 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
