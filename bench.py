"""Times the headline queries and prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from stratacloud import catalog

HEADLINE = ["leaf_level_summary", "octree_keys", "grid_counts", "chunk_plan", "chunk_routing", "leaf_assign", "lod_nodes", "hierarchy_offsets", "temporal_pages", "return_histogram", "time_histogram", "coalesce_ranges"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_linenumber").count().collect()  # starts the executor threads
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        print(name, file=sys.stderr, flush=True)
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
