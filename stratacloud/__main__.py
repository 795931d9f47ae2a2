"""python -m stratacloud convert|preview|inspect: the pipeline from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratacloud import memory
from stratacloud.functions import sizing
from stratacloud.operators import inspect
from stratacloud.plans import observer, pipeline


def main() -> None:
    parser = argparse.ArgumentParser(prog="stratacloud")
    parser.add_argument("what", choices=["convert", "preview", "inspect"])
    parser.add_argument("source")
    parser.add_argument("target", nargs="?")
    parser.add_argument("--memory-limit", help="such as 16Gi; without it, the limit found on this machine")
    parser.add_argument("--temporal-stride", type=int)
    parser.add_argument("--progress", choices=["plain", "json", "none"], default="plain")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("stratacloud").getOrCreate()
    limit = spark.range(1).select(sizing.parse_size(F.lit(args.memory_limit)).alias("n")).first()["n"] if args.memory_limit else memory.detect()
    watcher = {"plain": observer.Plain, "json": observer.JsonLines, "none": observer.Silent}[args.progress]()
    config = pipeline.with_budget(pipeline.Config(temporal_stride=args.temporal_stride, observer=watcher), limit)
    if args.what == "convert":
        if not args.target:
            parser.error("convert needs a target folder")
        for name, path in pipeline.convert(spark, args.source, args.target, config).items():
            print(name, path)
    elif args.what == "preview":
        planned = pipeline.scan_files(spark, args.source, config).validate().plan()
        inspect.chunk_report(planned.chunks, planned.target).show(truncate=False)
    else:
        nodes = spark.read.parquet(f"{args.source}/hierarchy").withColumn("n", F.col("point_count"))
        inspect.level_stats(nodes).orderBy("level").show()
        if args.target:
            other = spark.read.parquet(f"{args.target}/hierarchy").withColumn("n", F.col("point_count"))
            inspect.compare_levels(nodes, other).orderBy("level").show()


if __name__ == "__main__":
    main()
