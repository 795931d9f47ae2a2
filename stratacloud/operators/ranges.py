"""Byte ranges of remote files: neighbours merged into few requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 1024


def coalesce_ranges(ranges: DataFrame, gap: int = GAP) -> DataFrame:
    """ranges(file, start, length) with request_start and request_length of the request that covers each.

    Ranges that overlap or lie at most `gap` bytes apart share a request.  The window runs
    over the ranges of one file.
    """
    own = Window.partitionBy("file").orderBy("start", "length")
    ended = ranges.withColumn("_end", F.max(F.col("start") + F.col("length")).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    begins = F.col("_end").isNull() | (F.col("start") > F.col("_end") + gap)
    island = ended.withColumn("_request", F.sum(begins.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("file", "_request")
    first, last = F.min("start").over(whole), F.max(F.col("start") + F.col("length")).over(whole)
    return island.select("file", "start", "length", first.alias("request_start"), (last - first).alias("request_length"))
