"""Read-only analysis of a built file: levels, comparison, time coverage, histograms, chunk sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.frame import no_nan
from stratacloud.functions.keys import octant

BUCKETS = 20


def level_stats(nodes: DataFrame) -> DataFrame:
    """level, nodes, points, avg_points of nodes(level, n); averages are whole numbers."""
    out = nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("n").alias("points"))
    return out.withColumn("avg_points", F.expr("points div nodes"))


def totals(nodes: DataFrame, bytes_stored: int = 0, bytes_raw: int = 0) -> DataFrame:
    """One row: max_level, nodes, points, avg_points, ratio of raw to stored bytes."""
    out = nodes.agg(F.max("level").alias("max_level"), F.count("*").alias("nodes"), F.sum("n").alias("points"))
    ratio = F.lit(bytes_raw / bytes_stored if bytes_stored else 0.0)
    return out.select("*", F.when(F.col("nodes") > 0, F.expr("points div nodes")).otherwise(0).alias("avg_points"), ratio.alias("ratio"))


def top_children(nodes: DataFrame) -> DataFrame:
    """level, x, y, z of every parent of nodes(level, x, y, z, n) with octant and n of its fullest child, the first of equal ones."""
    parents = [F.shiftright(a, 1).alias(a) for a in "xyz"]
    child = F.struct("n", (-octant(F.col("x"), F.col("y"), F.col("z"))).alias("back"))
    up = nodes.where("level > 0").select((F.col("level") - 1).alias("level"), *parents, child.alias("child"))
    return up.groupBy("level", "x", "y", "z").agg(F.max("child").alias("c")).select("level", "x", "y", "z", (-F.col("c.back")).alias("octant"), F.col("c.n").alias("n"))


def compare_levels(a: DataFrame, b: DataFrame) -> DataFrame:
    """level, nodes and points of two files and their differences; levels of either."""
    x = a.groupBy("level").agg(F.count("*").alias("nodes_a"), F.sum("n").alias("points_a"))
    y = b.groupBy("level").agg(F.count("*").alias("nodes_b"), F.sum("n").alias("points_b"))
    both = x.join(y, "level", "full").na.fill(0)
    return both.select("level", "nodes_a", "nodes_b", "points_a", "points_b", (F.col("nodes_b") - F.col("nodes_a")).alias("nodes_diff"), (F.col("points_b") - F.col("points_a")).alias("points_diff"))


def time_coverage(samples: DataFrame) -> DataFrame:
    """level, nodes, samples, first and last time and their distance from the earliest time of all."""
    out = samples.groupBy("level").agg(
        F.countDistinct("x", "y", "z").alias("nodes"), F.count("*").alias("samples"), F.min("gps_time").alias("first_time"), F.max("gps_time").alias("last_time")
    )
    start = F.min("first_time").over(Window.partitionBy())  # a row for each level
    return out.select("*", (F.col("first_time") - start).alias("from_start"), (F.col("last_time") - F.col("first_time")).alias("span"))


def time_histogram(times: DataFrame, buckets: int = BUCKETS, column: str = "gps_time") -> DataFrame:
    """bucket (0 to buckets - 1), n: equal parts of the time range, the top edge in the last; none if the range is 0."""
    clean = times.select(no_nan(F.col(column)).alias("t")).where("t is not null")
    ends = clean.agg(F.min("t").alias("a"), F.max("t").alias("b"))
    width = (F.col("b") - F.col("a")) / float(buckets)
    bucket = F.least(F.floor((F.col("t") - F.col("a")) / width), F.lit(buckets - 1)).cast("int")
    return clean.join(F.broadcast(ends.where("b > a")), F.lit(True)).select(bucket.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def ranked(values: DataFrame, column: str) -> DataFrame:
    """v, place from 0 and n: values counted once each, so that ranks come from few rows."""
    counted = values.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counted.select("v", "c", F.sum("c").over(upto).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))


def value_at(place: str) -> Column:
    """Aggregate over ranked(): the value at a place from 0."""
    return F.min(F.when(F.col("upto") > F.expr(place), F.col("v")))


def sample_density(entries: DataFrame) -> DataFrame:
    """One row: nodes, least, most, mean and upper median of the samples in a node."""
    sizes = ranked(entries.select(F.size("samples").cast("long").alias("s")), "s")
    return sizes.agg(
        F.max("n").alias("nodes"), F.min("v").alias("least"), F.max("v").alias("most"), (F.sum(F.col("v") * F.col("c")) / F.max("n")).alias("mean"), value_at("n div 2").alias("median")
    )


def chunk_report(plan: DataFrame, target: int) -> DataFrame:
    """One row of the distribution of chunk sizes: percentiles by rank, whole mean, deviation, outliers.

    The deviation is around the whole mean and cut to a whole number.
    """
    sizes = ranked(plan, "estimate")
    stats = sizes.agg(
        F.max("n").alias("chunks"), F.sum(F.col("v") * F.col("c")).alias("points"), F.min("v").alias("least"), F.max("v").alias("most"),
        value_at("cast(round((n - 1) * 0.5D) as bigint)").alias("p50"), value_at("cast(round((n - 1) * 0.9D) as bigint)").alias("p90"), value_at("cast(round((n - 1) * 0.99D) as bigint)").alias("p99"),
        F.coalesce(F.sum(F.when(F.col("v") > target, F.col("c"))), F.lit(0)).alias("above"), F.coalesce(F.sum(F.when(F.col("v") > 2 * target, F.col("c"))), F.lit(0)).alias("double"),
        F.coalesce(F.sum(F.when(F.col("v") * 10 < target, F.col("c"))), F.lit(0)).alias("tiny"), F.coalesce(F.sum(F.when(F.col("v") == 0, F.col("c"))), F.lit(0)).alias("empty"),
        F.sum(F.col("c") * F.col("v").cast("decimal(38,0)") * F.col("v")).alias("squares"),
    )
    mean = F.expr("points div chunks")
    spread = F.col("squares") - 2 * mean.cast("decimal(38,0)") * F.col("points") + mean.cast("decimal(38,0)") * mean * F.col("chunks")
    return stats.select("*", mean.alias("mean"), F.floor(F.sqrt(spread.cast("double") / F.col("chunks"))).cast("long").alias("deviation")).drop("squares")


def return_histogram(points: DataFrame) -> DataFrame:
    """level, x, y, z of each node with counts of return numbers 1 to 15, those of number 0, and its GPS range (0, 0 if none)."""
    returns = [F.count_if(F.col("return_number") == r).alias(f"r{r}") for r in range(1, 16)]
    time = no_nan(F.col("gps_time"))
    return points.groupBy("level", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z")).agg(
        *returns, F.count_if(F.col("return_number") == 0).alias("r0"), F.coalesce(F.min(time), F.lit(0.0)).alias("gps_min"), F.coalesce(F.max(time), F.lit(0.0)).alias("gps_max")
    )


def bars(histogram: DataFrame, width: int = 40) -> DataFrame:
    """bucket, n and a bar of # scaled to the fullest bucket."""
    most = F.max("n").over(Window.partitionBy())
    return histogram.withColumn("bar", F.repeat(F.lit("#"), F.floor(F.col("n") * width / most).cast("int")))
