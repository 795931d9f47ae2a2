"""Point views over the general tables, so that every operator runs on data that is at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Together these identify a row of the lineitem view.
LINE_ID = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def line_points(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Positions from price, part and quantity; only the columns asked for besides."""
    made = {
        "gps_time": F.unix_timestamp("l_shipdate").cast("double"),
        "return_number": F.col("l_linenumber"),
        "file_idx": (F.col("l_suppkey") % 8).cast("int"),
    }
    rows = table(spark, sf_dir, "lineitem")
    own = [made[k].alias(k) if k in made else F.col(k) for k in keep]
    return rows.select(*own, F.col("l_extendedprice").alias("wx"), (F.col("l_partkey") * 50).cast("double").alias("wy"), (F.col("l_quantity") * 2000.0).alias("wz"))


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from user, value and second of the day, time of the event as GPS time."""
    rows = table(spark, sf_dir, "events")
    seconds = F.unix_timestamp("ts")
    return rows.select(
        F.col("event_id").alias("point_id"), F.col("user_id").cast("double").alias("wx"), F.col("value").alias("wy"), (seconds % 86400).cast("double").alias("wz"), seconds.cast("double").alias("gps_time")
    )
