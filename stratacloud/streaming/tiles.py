"""Extensions for tiles and events that keep arriving: counts that grow, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.frame import Frame
from stratacloud.operators.counting import grid_counts


def append_counts(points: DataFrame, frame: Frame, depth: int, path: str, checkpoint: str):
    """Streaming query that appends the cell counts of every micro-batch to a table; merged_counts() adds them up.

    A batch that is run again overwrites its own folder, so counts stay exact.
    """

    def store(batch: DataFrame, number: int) -> None:
        grid_counts(batch, frame, depth).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("x", "y", "z").agg(F.sum("n").alias("n"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    """start, by, n in tumbling windows; rows later than the watermark are left out."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
