from pyspark.sql import functions as F

from stratacloud.frame import frame_of
from stratacloud.operators.counting import grid_counts
from stratacloud.streaming import tiles
from stratacloud.views import event_points


def test_streamed_counts_equal_batch_counts(spark, sf_dir, tmp_path):
    points = event_points(spark, sf_dir).select("wx", "wy", "wz")
    source = str(tmp_path / "in")
    points.repartition(4).write.parquet(source)
    frame = frame_of(points)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tiles.append_counts(stream, frame, 4, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    merged = tiles.merged_counts(spark.read.parquet(str(tmp_path / "out")))
    batch = grid_counts(points, frame, 4)
    assert merged.exceptAll(batch).isEmpty() and batch.exceptAll(merged).isEmpty()


def test_windowed_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    tiles.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
