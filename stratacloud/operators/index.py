"""Tables of the written file: order, offsets, hierarchy pages, temporal samples and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.lineage import materialized

KEY = ["level", "x", "y", "z"]
PAGE_STEP = 3
ENTRY_BYTES = 32
TEMPORAL_HEADER, TEMPORAL_POINTER, TEMPORAL_ENTRY = 32, 48, 20


def gps_order(points: DataFrame, id_col: str = "point_id") -> DataFrame:
    """Points partitioned by node and sorted by GPS time within it, ties by id."""
    node = ["level", "kx", "ky", "kz"]
    return points.repartition(*node).sortWithinPartitions(*node, "gps_time", id_col)


def temporal_samples(points: DataFrame, stride: int, id_col: str = "point_id") -> DataFrame:
    """level, x, y, z, place, gps_time: of every node, in GPS order, each stride-th time and the last one."""
    node = Window.partitionBy("level", "kx", "ky", "kz")
    ranked = points.select(
        "level", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z"), "gps_time",
        (F.row_number().over(node.orderBy("gps_time", id_col)) - 1).alias("place"), F.count("*").over(node).alias("n"),
    )
    return ranked.where((F.col("place") % stride == 0) | (F.col("place") == F.col("n") - 1)).drop("n")


def temporal_entries(samples: DataFrame) -> DataFrame:
    """One row for each node: level, x, y, z, samples in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "gps_time"))), lambda s: s["gps_time"])
    return samples.groupBy(*KEY).agg(ordered.alias("samples"))


def running_offsets(rows: DataFrame, size: str, order: list[str], start: int, ranges: int | None = None) -> DataFrame:
    """rows with `offset`: start plus the sizes of all rows before, in `order`.

    Ranges of the order, by default as many as the session has shuffle partitions, are summed apart
    and only one number for each range goes through a single task, so no task sees all rows.
    """
    ranges = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once: both uses below must see the same ranges, also after a lost executor
    ranged = materialized(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(F.sum(size).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return summed.join(bases, "_range").withColumn("offset", F.lit(start) + F.col("_base") + F.col("_inside")).drop("_range", "_base", "_inside")


def chunk_offsets(nodes: DataFrame, data_offset: int, record: int) -> DataFrame:
    """level, x, y, z, offset, byte_size, point_count of nodes(n): contiguous in key order after the chunk table pointer.

    Sizes are those of stored records; empty nodes have offset and size 0.  Sizes and counts are
    stored in 32 bits: a node beyond that fails.
    """
    size = F.col("n") * record
    wide = F.raise_error(F.concat_ws(" ", F.lit("a node of more than 2147483647 bytes or points:"), *KEY, size.cast("string")))
    stored = F.when(F.greatest(size, "n") > 2**31 - 1, wide.cast("long")).otherwise(size)
    sized = nodes.select(*KEY, F.col("n").alias("point_count"), stored.alias("byte_size"))
    full = running_offsets(sized.where("point_count > 0"), "byte_size", KEY, data_offset + 8)
    full = full.select(*KEY, F.col("offset").cast("long").alias("offset"), "byte_size", "point_count")
    empty = sized.where("point_count = 0").select(*KEY, F.lit(0).cast("long").alias("offset"), "byte_size", "point_count")
    return full.unionByName(empty)


def page_boundaries(max_level: int, step: int = PAGE_STEP) -> list[int]:
    """Levels at which pages end: every third one above the deepest."""
    return list(range(step, max_level, step))


def _ancestor(level: Column) -> list[Column]:
    return [F.call_function("shiftright", F.col(a), F.col("level") - level).alias(f"page_{a}") for a in "xyz"]


def _page_level(bounds: list[int], inclusive: bool) -> Column:
    """Level of the root of the page that a node is in: the largest boundary at (or strictly above) its level."""
    out = F.lit(0)
    for b in bounds:
        out = F.when(F.col("level") >= b if inclusive else F.col("level") > b, b).otherwise(out)
    return out


def hierarchy_pages(nodes: DataFrame, max_level: int) -> DataFrame:
    """page_level, page_x, page_y, page_z, entries, pointers, bytes of every hierarchy page.

    A node at a boundary level roots its own page; the page above points to it.
    """
    bounds = page_boundaries(max_level)
    page = ["page_level", "page_x", "page_y", "page_z"]
    own = nodes.withColumn("page_level", _page_level(bounds, True))
    entries = own.select("page_level", *_ancestor(F.col("page_level"))).groupBy(*page).agg(F.count("*").alias("entries"))
    return _with_pointers(entries, page).withColumn("bytes", (F.col("entries") + F.col("pointers")) * ENTRY_BYTES)


def _with_pointers(pages: DataFrame, page: list[str]) -> DataFrame:
    up = F.when(F.col("page_level") > PAGE_STEP, F.col("page_level") - PAGE_STEP).otherwise(0)
    children = pages.where("page_level > 0").withColumn("up", up)
    children = children.select(F.col("up").alias("page_level"), *[F.call_function("shiftright", F.col(f"page_{a}"), F.col("page_level") - F.col("up")).alias(f"page_{a}") for a in "xyz"])
    counted = children.groupBy(*page).agg(F.count("*").alias("pointers"))
    full = pages.join(counted, page, "full")
    return full.select(*page, *[F.coalesce(c, F.lit(0)).alias(c) for c in pages.columns if c not in page], F.coalesce("pointers", F.lit(0)).alias("pointers"))


def temporal_pages(entries: DataFrame, max_level: int) -> DataFrame:
    """page key, entries, samples, min_time, max_time and bytes of every temporal page.

    A node at a boundary level stays in the page above; deeper ones go to the page of their
    ancestor at the boundary.  Times are those of the page's whole subtree, its root node
    included, which is what the pointer to the page carries.
    """
    bounds = page_boundaries(max_level)
    page = ["page_level", "page_x", "page_y", "page_z"]
    own = entries.withColumn("page_level", _page_level(bounds, False)).select("page_level", *_ancestor(F.col("page_level")), F.size("samples").alias("s"))
    counts = own.groupBy(*page).agg(F.count("*").alias("entries"), F.sum("s").cast("long").alias("samples"))
    first, last = F.col("samples")[0], F.element_at("samples", -1)
    levels = F.array(*[F.lit(b) for b in [0, *bounds]])
    spans = entries.select("level", "x", "y", "z", first.alias("a"), last.alias("b"), F.explode(levels).alias("page_level")).where("level >= page_level")
    spans = spans.select("page_level", *_ancestor(F.col("page_level")), "a", "b").groupBy(*page).agg(F.min("a").alias("min_time"), F.max("b").alias("max_time"))
    sized = _with_pointers(counts, page)
    body = F.col("entries") * TEMPORAL_ENTRY + F.col("samples") * 8 + F.col("pointers") * TEMPORAL_POINTER
    return sized.join(spans, page, "left").select(*page, "entries", "samples", "pointers", "min_time", "max_time", body.alias("bytes"))
