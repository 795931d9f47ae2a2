"""Checks of a built octree, one row for each rule with the number of rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.frame import Frame, no_nan
from stratacloud.operators.index import ENTRY_BYTES

KEY = ["level", "x", "y", "z"]


def _rule(name: str, broken: DataFrame) -> DataFrame:
    return broken.agg(F.lit(name).alias("rule"), F.count("*").alias("broken"))


def node_checks(nodes: DataFrame, points: int) -> DataFrame:
    """rule, broken of nodes(level, x, y, z, n) against the number of points written."""
    side = F.pow(F.lit(2.0), F.col("level").cast("double"))
    outside = reduce(lambda a, b: a | b, [(F.col(a) < 0) | (F.col(a) >= side) for a in "xyz"])
    parents = nodes.select((F.col("level") - 1).alias("level"), *[F.shiftright(a, 1).alias(a) for a in "xyz"]).where("level >= 0").distinct()
    root = nodes.agg(F.count_if(F.col("level") == 0).alias("roots"), F.coalesce(F.sum("n"), F.lit(0)).alias("sum"))
    return reduce(
        DataFrame.unionByName,
        [
            _rule("unique keys", nodes.groupBy(*KEY).count().where("count > 1")),
            _rule("key within its level", nodes.where(outside)),
            _rule("ancestors present", parents.join(nodes, KEY, "left_anti")),
            _rule("interior nodes hold points", nodes.where("n = 0").join(parents, KEY, "left_semi")),
            _rule("root present", root.where("roots <> 1")),
            _rule("points conserved", root.where(F.col("sum") != points)),
        ],
    )


def point_checks(points: DataFrame, frame: Frame) -> DataFrame:
    """rule, broken of points(level, kx, ky, kz, wx, wy, wz) against the bounds of their nodes."""
    side = F.lit(2.0 * frame.half) / F.pow(F.lit(2.0), F.col("level").cast("double"))
    slack = frame.half * 2.0**-40  # readers rebuild borders in another order of operations
    inside = F.lit(True)
    for a, c in zip("xyz", frame.center):
        low = F.lit(c - frame.half) + F.col(f"k{a}") * side
        inside = inside & (F.col(f"w{a}") >= low - slack) & (F.col(f"w{a}") <= low + side + slack)
    return _rule("points within their nodes", points.where(~inside))


def contiguous_chunks(entries: DataFrame) -> DataFrame:
    """rule, broken: entries(offset, byte_size, point_count) that begin where no other ends, offsets used twice, empty entries with a place.

    Equi-joins on the offset: no task sees all nodes.
    """
    full = entries.where("point_count > 0")
    # a chunk that isn't the first must begin where some other ends, and two can't begin at one place
    ends = full.select((F.col("offset") + F.col("byte_size")).alias("offset")).distinct()
    first = full.agg(F.min("offset").alias("first"))
    gaps = full.join(ends, "offset", "left_anti").join(F.broadcast(first), F.col("offset") > F.col("first")).select("offset")
    twice = full.groupBy("offset").agg(F.count("*").alias("n")).where("n > 1").select("offset")
    empty = entries.where("point_count = 0 and (offset <> 0 or byte_size <> 0)").select("offset")
    return _rule("chunks contiguous", gaps.unionByName(twice).unionByName(empty))


def sample_checks(samples: DataFrame, points: DataFrame) -> DataFrame:
    """rule, broken of temporal samples(level, x, y, z, place, gps_time) against nodes(level, x, y, z, n)."""
    node = samples.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("place", "gps_time"))).alias("s"), F.max("place").alias("last"))
    late = F.exists(F.sequence(F.lit(2), F.size("s")), lambda i: F.element_at("s", i)["gps_time"] < F.element_at("s", i - 1)["gps_time"])
    sorted_ = node.where((F.size("s") > 1) & late)
    ends = node.join(points.select(*KEY, "n"), KEY, "left").where("n is null or last <> n - 1")
    return _rule("samples in time order", sorted_).unionByName(_rule("samples end with the node", ends))


def page_checks(pages: DataFrame, pointers: DataFrame, nodes: DataFrame, start: int, end: int) -> DataFrame:
    """rule, broken of hierarchy pages(offset, byte_size) in the record from start to end, and of pointers(level, x, y, z) to pages.

    Overlaps are sought within ranges as wide as the largest page: a page lies in two of them
    at most, so no task sees all pages.
    """
    stop = F.col("offset") + F.col("byte_size")
    spans = pages.join(F.broadcast(pages.agg(F.greatest(F.max("byte_size"), F.lit(1)).alias("_wide"))), F.lit(True)).where("byte_size > 0")
    own = F.expr("offset div _wide")
    spans = spans.select("offset", stop.alias("stop"), own.alias("own"), F.explode(F.sequence(own, F.expr("(offset + byte_size - 1) div _wide"))).alias("at"))
    earlier = Window.partitionBy("at").orderBy("offset", "stop").rowsBetween(Window.unboundedPreceding, -1)
    overlaps = spans.withColumn("before", F.max("stop").over(earlier)).where("own = at and before > offset")
    return reduce(
        DataFrame.unionByName,
        [
            _rule("pages of whole entries", pages.where(F.col("byte_size") % ENTRY_BYTES != 0)),
            _rule("pages within the record", pages.where((F.col("offset") < start) | (stop > end))),
            _rule("pages apart", overlaps),
            _rule("pointers resolve", pointers.join(nodes, KEY, "left_anti")),
        ],
    )


def summary_checks(points: DataFrame, declared: DataFrame) -> DataFrame:
    """rule, broken: files whose header differs from their points.

    points(file_idx, wx, wy, wz, gps_time, return_number); declared has a row for each file: file_idx,
    points, min_x to max_z, gps_min, gps_max, returns (points by return number 1 to 15), scale, center_x
    to center_z, half.  Bounds agree within a millionth of the scale.  A file without points must
    declare the times 0 and 0; its bounds are free.
    """
    time = no_nan(F.col("gps_time"))
    found = points.groupBy(F.col("file_idx").alias("_file")).agg(
        F.count("*").alias("_n"), *[f(f"w{a}").alias(f"_{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))],
        F.coalesce(F.min(time), F.lit(0.0)).alias("_first"), F.coalesce(F.max(time), F.lit(0.0)).alias("_last"),
        F.array(*[F.count_if(F.col("return_number") == r) for r in range(1, 16)]).alias("_returns"),
    )
    both = declared.join(found, F.col("file_idx") == F.col("_file"), "left")
    full = F.col("_file").isNotNull()
    any_of = lambda tests: reduce(lambda a, b: a | b, tests)
    off = any_of([F.abs(F.col(f"{n}_{a}") - F.col(f"_{n}_{a}")) > F.col("scale") * 1e-6 for a in "xyz" for n in ("min", "max")])
    slack = F.col("half") * 2.0**-40
    out = any_of([(F.col(f"min_{a}") < F.col(f"center_{a}") - F.col("half") - slack) | (F.col(f"max_{a}") > F.col(f"center_{a}") + F.col("half") + slack) for a in "xyz"])
    rules = {
        "points counted": F.col("points") != F.coalesce("_n", F.lit(0)),
        "bounds agree": full & off,
        "cube holds bounds": full & out,
        "time range agrees": (F.col("gps_min") != F.coalesce("_first", F.lit(0.0))) | (F.col("gps_max") != F.coalesce("_last", F.lit(0.0))),
        "returns agree": F.col("returns") != F.coalesce("_returns", F.array_repeat(F.lit(0).cast("long"), 15)),
    }
    counted = both.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return counted.unpivot([], list(rules), "rule", "broken")
