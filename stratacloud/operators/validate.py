"""Checks that input files can be merged: coordinate system, point format, extra bytes, GPS time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.crs import epsg_codes
from stratacloud.functions.las import has_gps_time
from stratacloud.sources import layout

REASONS = ("crs", "point_format", "extra_bytes", "gps_time")


def resolve_crs(files: DataFrame) -> DataFrame:
    """files(wkt, epsg_h, epsg_v) with wkt_h, wkt_v and has_crs."""
    h, v = epsg_codes(F.col("wkt"))
    return files.withColumns({"wkt_h": h, "wkt_v": v, "has_crs": F.col("wkt").isNotNull() | F.col("epsg_h").isNotNull()})


def mismatches(files: DataFrame) -> DataFrame:
    """file_idx and reason of every file that disagrees with its reference file, and vertical_only warnings.

    files needs file_idx, wkt, epsg_h, epsg_v, point_format, schema_id (null: no extra
    bytes), extra_width, gps_standard.  The reference of the coordinate system and of the
    extra bytes is the first file that has them; of the format and time type, file 0.  A file
    without what the reference has disagrees.  Two texts must be equal; two code pairs, or a
    text and codes, agree if the horizontal codes do, and warn if the vertical ones don't.
    """
    named = resolve_crs(files)
    crs = F.struct("wkt", "epsg_h", "epsg_v", "wkt_h", "wkt_v")
    refs = named.agg(
        F.min_by(F.when(F.col("has_crs"), crs), F.when(F.col("has_crs"), F.col("file_idx"))).alias("r"),
        F.min_by("point_format", "file_idx").alias("r_format"),
        F.min_by("gps_standard", "file_idx").alias("r_gps"),
        F.min_by(F.struct("schema_id", "extra_width"), F.when(F.col("schema_id").isNotNull(), F.col("file_idx"))).alias("r_extra"),
    )
    both = named.join(F.broadcast(refs), F.lit(True))  # one row against each file
    texts = F.col("wkt").isNotNull() & F.col("r.wkt").isNotNull()
    h, v = F.coalesce("epsg_h", "wkt_h"), F.coalesce("epsg_v", "wkt_v")
    rh, rv = F.coalesce("r.epsg_h", "r.wkt_h"), F.coalesce("r.epsg_v", "r.wkt_v")
    agree = F.when(texts, F.col("wkt") == F.col("r.wkt")).otherwise(F.coalesce(h == rh, F.lit(False)))
    bad_crs = F.when(F.col("r").isNull(), F.lit(False)).otherwise(~F.col("has_crs") | ~agree)
    vertical = ~bad_crs & F.col("r").isNotNull() & ~texts & ~v.eqNullSafe(rv)
    standard = lambda g: F.coalesce(g, F.lit(True))
    bad_gps = has_gps_time(F.col("point_format")) & (standard(F.col("gps_standard")) != standard(F.col("r_gps")))
    bad_extra = F.when(F.col("r_extra").isNull(), F.lit(False)).otherwise(~(F.col("schema_id").eqNullSafe(F.col("r_extra.schema_id")) & F.col("extra_width").eqNullSafe(F.col("r_extra.extra_width"))))
    found = F.array(
        F.when(bad_crs, "crs"), F.when(F.col("point_format") != F.col("r_format"), "point_format"), F.when(bad_extra, "extra_bytes"), F.when(bad_gps, "gps_time"), F.when(vertical, "vertical_only")
    )
    return both.select("file_idx", F.explode(F.array_compact(found)).alias("reason"))


def schema_id(extra_bytes: Column) -> Column:
    """Digest of an Extra Bytes record's structure: tiles that differ in their ranges only have the same; null without one."""
    structure = F.udf(lambda data: layout.extra_structure(bytes(data)), "binary")
    return F.when(F.length(extra_bytes) > 0, F.sha2(structure(F.coalesce(extra_bytes, F.lit(b""))), 256))


def extra_stats(files: DataFrame) -> DataFrame:
    """stats(file_idx, place, low, high, no_data) of files(file_idx, extra_bytes), a place for each axis of each field."""
    read = F.udf(lambda data: layout.extra_stats(bytes(data)), "array<struct<place: int, low: double, high: double, no_data: boolean>>")
    some = files.where("length(extra_bytes) > 0").select("file_idx", F.explode(read("extra_bytes")).alias("s"))
    return some.select("file_idx", "s.*")


def canonical(files: DataFrame) -> DataFrame:
    """One row of what the merged file inherits: wkt of the first file with one, epsg_h and epsg_v of the first
    file with codes or of that text, extra_bytes of the first file with them, extra_width and gps_standard of
    the first file."""
    coded = F.when(F.col("epsg_h").isNotNull(), F.col("file_idx"))
    first = files.agg(
        F.min_by("wkt", F.when(F.col("wkt").isNotNull(), F.col("file_idx"))).alias("wkt"), F.min_by(F.struct("epsg_h", "epsg_v"), coded).alias("codes"),
        F.min_by("extra_bytes", F.when(F.length("extra_bytes") > 0, F.col("file_idx"))).alias("extra_bytes"),
        F.min_by("extra_width", "file_idx").alias("extra_width"), F.min_by(F.coalesce("gps_standard", F.lit(True)), "file_idx").alias("gps_standard"),
    )
    h, v = epsg_codes(F.col("wkt"))
    named = F.col("codes").isNotNull()
    return first.select("wkt", F.when(named, F.col("codes.epsg_h")).otherwise(h).alias("epsg_h"), F.when(named, F.col("codes.epsg_v")).otherwise(v).alias("epsg_v"), "extra_bytes", "extra_width", "gps_standard")


def canonical_crs(files: DataFrame, registry: DataFrame) -> DataFrame:
    """One row: wkt, epsg_h, vertical_dropped of the merged file.

    The text of the first file that has one; if none has, that which registry(epsg, wkt) gives for the
    horizontal code of the first file with codes, whose vertical code is dropped.  An unknown code gives no text.
    """
    coded = F.when(F.col("epsg_h").isNotNull(), F.col("file_idx"))
    first = files.agg(
        F.min_by("wkt", F.when(F.col("wkt").isNotNull(), F.col("file_idx"))).alias("own"), F.min_by(F.struct("epsg_h", "epsg_v"), coded).alias("codes")
    ).select("own", F.col("codes.epsg_h").alias("epsg_h"), F.col("codes.epsg_v").alias("epsg_v"))
    known = registry.select(F.col("epsg").alias("epsg_h"), F.col("wkt").alias("text"))
    found = F.broadcast(first).join(known, "epsg_h", "left")  # one row
    return found.select(F.coalesce("own", "text").alias("wkt"), "epsg_h", (F.col("own").isNull() & F.col("epsg_v").isNotNull()).alias("vertical_dropped"))


def temporal_problem(point_format: int, stride: int) -> str | None:
    """Why a temporal index can't be written, if it can't."""
    if stride <= 0:
        return "the stride of the temporal index must be positive"
    if point_format in (0, 2):
        return "the point format has no GPS time"
    return None


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """place, what, left, right of each difference of two field lists(place, name, data_type, options).

    Lists of different length give one row, the counts; otherwise each property that differs.
    """
    pairs = a.alias("a").join(b.alias("b"), "place", "full")
    counts = a.agg(F.count("*").alias("n")).join(b.agg(F.count("*").alias("m")), F.lit(True))
    unequal = counts.where("n <> m").select(F.lit(-1).alias("place"), F.lit("count").alias("what"), F.col("n").cast("string").alias("left"), F.col("m").cast("string").alias("right"))
    properties = ["name", "data_type", "options"]
    tall = ", ".join(f"'{p}', cast(a.{p} as string), cast(b.{p} as string)" for p in properties)
    each = pairs.select(F.col("place").cast("int").alias("place"), F.expr(f"stack({len(properties)}, {tall}) as (what, left, right)")).where(~F.col("left").eqNullSafe(F.col("right")))
    equal = counts.where("n = m").select(F.lit(True).alias("same"))
    return unequal.unionByName(each.join(equal, F.lit(True)).drop("same"))


def merged_stats(stats: DataFrame) -> DataFrame:
    """place, low, high, has_range, has_no_data of stats(file_idx, place, low, high, no_data) over all files.

    Values that aren't finite are skipped; a field has a range if any file gave one.
    """
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    out = stats.groupBy("place").agg(F.min(finite("low")).alias("low"), F.max(finite("high")).alias("high"), F.bool_or(F.coalesce("no_data", F.lit(False))).alias("has_no_data"))
    return out.withColumn("has_range", F.col("low").isNotNull() & F.col("high").isNotNull())
