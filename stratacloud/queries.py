"""Registered queries: every operator of the engine over the general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratacloud import frame as fr
from stratacloud.functions import crs, keys, las, scaling, sizing
from stratacloud.lineage import materialized
from stratacloud.operators import counting, index, inspect, leaves, lod, planning, quality, ranges, scan, validate
from stratacloud.views import LINE_ID, event_points, line_points, table

KEY_DEPTH, GRID_DEPTH, CHUNK_TARGET = 12, 5, 200
LEAF, LEAF_CAP, FINE_LEAF = 1000, 8, 20
LOD_LEAF, LOD_CELLS = 500, 8
STRIDE = 10
PAD = 0.01


def _frame(p: DataFrame) -> fr.Frame:
    """Frame of a view; its cube is padded by PAD as in the SQL, also where the integers need a coarser step."""
    return fr.frame_of(p, pad=PAD)


def quantize_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d, *LINE_ID)
    steps = [scaling.quantize(F.col(f"w{a}"), 0.25, 10.0).alias(a) for a in "xyz"]
    return p.select(*LINE_ID, *steps, *[scaling.snap(F.col(f"w{a}"), 0.25, 10.0).alias(f"s{a}") for a in "xyz"])


def octree_keys(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d, *LINE_ID)
    return p.select(*LINE_ID, "wx", *keys.point_key(_frame(p), KEY_DEPTH))


def _cells(spark: SparkSession, d: str, depth: int) -> DataFrame:
    p = line_points(spark, d)
    return counting.grid_counts(p, _frame(p), depth)


def key_ancestors(spark: SparkSession, d: str) -> DataFrame:
    x, y, z = (F.col(a) for a in "xyz")
    up = [keys.ancestor(F.col(a), 6, 2).alias(f"a{a}") for a in "xyz"]
    return _cells(spark, d, 6).select("x", "y", "z", *[keys.parent(F.col(a)).alias(f"p{a}") for a in "xyz"], *up, keys.octant(x, y, z).alias("octant"), keys.sub_octant(x, y, z, 2).alias("local"))


def key_children(spark: SparkSession, d: str) -> DataFrame:
    cells = _cells(spark, d, 3).select(F.explode(keys.children(F.lit(3), F.col("x"), F.col("y"), F.col("z"))).alias("c"))
    return cells.select("c.*")


def morton_codes(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d, *LINE_ID)
    steps = [scaling.quantize(F.col(f"w{a}"), 0.01) for a in "xyz"]
    return p.select(*LINE_ID, steps[0].alias("x"), keys.morton(*steps).alias("code"))


def sample_cells(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    f = _frame(p)
    placed = p.select("point_id", *f.quantized(counting.world()), *[k.alias(f"p{a}") for a, k in zip("xyz", keys.point_key(f, 2))]).withColumn("plevel", F.lit(2))
    return lod.sample_cells(placed, f).select("point_id", "cell", "code")


def las_flags_bits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    b14, b15 = (F.col("l_linenumber") * 37 % 256).cast("int"), (F.col("l_partkey") % 256).cast("int")
    fmt = (F.col("l_suppkey") % 11).cast("int")
    out = las.output_format(fmt)
    return rows.select(
        *LINE_ID, F.col("l_extendedprice"), las.extended_flags(b14, b15, fmt >= 6).alias("flags"), las.pack_returns(F.col("l_linenumber"), b15).alias("returns"),
        out.alias("output_format"), las.record_length(out, fmt).alias("record_length"), las.has_gps_time(fmt).alias("has_gps"), las.data_type_name(fmt).alias("type_name"),
    )


def file_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan.file_table(line_points(spark, d, "file_idx"))


def file_totals(spark: SparkSession, d: str) -> DataFrame:
    return scan.combined(file_scan(spark, d))


def first_payload(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "supplier").select(F.col("s_suppkey").alias("file_idx"), F.when(F.col("s_acctbal") > 5000, F.col("s_name")).alias("wkt"))
    return scan.first_present(files, "wkt")


def bounds_frame(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d)
    row = fr.bounds(p)
    f = _frame(p)
    low_high = row.first()
    refit = fr.needs_refit(f, tuple(low_high[f"min_{a}"] for a in "xyz"), tuple(low_high[f"max_{a}"] / 2 for a in "xyz"))
    return row.select("*", *[F.lit(c).alias(f"c{a}") for a, c in zip("xyz", f.center)], F.lit(f.half).alias("half"), F.lit(refit).alias("refit"))


def header_mismatch(spark: SparkSession, d: str) -> DataFrame:
    actual = fr.bounds(line_points(spark, d))
    header = actual.select(*[(F.col(f"{n}_{a}") + s).alias(f"{n}_{a}") for n, a, s in (("min", "x", -1.0), ("max", "x", 0.0), ("min", "y", 0.01), ("max", "y", 0.02), ("min", "z", 0.0), ("max", "z", 5.0))])
    return scan.header_mismatch(header, actual, (0.01, 0.01, 0.01))


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    wkt = F.when(k % 7 < 4, F.concat(F.lit('PROJCS["p",AUTHORITY["EPSG","'), F.when(k % 5 == 0, "32633").otherwise("3006"), F.lit('"]]')))
    return table(spark, d, "supplier").select(
        k.alias("file_idx"), wkt.alias("wkt"), F.when(k % 7 == 5, 3006).alias("epsg_h"), F.when(k % 14 == 5, 5613).alias("epsg_v"),
        F.when(k % 11 == 3, 2).otherwise(7).alias("point_format"), F.when(k % 3 > 0, k % 2).alias("schema_id"), F.when(k % 3 > 0, 8).alias("extra_width"), (k % 13 != 4).alias("gps_standard"),
    )


def validate_files(spark: SparkSession, d: str) -> DataFrame:
    return validate.mismatches(_files(spark, d))


def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("data_type"), F.lit(0).alias("options"))
    b = table(spark, d, "region").select(F.col("r_regionkey").alias("place"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("data_type"), F.lit(0).alias("options"))
    return validate.schema_difference(a, b)


def stat_merge(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    low = F.when(k % 17 == 0, float("nan")).when(k % 19 == 0, float("-inf")).otherwise(F.col("l_extendedprice"))
    stats = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("file_idx"), F.col("l_linenumber").alias("place"), low.alias("low"), (F.col("l_extendedprice") * 2).alias("high"), (k % 1000 == 0).alias("no_data"))
    return validate.merged_stats(stats)


def grid_counts(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d, GRID_DEPTH)


def level_rollup(spark: SparkSession, d: str) -> DataFrame:
    return counting.level_totals(_cells(spark, d, GRID_DEPTH), GRID_DEPTH)


def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return planning.chunk_plan(_cells(spark, d, 3), 3, CHUNK_TARGET)


def chunk_routing(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d)
    routed = planning.route_points(p, _frame(p), 3, CHUNK_TARGET, 9)
    return routed.groupBy("chunk_level", "cx", "cy", "cz").agg(F.count("*").alias("n"))


def _leaf_nodes(spark: SparkSession, d: str, leaf: int = LEAF) -> DataFrame:
    p = line_points(spark, d)
    return leaves.leaf_nodes(leaves.leaf_cells(p, _frame(p), leaf, LEAF_CAP))


def leaf_level_summary(spark: SparkSession, d: str) -> DataFrame:
    return leaves.level_summary(_leaf_nodes(spark, d))


def leaf_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _leaf_nodes(spark, d)


def leaf_assign(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    return leaves.assign_leaves(p, _frame(p), LOD_LEAF, LEAF_CAP).select("point_id", "level", "kx", "ky", "kz")


def _lod(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    f = _frame(p)
    placed = materialized(leaves.assign_leaves(p, f, LOD_LEAF, LEAF_CAP).select("point_id", "level", "kx", "ky", "kz", *f.quantized(counting.world())), "leaves")
    deepest = placed.agg(F.max("level")).first()[0] or 0
    return lod.thin(placed, f, deepest, LOD_CELLS)


def lod_points(spark: SparkSession, d: str) -> DataFrame:
    return _lod(spark, d).select("point_id", "level", "kx", "ky", "kz")


def lod_nodes(spark: SparkSession, d: str) -> DataFrame:
    return lod.node_table(_lod(spark, d))


def _samples(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    return index.temporal_samples(leaves.assign_leaves(p, _frame(p), FINE_LEAF, LEAF_CAP), STRIDE)


def temporal_samples(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d)


def temporal_pages(spark: SparkSession, d: str) -> DataFrame:
    entries = materialized(index.temporal_entries(_samples(spark, d)), "entries")
    return index.temporal_pages(entries, entries.agg(F.max("level")).first()[0] or 0)


def hierarchy_offsets(spark: SparkSession, d: str) -> DataFrame:
    nodes = _leaf_nodes(spark, d)
    return index.chunk_offsets(nodes.unionByName(lod.missing_ancestors(nodes)), 600, 36)


def hierarchy_pages(spark: SparkSession, d: str) -> DataFrame:
    nodes = materialized(_leaf_nodes(spark, d, FINE_LEAF), "nodes")
    nodes = nodes.unionByName(lod.missing_ancestors(nodes))
    return index.hierarchy_pages(nodes, nodes.agg(F.max("level")).first()[0] or 0)


def return_histogram(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d, "return_number", "gps_time")
    return inspect.return_histogram(leaves.assign_leaves(p, _frame(p), LEAF, LEAF_CAP))


def level_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.level_stats(_leaf_nodes(spark, d))


def file_stats(spark: SparkSession, d: str) -> DataFrame:
    return inspect.totals(_leaf_nodes(spark, d), 1000, 2500)


def compare_ab(spark: SparkSession, d: str) -> DataFrame:
    return inspect.compare_levels(_leaf_nodes(spark, d), _leaf_nodes(spark, d, FINE_LEAF * 10))


def time_histogram(spark: SparkSession, d: str) -> DataFrame:
    return inspect.time_histogram(line_points(spark, d, "gps_time"))


def time_coverage(spark: SparkSession, d: str) -> DataFrame:
    return inspect.time_coverage(_samples(spark, d))


def sample_density(spark: SparkSession, d: str) -> DataFrame:
    return inspect.sample_density(index.temporal_entries(_samples(spark, d)))


def chunk_size_report(spark: SparkSession, d: str) -> DataFrame:
    return inspect.chunk_report(chunk_plan(spark, d), CHUNK_TARGET)


def quality_checks(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    f = _frame(p)
    thin = materialized(_lod(spark, d), "thin")
    nodes = materialized(lod.node_table(thin), "nodes")
    at = thin.join(p.select("point_id", "wx", "wy", "wz"), "point_id")
    out = quality.node_checks(nodes, p.count()).unionByName(quality.point_checks(at, f))
    return out.unionByName(quality.contiguous_chunks(index.chunk_offsets(nodes, 600, 36)))


def quality_planted(spark: SparkSession, d: str) -> DataFrame:
    """The checks on tables with planted faults of every kind."""
    k = F.col("p_partkey")
    level = (k % 5).cast("int")
    side = F.call_function("shiftleft", F.lit(1), level)
    wide = side + F.when(k % 13 == 0, 1).otherwise(0)
    rows = table(spark, d, "part")
    nodes = rows.select(level.alias("level"), (k * 7 % wide).cast("int").alias("x"), (F.expr("p_partkey div 3") % wide).cast("int").alias("y"), (F.expr("p_partkey div 11") % side).cast("int").alias("z"), (F.col("p_size") % 4).cast("long").alias("n"))
    entries = rows.select((k * 100).alias("offset"), (100 + F.when(k % 17 == 0, 1).otherwise(0)).cast("long").alias("byte_size"), (F.col("p_size") % 3).cast("long").alias("point_count"))
    samples = rows.select(
        F.lit(1).alias("level"), (k % 40).cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"), F.expr("p_partkey div 40").cast("long").alias("place"),
        (F.expr("p_partkey div 40") - F.when(k % 40 == 7, k % 3 * 5).otherwise(0)).cast("double").alias("gps_time"),
    )
    held = samples.groupBy("level", "x", "y", "z").agg((F.count("*") + F.when(F.col("x") % 9 == 4, 1).otherwise(0)).alias("n"))
    return quality.node_checks(nodes, 12345).unionByName(quality.contiguous_chunks(entries)).unionByName(quality.sample_checks(samples, held))


def page_rules(spark: SparkSession, d: str) -> DataFrame:
    """The checks of hierarchy pages on tables with planted faults."""
    k = F.col("p_partkey")
    rows = table(spark, d, "part")
    size = 32 * (1 + k % 3) + F.when(k % 23 == 0, 8).otherwise(0) + F.when(k % 101 == 0, 320).otherwise(0)
    pages = rows.select((k * 96).alias("offset"), size.cast("long").alias("byte_size"))
    nodes = rows.select((k % 9).cast("int").alias("level"), k.cast("int").alias("x"), F.col("p_size").cast("int").alias("y"), F.lit(0).alias("z"))
    pointers = rows.where(k % 3 == 0).select((k % 9).cast("int").alias("level"), k.cast("int").alias("x"), (F.col("p_size") + F.when(k % 7 == 0, 1).otherwise(0)).cast("int").alias("y"), F.lit(0).alias("z"))
    return quality.page_checks(pages, pointers, nodes, 960, 96 * 180)


def summary_rules(spark: SparkSession, d: str) -> DataFrame:
    """The checks of declared bounds, times and returns, on files with planted faults."""
    i = F.col("l_suppkey") % 64
    columns = {"wx": F.col("l_partkey"), "wy": F.col("l_suppkey"), "wz": F.col("l_orderkey"), "gps_time": F.col("l_quantity")}
    points = table(spark, d, "lineitem").select(i.alias("file_idx"), *[c.cast("double").alias(n) for n, c in columns.items()], F.col("l_linenumber").alias("return_number"))
    held = points.groupBy("file_idx").agg(
        F.count("*").alias("n"), *[f(f"w{a}").alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.min("gps_time").alias("gps_min"), F.max("gps_time").alias("gps_max"),
        F.array(*[F.count_if(F.col("return_number") == r) for r in range(1, 16)]).alias("counts"),
    )
    slip = lambda step, by: F.when(F.col("file_idx") % step == 1, by).otherwise(0)
    declared = held.select(
        "file_idx", (F.col("n") + slip(5, 1)).alias("points"), (F.col("min_x") - slip(7, 0.5)).alias("min_x"), (F.col("max_x") + slip(11, 1e-9)).alias("max_x"), "min_y", "max_y", "min_z", "max_z",
        F.col("gps_min"), (F.col("gps_max") + slip(13, 1.0)).alias("gps_max"), F.transform("counts", lambda c, at: F.when(at == 1, c + slip(3, 2)).otherwise(c).cast("long")).alias("returns"),
        F.lit(0.01).alias("scale"), F.lit(30000.0).alias("center_x"), F.lit(0.0).alias("center_y"), F.lit(0.0).alias("center_z"), (F.col("max_z") + 30000 - slip(4, 29500)).cast("double").alias("half"),
    )
    return quality.summary_checks(points, declared)


def plan_vs_actual(spark: SparkSession, d: str) -> DataFrame:
    p = line_points(spark, d)
    f = _frame(p)
    cells = materialized(counting.grid_counts(p, f, 3), "cells")
    return planning.planned_and_actual(planning.chunk_plan(cells, 3, CHUNK_TARGET), planning.route_points(p, f, 3, CHUNK_TARGET, 9, cells))


def top_children(spark: SparkSession, d: str) -> DataFrame:
    return inspect.top_children(counting.level_totals(_cells(spark, d, GRID_DEPTH), GRID_DEPTH))


def registry_crs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    files = table(spark, d, "supplier").select(k.alias("file_idx"), F.lit(None).cast("string").alias("wkt"), F.when(k % 7 == 5, 3000 + k % 25).alias("epsg_h"), F.when(k % 2 == 1, 5613).alias("epsg_v"))
    registry = table(spark, d, "nation").select((3000 + F.col("n_nationkey")).alias("epsg"), F.concat(F.lit('PROJCS["'), "n_name", F.lit('"]')).alias("wkt"))
    return validate.canonical_crs(files, registry)


def coalesce_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select((F.col("o_custkey") % 16).alias("file"), (F.col("o_orderkey") * 300).alias("start"), (F.col("o_orderkey") % 5000 + 1).alias("length"))
    return ranges.coalesce_ranges(rows)


def bbox_query(spark: SparkSession, d: str) -> DataFrame:
    """Extension: points within a box; the filter is on stored columns and reaches the scan where they are stored."""
    p = line_points(spark, d, *LINE_ID)
    return p.where("wx between 20000.0 and 40000.0 and wy between 10000.0 and 50000.0 and wz <= 60000.0").select(*LINE_ID, "wx", "wy", "wz")


def time_range_query(spark: SparkSession, d: str) -> DataFrame:
    """Extension: nodes whose samples reach into a time range, from page and node ends."""
    entries = index.temporal_entries(_samples(spark, d))
    first, last = F.col("samples")[0], F.element_at("samples", -1)
    return entries.where((last >= 1704800000.0) & (first <= 1704900000.0)).select("level", "x", "y", "z", first.alias("first_time"), last.alias("last_time"))


def lod_query(spark: SparkSession, d: str) -> DataFrame:
    """Extension: points down to level 1."""
    return _lod(spark, d).where("level <= 1").select("point_id", "level")


def epsg_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    wkt = F.concat(
        F.lit('GEOGCS["x",AUTHORITY["EPSG","'), (k * 37 % 40000).cast("string"), F.lit('"]]'),
        F.when(k % 3 == 0, F.concat(F.lit(',VERT_CS["v",AUTHORITY["EPSG","'), (k % 7000).cast("string"), F.lit('"]]  '))).otherwise(F.when(k % 3 == 1, "VERTCRS[none]").otherwise("")),
    )
    h, v = crs.epsg_codes(F.col("wkt"))
    return table(spark, d, "customer").select("c_custkey", wkt.alias("wkt")).select("c_custkey", h.alias("horizontal"), v.alias("vertical"))


def planner_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey") * F.col("c_custkey") * 997 + 1
    rows = table(spark, d, "customer").select("c_custkey", n.alias("n"))
    return rows.select("c_custkey", sizing.split_levels(F.col("n"), 1000).alias("split"), sizing.local_levels(F.col("n")).alias("local"), sizing.grid_size_column(F.col("n"), F.col("c_custkey") * 20_000_000).cast("int").alias("grid"))


def parse_sizes(spark: SparkSession, d: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ["", "k", "M", "Gi", "T", "x"])), (F.col("c_custkey") % 6 + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", F.concat((F.col("c_custkey") / 4.0).cast("decimal(20,2)").cast("string"), unit).alias("text"))
    return rows.select("c_custkey", sizing.parse_size(F.col("text")).alias("bytes"), sizing.parse_count(F.col("text")).alias("points"))


def header_dates(spark: SparkSession, d: str) -> DataFrame:
    days = F.col("c_custkey") * 37 - 900
    doy, year = sizing.day_and_year(days)
    return table(spark, d, "customer").select("c_custkey", doy.alias("day_of_year"), year.alias("year"))


def gps_sorted(spark: SparkSession, d: str) -> DataFrame:
    p = event_points(spark, d)
    placed = leaves.assign_leaves(p, _frame(p), LOD_LEAF, LEAF_CAP)
    node = Window.partitionBy("level", "kx", "ky", "kz").orderBy("gps_time", "point_id")
    return index.gps_order(placed).select("point_id", "gps_time", F.row_number().over(node).alias("place"))


ALL = [
    quantize_roundtrip, octree_keys, key_ancestors, key_children, morton_codes, sample_cells, las_flags_bits, file_scan, file_totals, first_payload,
    bounds_frame, header_mismatch, validate_files, schema_diff, stat_merge, grid_counts, level_rollup, chunk_plan, chunk_routing, leaf_level_summary,
    leaf_nodes, leaf_assign, lod_points, lod_nodes, temporal_samples, temporal_pages, hierarchy_offsets, hierarchy_pages, return_histogram, level_stats,
    file_stats, compare_ab, time_histogram, time_coverage, sample_density, chunk_size_report, quality_checks, coalesce_ranges, bbox_query, time_range_query,
    lod_query, quality_planted, page_rules, summary_rules, plan_vs_actual, top_children, registry_crs, epsg_parse, planner_sizes, parse_sizes, header_dates, gps_sorted,
]
