"""Chunk plan: the largest octree cells that hold at most a target of points, and points routed to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.frame import Frame
from stratacloud.functions.keys import ancestor, point_key
from stratacloud.functions.sizing import split_levels
from stratacloud.lineage import materialized
from stratacloud.operators.counting import KEY, level_totals
from stratacloud.operators.joins import cell_join


def chunk_roots(cells: DataFrame, depth: int, target: int) -> DataFrame:
    """level, x, y, z, n of the chunk roots over the counted cells, before finest cells are divided.

    A cell is too large if it holds more than `target` points and can be divided; it is a
    root if it isn't too large and has no parent, or its parent is too large.  Totals only
    grow towards the root, so no cell needs to look further than its parent.
    """
    totals = level_totals(cells, depth)
    large = totals.where((F.col("level") < depth) & (F.col("n") > target)).select(*KEY)
    as_parent = large.select(F.col("level").alias("pl"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    fit = totals.join(large, KEY, "left_anti")
    up = (F.col("pl") == F.col("level") - 1) & (F.col("px") == F.shiftright("x", 1)) & (F.col("py") == F.shiftright("y", 1)) & (F.col("pz") == F.shiftright("z", 1))
    return fit.where("level = 0").unionByName(fit.where("level > 0").join(as_parent, up, "left_semi"))


def chunk_plan(cells: DataFrame, depth: int, target: int) -> DataFrame:
    """level, x, y, z, estimate of every planned chunk; finest cells over the target are divided evenly.

    A divided cell expands to its 8**k parts k levels below, each with an even share of its
    count, the remainder going to the first parts in the order z, y, x.
    """
    roots = chunk_roots(cells, depth, target)
    k = F.when((F.col("level") == depth) & (F.col("n") > target), split_levels(F.col("n"), target)).otherwise(0)
    parts = roots.withColumn("k", k).withColumn("parts", F.pow(F.lit(8.0), "k").cast("int"))
    parts = parts.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.pow(F.lit(2.0), "k").cast("int")
    share = F.expr("n div parts") + (F.col("i") < F.col("n") % F.col("parts")).cast("long")
    local = {"x": F.col("i") % side, "y": F.expr("i div cast(pow(2.0, k) as int)") % side, "z": F.expr("i div cast(pow(4.0, k) as int)")}
    keys = [(F.col(a) * side + v).cast("int").alias(a) for a, v in local.items()]
    return parts.select((F.col("level") + F.col("k")).alias("level"), *keys, share.alias("estimate"))


def cell_chunks(roots: DataFrame, cells: DataFrame, depth: int, target: int) -> DataFrame:
    """x, y, z, cell_points, chunk_level of every counted cell: the level of the chunk that its points belong to."""
    levels = cells.select("x", "y", "z", F.col("n").alias("cell_points"), F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    up = [ancestor(F.col(a), F.lit(depth), F.col("level")).alias(f"a{a}") for a in "xyz"]
    roots = roots.select("level", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"), "n")
    extra = F.when((F.col("level") == depth) & (F.col("n") > target), split_levels(F.col("n"), target)).otherwise(0)
    found = levels.select("x", "y", "z", "cell_points", "level", *up).join(roots, ["level", "ax", "ay", "az"])
    return found.select("x", "y", "z", "cell_points", (F.col("level") + extra).alias("chunk_level"))


def route_points(points: DataFrame, frame: Frame, depth: int, target: int, deepest: int, cells: DataFrame | None = None) -> DataFrame:
    """points with chunk_level, cx, cy, cz.

    The deepest key is computed once; its ancestors are shifts.  The table of finest cells is
    written and looked up by cell_join(): by broadcast up to a checked size.
    """
    from stratacloud.operators.counting import grid_counts

    cells = grid_counts(points, frame, depth) if cells is None else cells
    cells = materialized(cells, "cells")
    lut = materialized(cell_chunks(chunk_roots(cells, depth, target), cells, depth, target), "lut")
    deep = points.select("*", *[k.alias(f"d{a}") for a, k in zip("xyz", point_key(frame, deepest))])
    keyed = deep.select("*", *[F.shiftright(f"d{a}", deepest - depth).alias(a) for a in "xyz"]) if not {"x", "y", "z"} & set(points.columns) else None
    if keyed is None:
        raise ValueError("route_points: points carry world positions only")
    routed = cell_join(keyed, lut, ["x", "y", "z"], "cell_points")
    chunk = [ancestor(F.col(f"d{a}"), F.lit(deepest), F.col("chunk_level")).alias(f"c{a}") for a in "xyz"]
    return routed.select(*points.columns, "chunk_level", *chunk)


def numbered(plan: DataFrame) -> DataFrame:
    """Chunks with chunk_id from 0 in key order; chunks are few, one row each."""
    return plan.withColumn("chunk_id", F.row_number().over(Window.orderBy(*KEY)) - 1)


def planned_and_actual(plan: DataFrame, routed: DataFrame) -> DataFrame:
    """level, x, y, z, estimate, n, difference of every planned chunk and every chunk that points were routed to."""
    n = routed.groupBy(F.col("chunk_level").alias("level"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z")).agg(F.count("*").alias("n"))
    both = plan.join(n, KEY, "full").na.fill(0, ["estimate", "n"])
    return both.select(*KEY, "estimate", "n", (F.col("n") - F.col("estimate")).alias("difference"))
