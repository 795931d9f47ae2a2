"""Leaves of the octree: the shallowest cells that hold at most a leaf's worth of points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.frame import Frame
from stratacloud.functions.keys import ancestor, point_key
from stratacloud.functions.sizing import MAX_LEAF_POINTS
from stratacloud.lineage import materialized
from stratacloud.operators.counting import KEY, grid_counts, level_totals
from stratacloud.operators.joins import BROADCAST_CELLS, cell_join

DEPTH_CAP = 20
#: Points are counted first at a depth of at most FIRST_DEPTH; cells still too full are counted STEP levels deeper.
FIRST_DEPTH, STEP = 8, 3


def count_depths(total: int, max_leaf: int, cap: int) -> list[int]:
    """Depths at which points are counted, one after the other as far as needed.

    The first is a level below where points spread over a surface would fill their leaves.
    """
    first = 1
    while 4 ** (first - 1) * max_leaf < total and first < FIRST_DEPTH:
        first += 1
    first = min(first, cap)
    return [*range(first, cap, STEP), cap]


def _leaf_levels(cells: DataFrame, depth: int, max_leaf: int) -> DataFrame:
    """x, y, z, n, leaf_level: one more than the number of too full ancestors, counted over finest cells.

    Too full cells above the finest level are at most n / max_leaf at each level, so the
    join's right side stays small next to the cells.
    """
    full = level_totals(cells, depth).where((F.col("n") > max_leaf) & (F.col("level") < depth))
    full = full.select("level", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    levels = cells.select("x", "y", "z", F.explode(F.sequence(F.lit(0), F.lit(max(0, depth - 1)))).alias("level"))
    up = [ancestor(F.col(a), F.lit(depth), F.col("level")).alias(f"a{a}") for a in "xyz"]
    inside = levels.select("x", "y", "z", "level", *up).join(full, ["level", "ax", "ay", "az"], "left_semi")
    counted = inside.groupBy("x", "y", "z").agg(F.count("*").cast("int").alias("above"))
    return cells.join(counted, ["x", "y", "z"], "left").select("x", "y", "z", "n", F.coalesce("above", F.lit(0)).alias("leaf_level"))


def leaf_cells(points: DataFrame, frame: Frame, max_leaf: int = MAX_LEAF_POINTS, cap: int = DEPTH_CAP) -> DataFrame:
    """depth, x, y, z, n, leaf_level: cells at `depth` and the level of the leaf that holds them.

    The first pass counts at most 8**8 cells however many points there are.  Cells still too
    full go on with only their own points, a few levels at a time.
    """
    out, rest = None, points
    for depth in count_depths(points.count(), max_leaf, cap):
        cells = materialized(_leaf_levels(grid_counts(rest, frame, depth), depth, max_leaf), "cells")
        open_ = cells.where((F.col("leaf_level") == depth) & (F.col("n") > max_leaf)) if depth < cap else None
        more = open_ is not None and not open_.isEmpty()
        done = cells.join(open_.select("x", "y", "z"), ["x", "y", "z"], "left_anti") if more else cells
        done = done.select(F.lit(depth).alias("depth"), "x", "y", "z", "n", "leaf_level")
        out = done if out is None else out.unionByName(done)
        if not more:
            break
        keys = [k.alias(f"_{a}") for a, k in zip("xyz", point_key(frame, depth))]
        hot = open_.select(*[F.col(a).alias(f"_{a}") for a in "xyz"])
        rest = rest.select("*", *keys).join(hot, ["_x", "_y", "_z"], "left_semi").select(*points.columns)
    return out


def leaf_nodes(cells: DataFrame) -> DataFrame:
    """level, x, y, z, n of the leaves, from leaf_cells()."""
    up = [ancestor(F.col(a), F.col("depth"), F.col("leaf_level")).alias(a) for a in "xyz"]
    return cells.select(F.col("leaf_level").alias("level"), *up, "n").groupBy(*KEY).agg(F.sum("n").alias("n"))


def assign_leaves(points: DataFrame, frame: Frame, max_leaf: int = MAX_LEAF_POINTS, cap: int = DEPTH_CAP) -> DataFrame:
    """points with level, kx, ky, kz of their leaf.

    The key at the deepest counted level is computed once and shifted for the others.  While
    the counted cells are few enough to be broadcast, one pass looks each point up at every depth;
    beyond that there is a join for each depth, in which no cell is hot.
    """
    cells = leaf_cells(points, frame, max_leaf, cap)
    counted = {r["depth"]: r["cells"] for r in cells.groupBy("depth").agg(F.count("*").alias("cells")).collect()} or {cap: 0}
    deepest = max(counted)
    keyed = points.select("*", *[k.alias(f"_{a}") for a, k in zip("xyz", point_key(frame, deepest))])
    place = lambda level: [F.call_function("shiftright", F.col(f"_{a}"), (F.lit(deepest) - level).cast("int")).alias(f"k{a}") for a in "xyz"]
    own = lambda depth: cells.where(F.col("depth") == depth).select(*[F.col(a).alias(f"_{a}{depth}") for a in "xyz"], F.col("leaf_level").alias(f"_level{depth}"), F.col("n").alias(f"_n{depth}"))
    at = lambda depth: [F.shiftright(f"_{a}", deepest - depth).alias(f"_{a}{depth}") for a in "xyz"]
    if sum(counted.values()) <= BROADCAST_CELLS:
        for depth in counted:
            keyed = keyed.select("*", *at(depth)).join(F.broadcast(own(depth)), [f"_{a}{depth}" for a in "xyz"], "left")
        found = keyed.withColumn("_level", F.coalesce(*[f"_level{depth}" for depth in counted]))
        return found.where("_level is not null").select(*points.columns, F.col("_level").alias("level"), *place(F.col("_level")))
    out = None
    for depth in counted:
        joined = cell_join(keyed.select("*", *at(depth)), own(depth), [f"_{a}{depth}" for a in "xyz"], f"_n{depth}")
        found = joined.select(*points.columns, F.col(f"_level{depth}").alias("level"), *place(F.col(f"_level{depth}")))
        out = found if out is None else out.unionByName(found)
    return out


def level_summary(nodes: DataFrame) -> DataFrame:
    """level, nodes, points and the fullest node of each level."""
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum("n").alias("points"), F.max("n").alias("max_points"))
