"""Counting points in cells: the grid that planning works on, and its totals at coarser levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.frame import Frame
from stratacloud.functions.keys import ancestor, point_key

KEY = ["level", "x", "y", "z"]


def world() -> tuple[Column, Column, Column]:
    return F.col("wx"), F.col("wy"), F.col("wz")


def grid_counts(points: DataFrame, frame: Frame, depth: int) -> DataFrame:
    """x, y, z, n of the cells at `depth` that hold points; counts combine before the shuffle."""
    keys = [k.alias(a) for a, k in zip("xyz", point_key(frame, depth))]
    return points.select(*keys).groupBy("x", "y", "z").agg(F.count("*").alias("n"))


def level_totals(cells: DataFrame, depth: int) -> DataFrame:
    """level, x, y, z, n for every level from 0 to `depth`, from the counts of the finest cells."""
    levels = cells.select("x", "y", "z", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    up = [ancestor(F.col(a), F.lit(depth), F.col("level")).alias(a) for a in "xyz"]
    return levels.select("level", *up, "n").groupBy(*KEY).agg(F.sum("n").alias("n"))
