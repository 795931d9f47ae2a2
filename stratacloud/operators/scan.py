"""Header-level tables: one row for each input file, and what they say together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.frame import no_nan

AXES = "xyz"


def file_table(points: DataFrame, file_col: str = "file_idx") -> DataFrame:
    """file_idx, point_count and bounds, as a header scan reports them, from the points themselves."""
    ends = [f(no_nan(F.col(f"w{a}"))).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(F.col(file_col).alias("file_idx")).agg(F.count("*").alias("point_count"), *ends)


def combined(files: DataFrame) -> DataFrame:
    """One row: files, points, bounds of all files that hold points, and the largest LAZ chunk."""
    holds = F.col("point_count") > 0
    ends = [f(F.when(holds, F.col(f"{name}_{a}"))).alias(f"{name}_{a}") for a in AXES for name, f in (("min", F.min), ("max", F.max))]
    chunk = [F.coalesce(F.max("max_chunk"), F.lit(0)).alias("max_chunk")] if "max_chunk" in files.columns else []
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("point_count"), F.lit(0)).alias("points"), *ends, *chunk)


def first_present(files: DataFrame, column: str) -> DataFrame:
    """One row: file_idx and value of the first file, in input order, that has the column."""
    at = files.where(F.col(column).isNotNull())
    return at.agg(F.min("file_idx").alias("file_idx"), F.min_by(column, "file_idx").alias(column))


def header_mismatch(header: DataFrame, actual: DataFrame, scale: tuple[float, float, float]) -> DataFrame:
    """bound, header, actual where they differ by more than 1.5 steps; none if no point was counted.

    Both tables have one row with min_x to max_z.
    """
    names = [f"{n}_{a}" for a in AXES for n in ("min", "max")]

    def tall(df: DataFrame, value: str) -> DataFrame:
        pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
        return df.select(F.expr(f"stack({len(names)}, {pairs}) as (bound, {value})"))

    step = F.lit(float(scale[2]))
    for i, a in enumerate(AXES[:2]):
        step = F.when(F.col("bound").endswith(a), F.lit(float(scale[i]))).otherwise(step)
    both = tall(header, "header").join(tall(actual, "actual"), "bound")
    return both.where(F.abs(F.col("header") - F.col("actual")) > 1.5 * step)
