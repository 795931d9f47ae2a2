"""The conversion of point files to an octree, stage by stage.

Each stage is a class that offers only the next step: Scanned.validate(), Validated.plan(),
Planned.build(), Built.write().  Rows come to the driver for the frame, the deepest level, the
report of the commit, the fields of the Extra Bytes record, and one for each file with a warning.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud import errors
from stratacloud.frame import Frame, bounds, fit_frame, needs_refit, no_nan
from stratacloud.functions import sizing
from stratacloud.functions.las import BASE_LENGTH, output_format
from stratacloud.functions.keys import GRID_CELLS
from stratacloud.lineage import materialized
from stratacloud.operators import counting, index, leaves, lod, planning, scan, validate
from stratacloud.plans.observer import Observer, Silent, Timed
from stratacloud.sources import las, layout

_ERRORS = {"crs": errors.CrsMismatch, "point_format": errors.FormatMismatch, "extra_bytes": errors.ExtraBytesMismatch, "gps_time": errors.GpsTimeMismatch}


@dataclass(frozen=True)
class Config:
    budget: int = 12 << 30
    max_leaf: int = sizing.MAX_LEAF_POINTS
    depth_cap: int = leaves.DEPTH_CAP
    grid_cells: int = GRID_CELLS
    temporal_stride: int | None = None
    observer: Observer = field(default_factory=Silent)


def scan_files(spark: SparkSession, path: str, config: Config = Config()) -> Scanned:
    las.register(spark)
    with Timed(config.observer, "scan"):
        files = materialized(spark.read.format("las_header").load(path), "files")
    return Scanned(spark, path, files, config)


@dataclass(frozen=True)
class Scanned:
    spark: SparkSession
    path: str
    files: DataFrame
    config: Config

    def validate(self) -> Validated:
        with Timed(self.config.observer, "validate"):
            checked = self.files.withColumn("schema_id", validate.schema_id(F.col("extra_bytes")))
            found = materialized(validate.mismatches(checked), "mismatches")
            row = found.where(F.col("reason").isin(*_ERRORS)).orderBy("file_idx", "reason").first()
            if row:
                raise _ERRORS[row["reason"]](f"file {row['file_idx']} differs from its reference in {row['reason']}")
            first = self.files.orderBy("file_idx").first()
            if self.config.temporal_stride is not None and (problem := validate.temporal_problem(first["point_format"], self.config.temporal_stride)):
                raise errors.TemporalIndexError(problem)
            warnings = [r["file_idx"] for r in found.where("reason = 'vertical_only'").orderBy("file_idx").collect()]
        return Validated(self.spark, self.path, self.files, self.config, tuple(warnings))


@dataclass(frozen=True)
class Validated:
    spark: SparkSession
    path: str
    files: DataFrame
    config: Config
    vertical_only: tuple[int, ...]

    def plan(self) -> Planned:
        """Counts points in a frame from the headers, and again in a refitted one if the headers were wrong."""
        with Timed(self.config.observer, "plan"):
            first, whole = self.files.orderBy("file_idx").first(), scan.combined(self.files).first()
            scale, offset = tuple(first[f"scale_{a}"] for a in "xyz"), tuple(first[f"offset_{a}"] for a in "xyz")
            points = self.spark.read.format("las").load(self.path)
            low, high = (tuple(whole[f"{n}_{a}"] or 0.0 for a in "xyz") for n in ("min", "max"))
            frame = fit_frame(low, high, scale, offset)
            actual_table = bounds(points)
            actual = actual_table.first()
            header = self.spark.createDataFrame([tuple(v for p in zip(low, high) for v in p)], ", ".join(f"{n}_{a} double" for a in "xyz" for n in ("min", "max")))
            wrong = [r["bound"] for r in scan.header_mismatch(header, actual_table, scale).collect()] if actual["n"] else []
            low, high = (tuple(actual[f"{n}_{a}"] if actual[f"{n}_{a}"] is not None else 0.0 for a in "xyz") for n in ("min", "max"))
            if actual["n"] and needs_refit(frame, low, high):
                frame = fit_frame(low, high, scale, offset)
            grid = sizing.grid_size(actual["n"], self.config.budget)
            depth = grid.bit_length() - 1
            cells = materialized(counting.grid_counts(points, frame, depth), "cells")
            cores = self.spark.sparkContext.defaultParallelism
            target = sizing.chunk_target(self.config.budget, cores, actual["n"], cores)
            chunks = materialized(planning.numbered(planning.chunk_plan(cells, depth, target)), "chunks")
        return Planned(self.spark, points, frame, chunks, target, tuple(wrong), first["point_format"], self.config, actual["n"], self.files)


@dataclass(frozen=True)
class Planned:
    spark: SparkSession
    points: DataFrame
    frame: Frame
    chunks: DataFrame
    target: int
    wrong_bounds: tuple[str, ...]
    point_format: int
    config: Config
    total: int
    files: DataFrame

    def build(self) -> Built:
        with Timed(self.config.observer, "build"):
            named = self.points.withColumn("point_id", F.shiftleft(F.col("file_idx").cast("long"), 40) + F.col("record"))
            placed = leaves.assign_leaves(named, self.frame, self.config.max_leaf, self.config.depth_cap)
            placed = materialized(placed.select("*", *self.frame.quantized(counting.world())), "leaves")
            deepest = placed.agg(F.max("level")).first()[0] or 0
        with Timed(self.config.observer, "thin"):
            narrow = lod.thin(placed.select("point_id", "level", "kx", "ky", "kz", "x", "y", "z"), self.frame, deepest, self.config.grid_cells)
            points = placed.drop("level", "kx", "ky", "kz").join(narrow.select("point_id", "level", "kx", "ky", "kz"), "point_id")
            points = materialized(points, "thinned")
            nodes = materialized(lod.node_table(points), "nodes")
        return Built(self.spark, points, nodes, self)


@dataclass(frozen=True)
class Built:
    spark: SparkSession
    points: DataFrame
    nodes: DataFrame
    planned: Planned

    def write(self, path: str) -> dict[str, str]:
        """Tables below path: points by level, sorted by node and GPS time; nodes, hierarchy pages, info, temporal samples and pages.

        Info is one row: frame, counts, points by return number 1 to 15, coordinate system, and the Extra
        Bytes record with the ranges of all files, by which the column extras of the points is read.
        Returns the folders by name.
        """
        config = self.planned.config
        with Timed(config.observer, "write"):
            out = {name: f"{path}/{name}" for name in ("points", "hierarchy", "pages", "info")}
            index.gps_order(self.points).write.mode("overwrite").partitionBy("level").parquet(out["points"])
            fmt = self.spark.range(1).select(output_format(F.lit(self.planned.point_format)).alias("f")).first()["f"]
            record = BASE_LENGTH[fmt]
            index.chunk_offsets(self.nodes, 589, record).write.mode("overwrite").parquet(out["hierarchy"])
            deepest = self.nodes.agg(F.max("level")).first()[0] or 0
            index.hierarchy_pages(self.nodes, deepest).write.mode("overwrite").parquet(out["pages"])
            f = self.planned.frame
            time, returns = no_nan(F.col("gps_time")), F.array(*[F.count_if(F.col("return_number") == r) for r in range(1, 16)])
            info = self.points.agg(F.count("*").alias("points"), F.coalesce(F.min(time), F.lit(0.0)).alias("gps_min"), F.coalesce(F.max(time), F.lit(0.0)).alias("gps_max"), returns.alias("returns"))
            info = info.select("*", *[F.lit(c).alias(f"center_{a}") for a, c in zip("xyz", f.center)], F.lit(f.half).alias("half"), F.lit(2 * f.half / config.grid_cells).alias("spacing"), F.lit(fmt).alias("point_format"))
            info = info.join(F.broadcast(self._inherited()), F.lit(True))  # a row each
            info.write.mode("overwrite").parquet(out["info"])
            if config.temporal_stride is not None:
                out |= {name: f"{path}/{name}" for name in ("temporal", "temporal_pages")}
                entries = index.temporal_entries(index.temporal_samples(self.points, config.temporal_stride))
                entries.write.mode("overwrite").parquet(out["temporal"])
                index.temporal_pages(self.spark.read.parquet(out["temporal"]), deepest).write.mode("overwrite").parquet(out["temporal_pages"])
        return out

    def _inherited(self) -> DataFrame:
        """The row of validate.canonical with the ranges of all files in extra_bytes."""
        found = validate.canonical(self.planned.files)
        record = found.first()["extra_bytes"]
        if not record:
            return found
        # three rows for each field of one record
        merged = {r["place"]: (r["low"], r["high"], r["has_no_data"]) for r in validate.merged_stats(validate.extra_stats(self.planned.files)).collect()}
        return found.withColumn("extra_bytes", F.lit(layout.with_extra_stats(bytes(record), merged)))


def convert(spark: SparkSession, source: str, target: str, config: Config = Config()) -> dict[str, str]:
    """All stages: files below source to tables below target."""
    return scan_files(spark, source, config).validate().plan().build().write(target)


def with_budget(config: Config, limit: int) -> Config:
    """Config that plans with three quarters of a memory limit."""
    return replace(config, budget=limit * 3 // 4)
