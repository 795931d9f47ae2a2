"""Coordinate frame of an octree: integer scale and offset, and the cube that holds all points."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.functions.scaling import dequantize, quantize

#: Largest step count that is planned for; leaves room for padding below the 32-bit limit.
MOST_STEPS = 2_147_400_000.0
#: A cube is refitted if the points need less than this part of it.
REFIT_PART = 0.9


@dataclass(frozen=True)
class Frame:
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    center: tuple[float, float, float]
    half: float

    def quantized(self, world: tuple[Column, Column, Column]) -> list[Column]:
        return [quantize(w, s, o).alias(a) for a, w, s, o in zip("xyz", world, self.scale, self.offset)]

    def world(self, steps: tuple[Column, Column, Column]) -> list[Column]:
        return [dequantize(v, s, o).alias(f"w{a}") for a, v, s, o in zip("xyz", steps, self.scale, self.offset)]

    def side(self, level: int) -> float:
        return 2.0 * self.half / 2**level


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def bounds(points: DataFrame) -> DataFrame:
    """One row: n and the least and largest wx, wy, wz; NaN is ignored, an empty table gives nulls and 0."""
    columns = [f(no_nan(F.col(f"w{a}"))).alias(f"{name}_{a}") for a in "xyz" for name, f in (("min", F.min), ("max", F.max))]
    return points.agg(F.count("*").alias("n"), *columns)


def fit_axis(scale: float, offset: float, low: float, high: float) -> tuple[float, float]:
    """Scale and offset with which low and high fit the integer range: recentred first, then coarser."""

    def fits() -> bool:
        return max(abs((low - offset) / scale), abs((high - offset) / scale)) <= MOST_STEPS

    if not fits():
        offset = 0.5 * (low + high)
    while not fits():
        scale *= 2.0
    return scale, offset


def cube(low: tuple, high: tuple, scale: tuple) -> tuple[tuple[float, float, float], float]:
    """Centre and half side of the cube, its lower corner one padded step below the data."""
    pad = max(scale)
    half = (max(h - l for l, h in zip(low, high)) / 2.0 + pad) * 1.0001
    return tuple(l - pad + half for l in low), half


def fit_frame(low: tuple, high: tuple, scale: tuple, offset: tuple) -> Frame:
    fitted = [fit_axis(*x) for x in zip(scale, offset, low, high)]
    scale, offset = tuple(f[0] for f in fitted), tuple(f[1] for f in fitted)
    center, half = cube(low, high, scale)
    return Frame(scale, offset, center, half)


def frame_of(points: DataFrame, scale: tuple = (0.01, 0.01, 0.01), offset: tuple = (0.0, 0.0, 0.0), pad: float | None = None) -> Frame:
    """Frame of a table of world positions: one aggregate, one row to the driver.

    The cube is padded by `pad`, by default the largest step of the fitted scale, which grows with wide data.
    """
    row = bounds(points).first()
    if not row["n"] or row["min_x"] is None or row["min_y"] is None or row["min_z"] is None:
        return Frame(scale, offset, (0.0, 0.0, 0.0), max(scale))
    low, high = (tuple(row[f"{n}_{a}"] for a in "xyz") for n in ("min", "max"))
    frame = fit_frame(low, high, scale, offset)
    if pad is None:
        return frame
    center, half = cube(low, high, (pad,))
    return replace(frame, center=center, half=half)


def needs_refit(frame: Frame, low: tuple, high: tuple) -> bool:
    outside = any(l < c - frame.half or h > c + frame.half for l, h, c in zip(low, high, frame.center))
    coarse = any(abs((v - o) / s) > MOST_STEPS for l, h, o, s in zip(low, high, frame.offset, frame.scale) for v in (l, h))
    return outside or coarse or cube(low, high, frame.scale)[1] < REFIT_PART * frame.half
