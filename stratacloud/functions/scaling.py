"""Conversion between world coordinates and scaled 32-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def round_away(x: Column) -> Column:
    """Nearest whole double, halves away from zero, exact for every double below 2**52 in size.

    F.round goes through BigDecimal for every row; floor and one comparison stay in generated code.
    """
    size = F.abs(x)
    whole = F.floor(size).cast("double")
    return F.signum(x) * F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole)


def saturate(x: Column, low: int = INT_MIN, high: int = INT_MAX) -> Column:
    """Double to integer as a saturating cast: NaN gives 0, values beyond the range its ends."""
    safe = F.when(F.isnan(x), F.lit(0.0)).otherwise(F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
    return safe.cast("int" if high <= INT_MAX else "long")


def quantize(world: Column, scale: float, offset: float = 0.0) -> Column:
    steps = (world - F.lit(float(offset))) / F.lit(float(scale))
    bounded = F.when(F.isnan(steps), F.lit(0.0)).otherwise(F.least(F.greatest(steps, F.lit(-3e9)), F.lit(3e9)))
    return saturate(round_away(bounded))


def dequantize(steps: Column, scale: float, offset: float = 0.0) -> Column:
    return steps.cast("double") * F.lit(float(scale)) + F.lit(float(offset))


def snap(world: Column, scale: float, offset: float = 0.0) -> Column:
    """World coordinate as stored: the nearest grid position."""
    return dequantize(quantize(world, scale, offset), scale, offset)
