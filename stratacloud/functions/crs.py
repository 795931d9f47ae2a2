"""EPSG codes from coordinate system texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Markers that begin the vertical part, tried in this order.
VERTICAL_MARKS = ("VERTCRS", "VERTICALCRS", "VERT_CS")
LEAST_CODE, MOST_CODE = 1024, 32766


def _split(wkt: Column) -> tuple[Column, Column]:
    horizontal, vertical = wkt, F.lit(None).cast("string")
    for mark in reversed(VERTICAL_MARKS):
        at = F.instr(wkt, mark)
        horizontal = F.when(at > 0, F.substring_index(wkt, mark, 1)).otherwise(horizontal)
        vertical = F.when(at > 0, F.substr(wkt, at + len(mark))).otherwise(vertical)
    return horizontal, vertical


def trailing_code(part: Column) -> Column:
    """Last run of digits within the last ten characters; null outside the EPSG range."""
    digits = F.regexp_extract(F.right(F.rtrim(part), F.lit(10)), r"(\d+)\D*$", 1)
    code = F.when(digits != "", digits.cast("long"))
    return F.when(code.between(LEAST_CODE, MOST_CODE), code.cast("int"))


def epsg_codes(wkt: Column) -> tuple[Column, Column]:
    """(horizontal, vertical) codes; no horizontal code means neither.

    Codes of five digits count, so that UTM zones such as 32633 are found.
    """
    first, second = _split(wkt)
    horizontal = trailing_code(first)
    return horizontal, F.when(horizontal.isNotNull(), trailing_code(second))
