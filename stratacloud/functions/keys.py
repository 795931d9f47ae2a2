"""Octree keys: cells by bisection, ancestors, children, Morton codes, sampling cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: The LOD sampling grid has so many cells along an axis of the parent.
GRID_CELLS = 128


def _bisect(value: str, low: float, high: float, depth: int) -> str:
    """Cell index after `depth` halvings at low + (high - low) / 2; a value on the plane goes up."""
    mid = "(s.a + (s.b - s.a) / 2.0D)"
    step = f"named_struct('a', if({value} >= {mid}, {mid}, s.a), 'b', if({value} >= {mid}, s.b, {mid}), 'k', s.k * 2 + cast({value} >= {mid} as int))"
    return f"aggregate(sequence(1, {depth}), named_struct('a', {low!r}D, 'b', {high!r}D, 'k', 0), (s, i) -> {step}, s -> s.k)"


def cell_index(value: str, center: float, half: float, depth: int) -> Column:
    """Index of the cell of an axis at `depth` for the column named `value`, equal to bisection bit for bit.

    The position (value - low) / side decides alone wherever it is farther from a cell
    border than the rounding of all halvings together; only values nearer than that, about
    one in millions, are bisected.  The bisection is a higher-order function, so the projection
    is compiled by itself and not with its neighbours.  Expressions are SQL text, which is
    parsed in one step however large it is.
    """
    if depth == 0:
        return F.lit(0)
    low, high = float(center - half), float(center + half)
    side = (high - low) / 2**depth
    # every mid is off by at most an ulp of the largest bound, and so is the position
    margin = 4.0 * (depth + 2) * 2.0**-52 * max(abs(low), abs(high), high - low) / side if side > 0 else 1.0
    exact = _bisect(value, low, high, depth)
    if margin >= 0.25:
        return F.expr(exact)
    position = f"(({value} - {low!r}D) / {side!r}D)"
    cell = f"cast(floor(least(greatest({position}, 0.0D), {float(2**depth - 1)!r}D)) as int)"
    return F.expr(f"case when abs({position} - cast(floor({position} + 0.5D) as double)) <= {margin!r}D then {exact} else {cell} end")


def point_key(frame, depth: int, world: tuple[str, str, str] = ("wx", "wy", "wz")) -> list[Column]:
    """Columns kx, ky, kz of the cell at `depth` that holds a world position, given by the names of its columns."""
    return [cell_index(w, c, frame.half, depth).alias(f"k{a}") for a, w, c in zip(AXES, world, frame.center)]


def ancestor(k: Column, level: int | Column, to: int | Column) -> Column:
    """Coordinate of the ancestor at level `to` of a cell at `level`."""
    if isinstance(level, int) and isinstance(to, int):
        return F.shiftright(k, level - to)
    by = (level if isinstance(level, Column) else F.lit(level)) - (to if isinstance(to, Column) else F.lit(to))
    return F.call_function("shiftright", k, by.cast("int"))


def parent(k: Column) -> Column:
    return F.shiftright(k, 1)


def children(level: Column, x: Column, y: Column, z: Column) -> Column:
    """The eight child keys, octants counted x first."""
    child = lambda o: F.struct(
        (level + 1).alias("level"),
        (x * 2 + o.bitwiseAND(1)).alias("x"),
        (y * 2 + F.shiftright(o, 1).bitwiseAND(1)).alias("y"),
        (z * 2 + F.shiftright(o, 2)).alias("z"),
    )
    return F.transform(F.sequence(F.lit(0), F.lit(7)), child)


def octant(x: Column, y: Column, z: Column) -> Column:
    return x.bitwiseAND(1) + y.bitwiseAND(1) * 2 + z.bitwiseAND(1) * 4


#: Seven bits spread over every third bit, for each of the 128 values of seven bits.
SPREAD = [sum((v >> bit & 1) << (3 * bit) for bit in range(7)) for v in range(128)]


def _spread(v: Column) -> Column:
    """The low 21 bits over every third bit of 63, seven at a time by a table."""
    v, table = v.cast("long"), F.expr(f"array({', '.join(f'{s}L' for s in SPREAD)})")
    part = lambda by: F.shiftleft(F.get(table, F.shiftright(v, by).bitwiseAND(127).cast("int")), 3 * by)
    return part(0).bitwiseOR(part(7)).bitwiseOR(part(14))


def morton(x: Column, y: Column, z: Column) -> Column:
    """63-bit Morton code of the low 21 bits of three non-negative numbers."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)).bitwiseOR(F.shiftleft(_spread(z), 2))


def grid_origin(cell: Column, center: float, half: float, side: Column, scale: float, offset: float) -> Column:
    """Integer coordinate of a parent cell's lower border."""
    from stratacloud.functions.scaling import round_away

    return round_away((F.lit(center - half) + cell.cast("double") * side - F.lit(offset)) / F.lit(scale)).cast("long")


def grid_cell(offset: Column, size: Column, cells: int = GRID_CELLS) -> Column:
    """Cell of the sampling grid along an axis, for an offset from the parent's border in integer units."""
    at = F.call_function("div", F.greatest(offset, F.lit(0)).cast("long") * cells, size.cast("long"))
    return F.least(F.greatest(at, F.lit(0)), F.lit(cells - 1)).cast("int")


def linear_cell(x: Column, y: Column, z: Column, cells: int) -> Column:
    return x + y * cells + z * (cells * cells)


def sub_octant(x: Column, y: Column, z: Column, bits: int) -> Column:
    """Local index of a cell within its ancestor `bits` levels up: low bits, x fastest."""
    mask = (1 << bits) - 1
    return x.bitwiseAND(mask) + y.bitwiseAND(mask) * (1 << bits) + z.bitwiseAND(mask) * (1 << (2 * bits))


def sub_chunk(deep: Column, cell: Column, bits: int) -> Column:
    """Position of a deeper cell within a coarser one, clamped to it."""
    return F.least(F.greatest(deep - cell * (1 << bits), F.lit(0)), F.lit((1 << bits) - 1))
