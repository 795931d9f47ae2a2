"""Levels of detail: each parent takes the first point of every sampling cell from its children."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratacloud.frame import Frame
from stratacloud.functions.keys import GRID_CELLS, grid_cell, grid_origin, linear_cell, morton, octant
from stratacloud.functions.scaling import round_away
from stratacloud.lineage import materialized

NODE = ["level", "kx", "ky", "kz"]


def sample_cells(points: DataFrame, frame: Frame, cells: int = GRID_CELLS) -> DataFrame:
    """points(x, y, z, px, py, pz, plevel) with the sampling cell and Morton code in their parent.

    The parent's border and side are in integer units; the side is that of the finest
    scale and at least one unit for each cell.
    """
    side = F.lit(2.0 * frame.half) / F.pow(F.lit(2.0), F.col("plevel").cast("double"))
    size = F.greatest(round_away(side / F.lit(min(frame.scale))), F.lit(float(cells))).cast("long")
    off = {a: F.col(a).cast("long") - grid_origin(F.col(f"p{a}"), c, frame.half, side, s, o) for a, c, s, o in zip("xyz", frame.center, frame.scale, frame.offset)}
    at = [grid_cell(off[a], size, cells) for a in "xyz"]
    return points.withColumns({"cell": linear_cell(*at, cells), "code": morton(*[F.greatest(off[a], F.lit(0)) for a in "xyz"])})


def _sampled(active: DataFrame, frame: Frame, level: int, cells: int, id_col: str) -> DataFrame:
    """id, px, py, pz, cell, place of points in nodes at `level` + 1: sample_cells() for one level, whose side is a number."""
    side = 2.0 * frame.half / 2.0**level
    steps = side / min(frame.scale)
    size = int(max(float(int(steps)) + (steps - int(steps) >= 0.5), float(cells)))
    axes = list(zip("xyz", frame.center, frame.scale, frame.offset))
    low = [f"({float(c - frame.half)!r}D + cast(shiftright(k{a}, 1) as double) * {side!r}D - {float(o)!r}D) / {float(s)!r}D as b{a}" for a, c, s, o in axes]
    border = lambda b: f"cast(signum({b}) * if(abs({b}) - floor(abs({b})) >= 0.5D, floor(abs({b})) + 1.0D, cast(floor(abs({b})) as double)) as bigint)"
    off = [f"greatest(cast({a} as bigint) - {border(f'b{a}')}, 0L) as o{a}" for a in "xyz"]
    at = {a: f"least(o{a} * {cells}L div {size}L, {cells - 1}L)" for a in "xyz"}
    cell = f"cast({at['x']} + {at['y']} * {cells} + {at['z']} * {cells * cells} as int)"
    placed = active.selectExpr(id_col, "kx", "ky", "kz", "x", "y", "z", *low).selectExpr(id_col, "kx", "ky", "kz", *off)
    place = F.struct(octant(F.col("kx"), F.col("ky"), F.col("kz")).alias("octant"), morton(F.col("ox"), F.col("oy"), F.col("oz")).alias("code"), id_col)
    return placed.select(F.expr("shiftright(kx, 1) as px"), F.expr("shiftright(ky, 1) as py"), F.expr("shiftright(kz, 1) as pz"), F.expr(cell).alias("cell"), place.alias("place"))


def promote_level(active: DataFrame, frame: Frame, level: int, cells: int = GRID_CELLS, id_col: str = "point_id") -> DataFrame:
    """Points of nodes at `level` + 1 with the node of `level` for those that are promoted.

    Of each sampling cell of a parent the first point in the order (octant, Morton code, id)
    goes up.  A child that would be left empty keeps the last one that it gave.  Both choices
    are aggregates joined back on the unique id, so coincident points in one cell are
    combined before the shuffle.
    """
    first = _sampled(active, frame, level, cells, id_col).groupBy("px", "py", "pz", "cell").agg(F.min("place").alias("place"))
    child = ["px * 2 + (place.octant & 1) as kx", "py * 2 + (shiftright(place.octant, 1) & 1) as ky", "pz * 2 + shiftright(place.octant, 2) as kz"]
    chosen = first.selectExpr("place", *child)
    given = chosen.groupBy("kx", "ky", "kz").agg(F.count("*").alias("given"), F.max("place").alias("last"))
    held = active.groupBy("kx", "ky", "kz").agg(F.count("*").alias("held"))
    emptied = given.join(held, ["kx", "ky", "kz"]).where("given = held").selectExpr(f"last.{id_col} as {id_col}")
    going = chosen.selectExpr(f"place.{id_col} as {id_col}").join(emptied, id_col, "left_anti").withColumn("going", F.lit(True))
    moved = [f"if(going, shiftright({k}, 1), {k}) as {k}" for k in ("kx", "ky", "kz")]
    return active.join(going, id_col, "left").selectExpr(*[c for c in active.columns if c not in NODE], f"if(going, {level}, level) as level", *moved)


def thin(points: DataFrame, frame: Frame, max_level: int, cells: int = GRID_CELLS, id_col: str = "point_id") -> DataFrame:
    """points(level, kx, ky, kz, x, y, z, id) after all promotions, from the deepest level to the root.

    A level's points are touched once; those that stay are set aside, so each step works on
    what rises and on the leaves of that level.  Every level is written to the shared folder.
    """
    settled, rising = None, None
    for level in range(max_level - 1, -1, -1):
        own = points.where(F.col("level") == level + 1)
        active = own if rising is None else own.unionByName(rising)
        step = materialized(promote_level(active, frame, level, cells, id_col), "lod")
        stay = step.where(F.col("level") == level + 1)
        settled = stay if settled is None else settled.unionByName(stay)
        rising = step.where(F.col("level") == level)
    root = points.where("level = 0")
    if rising is not None:
        root = root.unionByName(rising)
    return root if settled is None else settled.unionByName(root)


def node_table(points: DataFrame) -> DataFrame:
    """level, x, y, z, n of every node that holds points and, with 0 points, of ancestors that hold none."""
    own = points.groupBy("level", F.col("kx").alias("x"), F.col("ky").alias("y"), F.col("kz").alias("z")).agg(F.count("*").alias("n"))
    return own.unionByName(missing_ancestors(own))


def missing_ancestors(nodes: DataFrame) -> DataFrame:
    """Ancestors of nodes(level, x, y, z, n) that aren't among them, with n = 0."""
    up = nodes.where("level > 0").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("level") - 1)))
    shift = F.col("level") - F.col("to")
    wanted = up.select(F.col("to").cast("int").alias("level"), *[F.call_function("shiftright", F.col(a), shift).alias(a) for a in "xyz"]).distinct()
    return wanted.join(nodes, ["level", "x", "y", "z"], "left_anti").withColumn("n", F.lit(0).cast("long"))
