"""Looking points up in tables of cells, by broadcast up to a checked size and without hot keys beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tables of at most so many cells, about 40 bytes each, are broadcast.
BROADCAST_CELLS = 1 << 20
#: Cells with more than this part of all points are fewer than its inverse.
HOT_CELLS = 4096


def cell_join(points: DataFrame, cells: DataFrame, keys: list[str], size: str) -> DataFrame:
    """points joined with cells(keys, size, ...), a row for each cell and `size` its points; cells should be a written table.

    A small table is broadcast, so that points stay where they are.  Of a larger one only the
    cells that hold more than a part of all points are, and no task gets all points of one.
    """
    row = cells.agg(F.count("*").alias("cells"), F.sum(size).alias("points")).first()
    if row["cells"] <= BROADCAST_CELLS:
        return points.join(F.broadcast(cells), keys)
    hot = F.col(size) > row["points"] // HOT_CELLS
    few = F.broadcast(cells.where(hot))
    rest = points.join(F.broadcast(cells.where(hot).select(*keys)), keys, "left_anti")
    return points.join(few, keys).unionByName(rest.join(cells.where(~hot), keys))
