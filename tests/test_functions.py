import math
import random

import pytest
from pyspark.sql import functions as F

from stratacloud.frame import Frame, cube, fit_axis, fit_frame, needs_refit
from stratacloud.functions import crs, keys, las, scaling, sizing


def bisect(v, center, half, depth):
    a, b, k = center - half, center + half, 0
    for _ in range(depth):
        mid = a + (b - a) / 2.0
        a, b, k = (mid, b, 2 * k + 1) if v >= mid else (a, mid, 2 * k)
    return k


@pytest.mark.parametrize(("center", "half"), [(0.0, 1.0), (512345.678, 731.4159), (1e7 / 3, 0.77), (-3.3, 1e5 / 7)])
def test_cells_on_and_beside_split_planes(spark, center, half):
    rng, values = random.Random(4), []
    for depth in range(1, 13):
        for _ in range(20):
            a, b = center - half, center + half
            for _ in range(depth):
                mid = a + (b - a) / 2.0
                a, b = (mid, b) if rng.random() < 0.5 else (a, mid)
            values += [a, math.nextafter(a, -math.inf), math.nextafter(a, math.inf), rng.uniform(center - half, center + half)]
    values += [center - half, center + half, center - 2 * half, center + 2 * half]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for depth in (0, 1, 7, 12, 20):
        got = [r.k for r in df.select(keys.cell_index("v", center, half, depth).alias("k")).collect()]
        assert got == [bisect(v, center, half, depth) for v in values]


def test_rounding_saturates(spark):
    x = [2.5, -2.5, 0.49999999999999994, 1e300, -1e300, math.nan, math.inf, 3e9, 7.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert [r.q for r in df.select(scaling.quantize(F.col("v"), 1.0).alias("q")).collect()] == [3, -3, 0, 2**31 - 1, -(2**31), 0, 2**31 - 1, 2**31 - 1, 7]


def test_morton_and_children(spark):
    def slow(*xyz):
        return sum(((v & 0x1FFFFF) >> i & 1) << (3 * i + a) for a, v in enumerate(xyz) for i in range(21))

    rows = [(1, 2, 3), (2**21 - 1, 0, 2**21 - 1), (2**21 + 5, 7, 1), (123456, 654321, 999999)]
    df = spark.createDataFrame(rows, "x int, y int, z int")
    assert [r.m for r in df.select(keys.morton(F.col("x"), F.col("y"), F.col("z")).alias("m")).collect()] == [slow(*r) for r in rows]
    child = spark.range(1).select(F.explode(keys.children(F.lit(1), F.lit(1), F.lit(0), F.lit(1))).alias("c")).select("c.*").collect()
    assert len({tuple(c) for c in child}) == 8 and {(c.x >> 1, c.y >> 1, c.z >> 1) for c in child} == {(1, 0, 1)}


def test_frames():
    assert fit_axis(0.01, 0.0, -5.0, 5.0) == (0.01, 0.0)
    scale, offset = fit_axis(0.01, 0.0, 1e9, 1e9 + 10)
    assert (scale, offset) == (0.01, 1e9 + 5)
    assert fit_axis(1e-9, 0.0, 0.0, 100.0)[0] > 1e-9
    center, half = cube((0, 0, 0), (10, 4, 1), (0.01, 0.01, 0.02))
    assert half == (5 + 0.02) * 1.0001 and center == (half - 0.02,) * 3
    f = fit_frame((0.0, 0.0, 0.0), (10.0, 10.0, 10.0), (0.01,) * 3, (0.0,) * 3)
    assert not needs_refit(f, (0.0,) * 3, (10.0,) * 3) and needs_refit(f, (0.0,) * 3, (5.0,) * 3) and needs_refit(f, (-1.0, 0, 0), (10.0,) * 3)
    assert isinstance(f, Frame) and f.side(1) == f.half


def test_sizes(spark):
    text = ["16Gi", "1.5T", "512m", "7", "4GB", "x", "1.2.3", ""]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    rows = df.select(sizing.parse_size(F.col("t")).alias("b"), sizing.parse_count(F.col("t")).alias("c")).collect()
    assert [r.b for r in rows] == [16 << 30, 3 << 39, 512 << 20, 7, 4 << 30, None, None, None]
    assert [r.c for r in rows][1:4] == [1_500_000_000_000, 512_000_000, 7]
    one = spark.range(1).select(sizing.human_count(F.lit(1234)), sizing.human_bytes(F.lit(3 << 20)), sizing.human_seconds(F.lit(3700)), sizing.human_seconds(F.lit(75.2))).first()
    assert tuple(one) == ("1.2K", "3.0 MiB", "1h01m40s", "1m15s")
    assert sizing.grid_size(10**8, 1 << 40) == 256 and sizing.grid_size(10**9, 1 << 34) == 512 and sizing.grid_size(10**9, 1 << 30) == 128
    assert sizing.chunk_target(24 << 30, 10, 750_000_000, 10) >= sizing.MIN_CHUNK_POINTS
    assert sizing.header_date(0) == (1, 1970) and sizing.header_date(-1) == (0, 0) and sizing.header_date(59) == (60, 1970)
    assert sizing.writer_window(0, 30) == 100_000 and sizing.workers(8, 3) == 3 and sizing.build_slots(4 << 30, 8)[0] == 3


def test_codes_of_five_digits(spark):
    wkt = 'PROJCS["x",AUTHORITY["EPSG","32633"]],VERTCRS["h",AUTHORITY["EPSG","5703"]] '
    h, v = crs.epsg_codes(F.lit(wkt))
    assert tuple(spark.range(1).select(h, v).first()) == (32633, 5703)
    names = spark.range(1).select(las.field_names(F.array(F.lit("a"), F.lit(""), F.lit("b")))).first()[0]
    assert names == "a, <unnamed>, b"


def test_sizes_beyond_32_bits_fail(spark):
    from stratacloud.operators.index import chunk_offsets

    nodes = spark.createDataFrame([(0, 0, 0, 0, 10), (1, 0, 0, 0, 2**31 // 30 + 1)], "level int, x int, y int, z int, n long")
    with pytest.raises(Exception, match="more than 2147483647"):
        chunk_offsets(nodes, 600, 30).collect()
    assert chunk_offsets(nodes.where("n = 10"), 600, 30).first()["byte_size"] == 300


def test_join_of_many_cells_has_no_hot_key(spark, monkeypatch):
    from stratacloud.operators import joins

    points = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    cells = points.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    want = sorted(map(tuple, joins.cell_join(points, cells, ["k"], "n").collect()))
    monkeypatch.setattr(joins, "BROADCAST_CELLS", 0)
    monkeypatch.setattr(joins, "HOT_CELLS", 4)
    assert sorted(map(tuple, joins.cell_join(points, cells, ["k"], "n").collect())) == want and len(want) == 3000
