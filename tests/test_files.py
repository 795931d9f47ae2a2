import struct
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacloud import errors
from stratacloud.operators import index, leaves, lod, quality, scan, validate
from stratacloud.plans import observer, pipeline
from stratacloud.sources import bytes as by
from stratacloud.sources import copc, las, layout

WKT = 'PROJCS["x",AUTHORITY["EPSG","3006"]]'


@pytest.fixture(scope="module")
def tile(spark, tmp_path_factory):
    las.register(spark)
    folder = tmp_path_factory.mktemp("tiles")
    i = F.col("id")
    points = spark.range(6000, numPartitions=3).select(
        (F.lit(1000.0) + (i % 250) * 0.4).alias("wx"), (F.lit(2000.0) + F.floor(i / 250) * 0.5).alias("wy"), (i % 7).cast("double").alias("wz"), i.cast("double").alias("gps_time"),
        (i % 4 + 1).cast("short").alias("return_number"), F.lit(4).cast("short").alias("number_of_returns"), (i % 12).cast("short").alias("classification"), (i % 256).cast("short").alias("flags"),
        i.cast("int").alias("red"), F.expr("cast(substr(cast(id as string), 1, 3) as binary)").alias("extras"),
    )
    for n in range(2):
        points.where(i % 2 == n).write.format("las").mode("append").option("path", str(folder / f"t{n}.las")).option("wkt", WKT).option("extraBytes", 3).save()
    (folder / "note.txt").write_text("x")
    return folder


def test_write_and_read(spark, tile):
    files = spark.read.format("las_header").load(str(tile)).orderBy("file_idx").collect()
    assert [f.point_count for f in files] == [3000, 3000]
    assert files[0].wkt == WKT and files[0].extra_width == 3 and files[0].point_format == 7 and files[0].gps_standard
    assert (files[0].min_x, files[1].max_z) == (1000.0, 6.0)
    points = spark.read.format("las").option("splitPoints", "700").load(str(tile))
    assert points.rdd.getNumPartitions() == 10
    rows = {int(r.gps_time): r for r in points.collect()}
    assert len(rows) == 6000
    for i in (0, 1, 2999, 5999):
        r = rows[i]
        assert (round(r.wx, 2), round(r.wy, 2), r.wz) == (round(1000 + i % 250 * 0.4, 2), 2000 + i // 250 * 0.5, i % 7)
        assert (r.return_number, r.number_of_returns, r.classification, r.flags, r.red, r.nir) == (i % 4 + 1, 4, i % 12, i % 256, i, 0)
        assert bytes(r.extras) == str(i)[:3].encode().ljust(3, b"\0")
    with pytest.raises(errors.NoInputFiles):
        las.collect_input_files(str(tile.parent))


def test_folder_of_tiles(spark, tile, tmp_path):
    points = spark.read.format("las").load(str(tile))
    for name, rows in (("all", points.repartition(4, "gps_time")), ("gaps", points.where("file_idx = 0")), ("none", points.where("file_idx > 9"))):
        folder = tmp_path / name
        rows.write.format("las").mode("append").option("path", str(folder)).option("wkt", WKT).option("extraBytes", 3).save()
        assert all(p.name.endswith(".las") for p in folder.iterdir())
        back = spark.read.format("las").load(str(folder))
        own = ["wx", "wy", "wz", "gps_time", "return_number", "classification", "flags", "red", "extras"]
        assert sorted(map(tuple, back.select(*own).collect())) == sorted(map(tuple, rows.select(*own).collect()))
        files = spark.read.format("las_header").load(str(folder))
        held = back.groupBy("file_idx").agg(F.count("*").alias("n"), F.min("wx").alias("low"), F.max("wz").alias("high"))
        wrong = held.join(files, "file_idx").where("n <> point_count or abs(low - min_x) > 1e-9 or abs(high - max_z) > 1e-9 or wkt is null")
        assert wrong.count() == 0 and files.count() == {"all": 4, "gaps": 1, "none": 1}[name]


def test_convert_checks_and_invariance(spark, tile, tmp_path):
    lines = []
    watcher = type("Watcher", (), {"event": lambda self, *a, **k: lines.append(a)})()
    config = pipeline.Config(max_leaf=300, grid_cells=8, temporal_stride=10, observer=watcher)
    planned = pipeline.scan_files(spark, str(tile), config).validate().plan()
    assert planned.total == 6000 and planned.wrong_bounds == ()
    built = planned.build()
    out = built.write(str(tmp_path / "out"))
    checks = quality.node_checks(built.nodes, 6000).unionByName(quality.point_checks(built.points, planned.frame)).collect()
    assert len(checks) == 7 and not any(c.broken for c in checks)
    entries = spark.read.parquet(out["hierarchy"])
    assert quality.contiguous_chunks(entries).first().broken == 0
    assert spark.read.parquet(out["points"]).count() == 6000
    assert spark.read.parquet(out["temporal"]).count() == entries.where("point_count > 0").count()
    assert [s for s, what in lines if what == "done"] == list(observer.STAGES)
    # leaves do not depend on the memory that is planned with
    other = pipeline.scan_files(spark, str(tile), pipeline.with_budget(config, 1 << 20)).validate().plan()
    keys = ["record", "file_idx", "level", "kx", "ky", "kz"]
    a, b = (leaves.assign_leaves(p.points, p.frame, 300).select(*keys) for p in (planned, other))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_mutations_are_found(spark):
    nodes = spark.createDataFrame([(0, 0, 0, 0, 5), (1, 0, 0, 0, 3), (1, 2, 0, 0, 1), (2, 3, 3, 3, 1), (1, 0, 0, 0, 3)], "level int, x int, y int, z int, n long")
    broken = {r.rule: r.broken for r in quality.node_checks(nodes, 10).collect()}
    assert broken == {"unique keys": 1, "key within its level": 1, "ancestors present": 2, "interior nodes hold points": 0, "root present": 0, "points conserved": 1}
    entries = spark.createDataFrame([(600, 10, 1), (611, 5, 1), (0, 0, 0), (7, 0, 0)], "offset long, byte_size long, point_count long")
    assert quality.contiguous_chunks(entries).first().broken == 2


def test_coincident_points_stop_at_the_cap(spark):
    p = spark.range(500).select(F.col("id").alias("point_id"), F.lit(100.0).alias("wx"), F.lit(200.0).alias("wy"), F.lit(5.0).alias("wz"))
    from stratacloud.frame import frame_of

    f = frame_of(p)
    placed = leaves.assign_leaves(p, f, 100, 4)
    assert placed.select("level").distinct().collect()[0].level == 4 and placed.count() == 500
    thin = lod.thin(placed.select("point_id", "level", "kx", "ky", "kz", *f.quantized((F.col("wx"), F.col("wy"), F.col("wz")))), f, 4, 8)
    assert thin.count() == 500
    assert lod.node_table(thin).agg(F.sum("n")).first()[0] == 500
    assert frame_of(p.limit(0)).half > 0


def test_validation_errors(spark, tile, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.las").write_bytes((tile / "t0.las").read_bytes())
    df = spark.range(5).select(F.col("id").cast("double").alias("wx"), F.col("id").cast("double").alias("wy"), F.lit(0.0).alias("wz"))
    df.write.format("las").mode("append").option("path", str(folder / "b.las")).option("wkt", WKT.replace("3006", "3007")).save()
    with pytest.raises(errors.CrsMismatch):
        pipeline.scan_files(spark, str(folder)).validate()
    assert validate.temporal_problem(7, 0) and validate.temporal_problem(2, 5) and not validate.temporal_problem(7, 5)
    laz = bytearray((tile / "t0.las").read_bytes())
    laz[104] |= 0x80
    (tmp_path / "c.laz").write_bytes(laz)
    with pytest.raises(Exception, match="codec"):
        spark.read.format("las").load(str(tmp_path / "c.laz")).count()
    files = spark.createDataFrame([(0, 0, 5.0), (1, 3, 1.0)], "file_idx int, point_count long, v double")
    flat = files.select("file_idx", "point_count", *[F.col("v").alias(f"{n}_{a}") for a in "xyz" for n in ("min", "max")])
    assert scan.combined(flat).first().max_x == 1.0  # the empty file's bounds do not count


def test_warnings_hide_no_error(spark):
    def scanned(*more):
        rows = [(0, 3006, 5613, 7), *[(i, 3006, None, 7) for i in range(1, 31)], *more]
        files = spark.createDataFrame(rows, "file_idx int, epsg_h int, epsg_v int, point_format int")
        nothing = {"wkt": "string", "extra_bytes": "binary", "extra_width": "int", "gps_standard": "boolean"}
        return pipeline.Scanned(spark, "", files.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}), pipeline.Config())

    assert scanned().validate().vertical_only == tuple(range(1, 31))
    for row, error in (((31, 3007, 5613, 7), errors.CrsMismatch), ((31, 3006, 5613, 6), errors.FormatMismatch)):
        with pytest.raises(error):
            scanned(row).validate()


def test_conversion_keeps_crs_extra_bytes_and_returns(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    for n, (low, high) in enumerate(((3.0, 5.0), (-2.0, 4.0))):
        field = layout.ExtraField(4, 6 | 8, "height", "d", (0,) * 3, (low, 0, 0), (high, 0, 0), (0.1, 0, 0), (0.0,) * 3)
        dark = layout.ExtraField(9, 0, "dark", "", (0.0,) * 3, (float("nan"), 0, 0), (0.0,) * 3, (0.0,) * 3, (0.0,) * 3)
        vlrs = (layout.pack_vlr("LASF_Projection", 2112, WKT.encode() + b"\0") if n else b"") + layout.pack_vlr("LASF_Spec", 4, layout.pack_extra_bytes([field, dark]))
        keys = layout.pack_vlr("LASF_Projection", 34735, struct.pack("<8H", 1, 1, 0, 1, 3072, 0, 1, 3006)) if not n else b""
        r = np.zeros(5, layout.record_dtype(7, 42))
        r["x"], r["b14"], r["gps_time"] = np.arange(5) * 100, [1, 1, 2, 3, 0], np.nan if n else 7.0
        h = layout.Header(encoding=1, point_format=7, record_length=42, data_offset=375 + len(vlrs + keys), vlr_count=2, points=5, high=(4.0, 0.0, 0.0))
        (folder / f"{n}.las").write_bytes(layout.pack_header(h) + vlrs + keys + r.tobytes())
    out = pipeline.convert(spark, str(folder), str(tmp_path / "out"))
    info = spark.read.parquet(out["info"]).collect()
    assert len(info) == 1 and (info[0].wkt, info[0].epsg_h, info[0].epsg_v, info[0].extra_width, info[0].gps_standard) == (WKT, 3006, None, 6, True)
    assert info[0].returns == [4, 2, 2] + [0] * 12 and (info[0].gps_min, info[0].gps_max, info[0].points) == (7.0, 7.0, 10)
    height, dark = layout.parse_extra_bytes(bytes(info[0].extra_bytes))
    assert (height.name, height.options, height.low[0], height.high[0], height.scale[0], dark.options) == ("height", 6 | 8, -2.0, 5.0, 0.1, 0)


def test_layout_sizes_and_extra_bytes():
    assert len(layout.pack_header(layout.Header())) == 375 and len(layout.pack_info((0, 0, 0), 1, 1, 0, 0, (0, 0))) == 160
    assert len(layout.pack_entry((0, 0, 0, 0), 1, 2, 3)) == 32 and len(layout.pack_temporal_header(1, 2, 3, 4, 5)) == 32
    assert len(layout.pack_temporal_entry((0, 0, 0, 0), [1.0, 2.0])) == 36 and len(layout.pack_temporal_pointer((0, 0, 0, 0), 1, 2, 3, 4)) == 48
    assert len(layout.pack_vlr("a", 1, b"xy")) == 56 and len(layout.pack_evlr("a", 1, b"xy")) == 62
    fields = [layout.ExtraField(3, 7, "treeId", "d", (0, 0, 0), (1, 0, 0), (9, 0, 0), (1.0,) * 3, (0.0,) * 3), layout.ExtraField(10, 0, "zNorm", "", (0.0,) * 3, (-1.5, 0, 0), (2.5, 0, 0), (0.0,) * 3, (0.0,) * 3)]
    assert layout.parse_extra_bytes(layout.pack_extra_bytes(fields)) == fields
    with pytest.raises(ValueError):
        layout.parse_extra_bytes(b"x" * 100)
    with pytest.raises(ValueError):
        layout.pack_vlr("a", 1, b"x" * 70_000)


def test_legacy_records_decode():
    h = layout.Header(point_format=3, record_length=34)
    r = np.zeros(1, layout.record_dtype(3, 34))
    r["x"], r["b14"], r["b15"], r["angle_rank"] = 123, 0b11_010_001 & 0xFF, 0b101_00010, -3
    row = las.decode(r.tobytes(), h, 0, 0).to_pylist()[0]
    assert (row["wx"], row["return_number"], row["number_of_returns"], row["classification"], row["flags"], row["scan_angle"]) == (1.23, 1, 2, 2, 5 | 0xC0, -500)


def test_copc_tables(spark, tmp_path):
    nodes = [(l, x, 0, 0) for l in range(6) for x in range(min(2**l, 3))]
    entries = [(*k, 1000 + i, 10, i + 1) for i, k in enumerate(nodes)]
    vlr_size = layout.VLR_HEADER + 160
    data_start = layout.HEADER_14 + vlr_size
    hier_start = data_start + layout.EVLR_HEADER
    data, root, size = copc.hierarchy_bytes(entries, hier_start, 5)
    assert size == 32 * sum(k[0] < 3 for k in nodes) + 32 * len({k[1] for k in nodes if k[0] == 3})
    hierarchy = layout.pack_evlr("copc", 1000, data)
    at = data_start + len(hierarchy) + layout.EVLR_HEADER
    child = layout.pack_temporal_entry((1, 0, 0, 0), [2.0, 3.0])
    first = layout.pack_temporal_entry((0, 0, 0, 0), [1.0]) + layout.pack_temporal_pointer((1, 0, 0, 0), at + 32 + 28 + 48, len(child), 2.0, 3.0)
    temporal = layout.pack_evlr("copc_temporal", 1000, layout.pack_temporal_header(1, 2, 2, at + 32, len(first)) + first + child)
    h = layout.Header(vlr_count=1, data_offset=data_start, evlr_start=data_start, evlr_count=2)
    path = tmp_path / "x.copc.laz"
    path.write_bytes(layout.pack_header(h) + layout.pack_vlr("copc", 1, layout.pack_info((0, 0, 0), 1, 1, root, size, (0, 9))) + hierarchy + temporal)
    las.register(spark)
    assert sorted(map(tuple, spark.read.format("copc_hierarchy").load(str(path)).collect())) == sorted(entries)
    assert [tuple(r) for r in spark.read.format("copc_temporal").load(str(path)).orderBy("level").collect()] == [(0, 0, 0, 0, [1.0]), (1, 0, 0, 0, [2.0, 3.0])]


def test_range_requests_repeat_and_merge():
    body, calls = bytes(range(256)) * 20, []

    class Answer:
        def __init__(self, data, total):
            self.data, self.headers = data, {"Content-Range": f"bytes 0-0/{total}"}

        def __enter__(self):
            return self

        def __exit__(self, *a):
            pass

        def read(self):
            return self.data

    def opener(request, timeout):
        a, b = map(int, request.get_header("Range")[6:].split("-"))
        calls.append((a, b))
        if len(calls) in (1, 2):
            raise urllib.error.HTTPError("u", 503 if len(calls) == 1 else 429, "x", {}, None)
        return Answer(body[a : b + 1], len(body))

    waits = []
    http = by.HttpBytes("http://x", opener, waits.append)
    assert http.size() == len(body) and waits == [0.2, 0.4]
    calls.clear()
    calls += [None] * 5
    wanted = [(4000, 10), (0, 5), (700, 20), (5, 0)]
    assert http.read_many(wanted) == [body[s : s + n] for s, n in wanted]
    assert len(calls) == 5 + 2
    denied = by.HttpBytes("http://x", lambda *a, **k: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "x", {}, None)), waits.append)
    with pytest.raises(urllib.error.HTTPError):
        denied.read(0, 1)
    assert struct.calcsize("<4iQii") == 32 and index.page_boundaries(9) == [3, 6] and index.page_boundaries(3) == []
