"""LAS files as Spark data sources: header table, point table, and a writer.

Point records have a fixed width, so a file splits at any record; a split reads its bytes,
decodes all columns at once and yields Arrow batches.  Compressed files (LAZ) need a codec and
none is installed: the read fails with a clear message, and never returns part of the points.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from stratacloud.errors import NoInputFiles, UnsupportedInput
from stratacloud.sources import layout
from stratacloud.sources.bytes import open_bytes

EXTENSIONS = (".las", ".laz", ".LAS", ".LAZ")
#: Points in a split, and in an Arrow batch.
SPLIT_POINTS, BATCH_POINTS = 2_000_000, 100_000
#: Headers that the planning of a read fetches at a time.
HEADERS_AT_ONCE = 32

HEADER_SCHEMA = (
    "file_idx int, path string, point_count long, point_format int, record_length int, min_x double, max_x double, min_y double, max_y double, min_z double, max_z double, "
    "scale_x double, scale_y double, scale_z double, offset_x double, offset_y double, offset_z double, wkt string, epsg_h int, epsg_v int, extra_bytes binary, "
    "extra_width int, gps_standard boolean, compressed boolean, max_chunk long"
)
POINT_SCHEMA = (
    "file_idx int, record long, wx double, wy double, wz double, intensity int, return_number short, number_of_returns short, flags short, classification short, "
    "scan_angle short, user_data short, point_source_id int, gps_time double, red int, green int, blue int, nir int, extras binary"
)


def collect_input_files(path: str) -> list[str]:
    """A file as it is; of a folder its LAS and LAZ files by name, not those of folders within."""
    if path.startswith(("http://", "https://")) or os.path.isfile(path):
        return [path]
    found = sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(EXTENSIONS) and os.path.isfile(os.path.join(path, n)))
    if not found:
        raise NoInputFiles(f"no LAS or LAZ files in {path}")
    return found


def read_header(path: str) -> layout.Header:
    """Header with its variable-length records; points aren't touched."""
    source = open_bytes(path)
    h = layout.parse_header(source.read(0, layout.HEADER_14))
    h.vlrs = layout.parse_vlrs(source.read(h.header_size, h.data_offset - h.header_size), h.vlr_count)
    return h


def max_laz_chunk(h: layout.Header, path: str) -> int:
    """Points of the largest compressed chunk: the fixed size of the LAZ record; 0 if unknown or not compressed."""
    record = h.vlrs.get(("laszip encoded", 22204), b"")
    if not h.compressed or len(record) < 16:
        return 0
    size = int.from_bytes(record[12:16], "little")
    return 0 if size == 2**32 - 1 else min(size, h.points)


def _header_row(index: int, path: str) -> tuple:
    h = read_header(path)
    wkt = h.vlrs.get(("LASF_Projection", 2112))
    keys = h.vlrs.get(("LASF_Projection", 34735))
    codes = layout.geotiff_epsg(keys) if keys and not wkt else (None, None)
    extra = h.vlrs.get(("LASF_Spec", 4))
    width = h.record_length - np.dtype(layout.FIELDS[h.point_format]).itemsize
    bounds = [v for a in range(3) for v in (h.low[a], h.high[a])]
    text = wkt.rstrip(b"\0").decode("utf-8", "replace") if wkt else None
    return (index, path, h.points, h.point_format, h.record_length, *bounds, *h.scale, *h.offset, text, *codes, extra, width, h.gps_standard, h.compressed, max_laz_chunk(h, path))


class _File(InputPartition):
    def __init__(self, index: int, path: str, start: int = 0, count: int = 0) -> None:
        super().__init__((index, path, start, count))
        self.index, self.path, self.start, self.count = index, path, start, count


class LasHeaderSource(DataSource):
    """format("las_header"): one row for each file, from its header alone."""

    @classmethod
    def name(cls) -> str:
        return "las_header"

    def schema(self) -> str:
        return HEADER_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _HeaderReader(self.options["path"])


class _HeaderReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_File(i, p) for i, p in enumerate(collect_input_files(self.path))]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield _header_row(partition.index, partition.path)


class LasSource(DataSource):
    """format("las"): points in world coordinates; absent fields are 0, option splitPoints sizes the splits."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return POINT_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PointReader(self.options["path"], int(self.options.get("splitPoints", SPLIT_POINTS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _LasWriter({k.lower(): v for k, v in self.options.items()})


class _PointReader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        with ThreadPoolExecutor(HEADERS_AT_ONCE) as pool:
            parts = [part for found in pool.map(self._splits, *zip(*enumerate(collect_input_files(self.path)))) for part in found]
        return parts or [_File(0, "", 0, 0)]

    def _splits(self, index: int, path: str) -> list[InputPartition]:
        h = read_header(path)
        if h.compressed:
            raise UnsupportedInput(f"{path} is LAZ compressed and no LAZ codec is installed")
        return [_File(index, path, s, min(self.split, h.points - s)) for s in range(0, h.points, self.split)]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        h, source = read_header(partition.path), open_bytes(partition.path)
        for at in range(partition.start, partition.start + partition.count, BATCH_POINTS):
            n = min(BATCH_POINTS, partition.start + partition.count - at)
            data = source.read(h.data_offset + at * h.record_length, n * h.record_length)
            yield decode(data, h, partition.index, at)


def decode(data: bytes, h: layout.Header, index: int, first: int) -> pa.RecordBatch:
    """Columns of consecutive records."""
    r = np.frombuffer(data, layout.record_dtype(h.point_format, h.record_length))
    n, names = len(r), r.dtype.names
    zero = np.zeros(n, np.int32)
    world = [r[a].astype(np.float64) * s + o for a, s, o in zip("xyz", h.scale, h.offset)]
    b14, b15 = r["b14"].astype(np.int16), r["b15"].astype(np.int16)
    if h.point_format >= 6:
        number, count, flags, kind, angle = b14 & 15, b14 >> 4, b15, r["classification"], r["scan_angle"]
    else:
        number, count = b14 & 7, (b14 >> 3) & 7
        flags, kind = (b15 >> 5) | (b14 & 0xC0), b15 & 31
        angle = np.round(r["angle_rank"].astype(np.float64) / 0.006)
    column = lambda name, default=zero: r[name] if name in names else default
    extras = [bytes(x) for x in r["extra"]] if "extra" in names else [b""] * n
    columns = [
        np.full(n, index, np.int32), np.arange(first, first + n, dtype=np.int64), *world, r["intensity"].astype(np.int32), *[x.astype(np.int16) for x in (number, count, flags, kind, angle, r["user_data"])],
        r["point_source_id"].astype(np.int32), column("gps_time", np.zeros(n)).astype(np.float64), *[column(c).astype(np.int32) for c in ("red", "green", "blue", "nir")],
    ]
    fields = [f.split(" ")[0] for f in POINT_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(c)) for c in columns], pa.array(extras, pa.binary())], names=fields)


def encode(batch: pa.RecordBatch, point_format: int, scale: tuple, offset: tuple, extra: int = 0) -> np.ndarray:
    """Records of an extended format (6, 7 or 8) from the columns of POINT_SCHEMA; absent columns are 0."""
    n, names = batch.num_rows, set(batch.schema.names)
    out = np.zeros(n, layout.record_dtype(point_format, np.dtype(layout.FIELDS[point_format]).itemsize + extra))
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False) if c in names else np.zeros(n)
    for a, s, o in zip("xyz", scale, offset):
        steps = (get(f"w{a}") - o) / s
        size = np.floor(np.abs(steps))
        size += np.abs(steps) - size >= 0.5
        out[a] = np.clip(np.nan_to_num(np.sign(steps) * size), -(2**31), 2**31 - 1).astype(np.int32)
    out["b14"] = (get("return_number").astype(int) & 15) | ((get("number_of_returns").astype(int) & 15) << 4)
    out["b15"] = get("flags").astype(int) & 255
    for c in ("intensity", "classification", "scan_angle", "user_data", "point_source_id", "gps_time", *[f for f, _ in layout.FIELDS[point_format][11:]]):
        out[c] = get(c)
    if extra:
        out["extra"] = [np.void((b or b"")[:extra].ljust(extra, b"\0")) for b in batch.column("extras").to_pylist()]
    return out


class _Fragment(WriterCommitMessage):
    def __init__(self, path: str, stats: dict) -> None:
        self.path, self.stats = path, stats


class _LasWriter(DataSourceArrowWriter):
    """One file, or a folder of tiles if the path doesn't end in .las.

    For a folder every task writes a whole file of its own, under a name that readers pass over until
    the commit renames it: nothing is copied.  For one file the commit joins the records of
    the tasks on the driver.  The target must be a folder that the driver and the executors
    share.  Options: path, pointFormat, scale, offset, extraBytes, gpsStandard, wkt.
    """

    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.tiles = not self.path.lower().endswith(".las")
        self.format = int(options.get("pointformat", 7))
        self.scale = tuple(map(float, options.get("scale", "0.01,0.01,0.01").split(",")))
        self.offset = tuple(map(float, options.get("offset", "0,0,0").split(",")))
        self.extra = int(options.get("extrabytes", 0))
        self.standard, self.wkt = options.get("gpsstandard", "true") == "true", options.get("wkt", "")

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Fragment:
        from pyspark import TaskContext

        name = f"part-{TaskContext.get().partitionId():05d}-{TaskContext.get().taskAttemptId()}"
        if self.tiles:
            os.makedirs(self.path, exist_ok=True)
        part = f"{self.path}/{name}.las.tmp" if self.tiles else f"{self.path}.{name}"
        stats = {"n": 0, "low": [np.inf] * 3, "high": [-np.inf] * 3, "returns": [0] * 15}
        with open(part, "wb") as f:
            if self.tiles:
                f.write(self._head([]))
            for batch in batches:
                r = encode(batch, self.format, self.scale, self.offset, self.extra)
                f.write(r.tobytes())
                if len(r):
                    stats["n"] += len(r)
                    stats["low"] = [min(v, int(r[a].min())) for v, a in zip(stats["low"], "xyz")]
                    stats["high"] = [max(v, int(r[a].max())) for v, a in zip(stats["high"], "xyz")]
                    counts = np.bincount(r["b14"] & 15, minlength=16)[1:]
                    stats["returns"] = [int(a + b) for a, b in zip(stats["returns"], counts)]
            if self.tiles:
                f.seek(0)
                f.write(self._head([stats]))
        return _Fragment(part, stats)

    def _head(self, parts: list[dict]) -> bytes:
        """Header and variable-length records, of the same length whatever the parts."""
        full = [s for s in parts if s["n"]]
        world = lambda values, f: tuple(float(f(v)) * s + o for v, s, o in zip(zip(*values), self.scale, self.offset)) if values else (0.0,) * 3
        vlrs = layout.pack_vlr("LASF_Projection", 2112, self.wkt.encode() + b"\0") if self.wkt else b""
        length = np.dtype(layout.FIELDS[self.format]).itemsize + self.extra
        h = layout.Header(
            encoding=(1 if self.standard else 0) | (16 if self.wkt else 0), point_format=self.format, record_length=length, data_offset=layout.HEADER_14 + len(vlrs), vlr_count=bool(vlrs),
            points=sum(s["n"] for s in full), scale=self.scale, offset=self.offset, low=world([s["low"] for s in full], min), high=world([s["high"] for s in full], max),
            returns=tuple(map(sum, zip(*[s["returns"] for s in full]))) if full else (0,) * 15,
        )
        return layout.pack_header(h) + vlrs

    def commit(self, messages: list[_Fragment | None]) -> None:
        parts = [m for m in messages if m is not None]
        if self.tiles:
            # tasks without points leave no tile, unless none has any
            kept = [m for m in parts if m.stats["n"]] or parts[:1]
            for m in parts:
                if not m.stats["n"] and m is not kept[0]:
                    os.remove(m.path)
            for m in kept:
                os.replace(m.path, m.path.removesuffix(".tmp"))
            return
        with open(f"{self.path}.tmp", "wb") as out:
            out.write(self._head([m.stats for m in parts]))
            for m in parts:
                with open(m.path, "rb") as f:
                    while block := f.read(1 << 24):
                        out.write(block)
        os.replace(f"{self.path}.tmp", self.path)
        for m in parts:
            os.remove(m.path)

    def abort(self, messages: list[_Fragment | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def register(spark: SparkSession) -> None:
    from stratacloud.sources.copc import CopcHierarchySource, CopcTemporalSource

    for source in (LasHeaderSource, LasSource, CopcHierarchySource, CopcTemporalSource):
        spark.dataSource.register(source)
