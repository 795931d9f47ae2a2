"""COPC files: the hierarchy and the temporal index as tables, and their binary form."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratacloud.sources import layout
from stratacloud.sources.bytes import open_bytes

INFO = ("copc", 1)
#: User and number of the record with the temporal index.
TEMPORAL = ("copc_temporal", 1000)
HIERARCHY = ("copc", 1000)


def read_info(path: str) -> dict:
    source = open_bytes(path)
    h = layout.parse_header(source.read(0, layout.HEADER_14))
    vlrs = layout.parse_vlrs(source.read(h.header_size, h.data_offset - h.header_size), h.vlr_count)
    return layout.parse_info(vlrs[INFO]) | {"points": h.points, "evlr_start": h.evlr_start, "evlr_count": h.evlr_count}


def walk_hierarchy(path: str) -> Iterator[tuple]:
    """Entries of all pages, a level of pages with one merged request."""
    info, source = read_info(path), open_bytes(path)
    pages = [(info["root_offset"], info["root_size"])]
    while pages:
        following = []
        for data in source.read_many(pages):
            for entry in layout.parse_entries(data):
                if entry[6] == -1:
                    following.append((entry[4], entry[5]))
                else:
                    yield entry
        pages = following


def find_evlr(path: str, wanted: tuple[str, int]) -> tuple[int, int] | None:
    """(start, length) of an extended record's data, from the headers alone."""
    import struct

    info, source = read_info(path), open_bytes(path)
    at = info["evlr_start"]
    for _ in range(info["evlr_count"]):
        _, user, record, size = struct.unpack("<H16sHQ", source.read(at, 28))
        if (user.split(b"\0")[0].decode("latin-1"), record) == wanted:
            return at + layout.EVLR_HEADER, size
        at += layout.EVLR_HEADER + size
    return None


def walk_temporal(path: str) -> Iterator[tuple]:
    """level, x, y, z, samples of every node of the temporal index; none if the file has no index."""
    found = find_evlr(path, TEMPORAL)
    if found is None:
        return
    start, size = found
    data = open_bytes(path).read(start, size)  # one request for the whole index
    head = layout.parse_temporal_header(data)
    pages = [(head["root_offset"], head["root_size"])]
    while pages:
        at, n = pages.pop()
        entries, pointers = layout.parse_temporal_page(data[at - start : at - start + n])
        yield from entries
        pages += [(p[4], p[5]) for p in pointers]


class _Walk(DataSourceReader):
    def __init__(self, path: str, walk) -> None:
        self.path, self.walk = path, walk

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.walk(partition.value)


class CopcHierarchySource(DataSource):
    """format("copc_hierarchy"): one row for each node."""

    @classmethod
    def name(cls) -> str:
        return "copc_hierarchy"

    def schema(self) -> str:
        return "level int, x int, y int, z int, offset long, byte_size int, point_count int"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options["path"], walk_hierarchy)


class CopcTemporalSource(DataSource):
    """format("copc_temporal"): one row for each node with its samples in GPS order."""

    @classmethod
    def name(cls) -> str:
        return "copc_temporal"

    def schema(self) -> str:
        return "level int, x int, y int, z int, samples array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options["path"], walk_temporal)


def hierarchy_bytes(entries: list[tuple], start: int, max_level: int) -> tuple[bytes, int, int]:
    """(bytes, root offset, root size) of paged entries (level, x, y, z, offset, byte_size, point_count).

    Pages follow one another from `start`, parents first; a node at a boundary level roots a
    page of its own.  Nodes are few next to points: this is the driver's part of the commit.
    """
    from stratacloud.operators.index import page_boundaries

    bounds = page_boundaries(max_level)
    pages: dict[tuple, list[tuple]] = {}
    for e in sorted(entries, key=lambda e: e[:4]):
        at = max((b for b in bounds if b <= e[0]), default=0)
        pages.setdefault((at, *(v >> (e[0] - at) for v in e[1:4])), []).append(e)
    children: dict[tuple, list[tuple]] = {}
    for key in sorted(pages):
        if key[0]:
            up = max((b for b in bounds if b < key[0]), default=0)
            above = (up, *(v >> (key[0] - up) for v in key[1:]))
            pages.setdefault(above, [])
            children.setdefault(above, []).append(key)
    order = sorted(pages)
    sizes = {k: 32 * (len(pages[k]) + len(children.get(k, []))) for k in order}
    offsets, at = {}, start
    for k in order:
        offsets[k], at = at, at + sizes[k]
    out = b"".join(layout.pack_entry(e[:4], *e[4:]) for k in order for e in [*pages[k], *[(*c, offsets[c], sizes[c], -1) for c in children.get(k, [])]])
    return out, offsets[order[0]] if order else start, sizes[order[0]] if order else 0


def entries_of(nodes: DataFrame) -> list[tuple]:
    """Rows of chunk_offsets() for hierarchy_bytes(): a number of nodes, not of points."""
    return [tuple(r) for r in nodes.select("level", "x", "y", "z", "offset", "byte_size", "point_count").collect()]
