"""Binary layouts of LAS 1.0 to 1.4 and COPC 1.0 as their public specifications give them."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

HEADER_14 = 375
VLR_HEADER, EVLR_HEADER = 54, 60
MOST_VLR = 65_535

_XYZ = [("x", "<i4"), ("y", "<i4"), ("z", "<i4"), ("intensity", "<u2"), ("b14", "u1"), ("b15", "u1")]
_LEGACY = [*_XYZ, ("angle_rank", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
_EXTENDED = [*_XYZ, ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
_GPS, _RGB, _NIR, _WAVE = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")], [("nir", "<u2")], [("wave", "V29")]
#: The fields of a record by point format.
FIELDS = {
    0: _LEGACY, 1: _LEGACY + _GPS, 2: _LEGACY + _RGB, 3: _LEGACY + _GPS + _RGB, 4: _LEGACY + _GPS + _WAVE, 5: _LEGACY + _GPS + _RGB + _WAVE,
    6: _EXTENDED, 7: _EXTENDED + _RGB, 8: _EXTENDED + _RGB + _NIR, 9: _EXTENDED + _WAVE, 10: _EXTENDED + _RGB + _NIR + _WAVE,
}
#: NumPy types of extra bytes by code.
EXTRA_TYPES = {1: "<u1", 2: "<i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}


def record_dtype(point_format: int, record_length: int) -> np.dtype:
    known = np.dtype(FIELDS[point_format])
    extra = record_length - known.itemsize
    if extra < 0:
        raise ValueError(f"records of format {point_format} have at least {known.itemsize} bytes, not {record_length}")
    return np.dtype(FIELDS[point_format] + ([("extra", f"V{extra}")] if extra else []))


@dataclass
class ExtraField:
    data_type: int
    options: int
    name: str
    description: str
    no_data: tuple
    low: tuple
    high: tuple
    scale: tuple
    offset: tuple


def _any(data: bytes, code: int) -> tuple:
    """Three 8-byte values of an extra field's type as doubles; none for undocumented types."""
    if code not in EXTRA_TYPES:
        return (None,) * 3
    wide = "<f8" if code > 8 else "<u8" if code % 2 else "<i8"
    return tuple(float(v) for v in np.frombuffer(data, wide))


def parse_extra_bytes(data: bytes) -> list[ExtraField]:
    if len(data) % 192:
        raise ValueError("the Extra Bytes record isn't a whole number of descriptors")
    out = []
    for at in range(0, len(data), 192):
        d = data[at : at + 192]
        text = lambda b: b.split(b"\0")[0].decode("utf-8", "strict")
        try:
            name, description = text(d[4:36]), text(d[160:192])
        except UnicodeDecodeError:
            name, description = "", ""
        code = d[2]
        out.append(ExtraField(code, d[3], name, description, _any(d[40:64], code), _any(d[64:88], code), _any(d[88:112], code), struct.unpack("<3d", d[112:136]), struct.unpack("<3d", d[136:160])))
    return out


def pack_extra_bytes(fields: list[ExtraField]) -> bytes:
    out = b""
    for f in fields:
        wide = "d" if f.data_type > 8 else "Q" if f.data_type % 2 else "q"
        three = lambda v: struct.pack(f"<3{wide}", *[(x or 0) if wide == "d" else int(x or 0) for x in v])  # noqa: B023, E731
        out += struct.pack("<HBB32s4x", 0, f.data_type, f.options, f.name.encode()) + three(f.no_data) + three(f.low) + three(f.high) + struct.pack("<6d32s", *f.scale, *f.offset, f.description.encode())
    return out


#: Bits of a descriptor's options, and those that change how values are decoded.
NO_DATA, LOW, HIGH, STRUCTURE = 1, 2, 4, 24


def extra_structure(data: bytes) -> bytes:
    """What descriptors must agree in, without the ranges and their bits; a record of no whole descriptors as it is."""
    if len(data) % 192:
        return bytes(data)
    name = lambda b: b.split(b"\0")[0].ljust(32, b"\0")
    each = [data[at : at + 192] for at in range(0, len(data), 192)]
    return b"".join(bytes([d[2], d[3] & STRUCTURE]) + name(d[4:36]) + d[40:64] + d[112:160] + name(d[160:192]) for d in each)


def extra_stats(data: bytes) -> list[tuple]:
    """(place, low, high, no_data) of each axis of each descriptor, place = 3 * descriptor + axis; null what isn't given."""
    if len(data) % 192:
        return []
    out = []
    for n, f in enumerate(parse_extra_bytes(data)):
        for axis in range(3):
            low, high = f.low[axis] if f.options & LOW else None, f.high[axis] if f.options & HIGH else None
            out.append((3 * n + axis, low, high, bool(f.options & NO_DATA)))
    return out


def with_extra_stats(data: bytes, merged: dict[int, tuple]) -> bytes:
    """Descriptors with the ranges of merged[place] = (low, high, no_data); bits follow the first axis."""
    out = bytearray(data)
    for n in range(len(data) // 192 if len(data) % 192 == 0 else 0):
        at = 192 * n
        code, three = out[at + 2], [merged.get(3 * n + axis, (None, None, False)) for axis in range(3)]
        bits = out[at + 3] & STRUCTURE | (NO_DATA if three[0][2] else 0)
        for side, bit, place in ((0, LOW, 64), (1, HIGH, 88)):
            if three[0][side] is not None:
                bits |= bit
                out[at + place : at + place + 24] = b"".join(_pack_any(code, v[side]) for v in three)
        out[at + 3] = bits
    return bytes(out)


def _pack_any(code: int, value: float | None) -> bytes:
    if code > 8:
        return struct.pack("<d", value or 0.0)
    least, most = (0, 2**64 - 1) if code % 2 else (-(2**63), 2**63 - 1)
    return struct.pack("<Q" if code % 2 else "<q", min(max(int(value or 0), least), most))


@dataclass
class Header:
    version: tuple[int, int] = (1, 4)
    encoding: int = 0
    point_format: int = 6
    record_length: int = 30
    data_offset: int = HEADER_14
    vlr_count: int = 0
    header_size: int = HEADER_14
    points: int = 0
    scale: tuple = (0.01, 0.01, 0.01)
    offset: tuple = (0.0, 0.0, 0.0)
    low: tuple = (0.0, 0.0, 0.0)
    high: tuple = (0.0, 0.0, 0.0)
    evlr_start: int = 0
    evlr_count: int = 0
    returns: tuple = (0,) * 15
    created: tuple[int, int] = (0, 0)
    compressed: bool = False
    vlrs: dict = field(default_factory=dict)

    @property
    def gps_standard(self) -> bool:
        return bool(self.encoding & 1)


def parse_header(data: bytes) -> Header:
    """Header from the first bytes of a file; 375 are enough for every version."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    h = Header()
    h.encoding = struct.unpack_from("<H", data, 6)[0]
    h.version = (data[24], data[25])
    h.created = struct.unpack_from("<HH", data, 90)
    h.header_size, h.data_offset, h.vlr_count = struct.unpack_from("<HII", data, 94)
    h.compressed, h.point_format = bool(data[104] & 0x80), data[104] & 0x3F
    h.record_length, h.points = struct.unpack_from("<HI", data, 105)
    h.scale, h.offset = struct.unpack_from("<3d", data, 131), struct.unpack_from("<3d", data, 155)
    x1, x0, y1, y0, z1, z0 = struct.unpack_from("<6d", data, 179)
    h.low, h.high = (x0, y0, z0), (x1, y1, z1)
    if h.version >= (1, 4) and h.header_size >= HEADER_14:
        h.evlr_start, h.evlr_count, h.points = struct.unpack_from("<QIQ", data, 235)
        h.returns = struct.unpack_from("<15Q", data, 255)
    return h


def pack_header(h: Header, software: str = "stratacloud") -> bytes:
    legacy = h.points if h.point_format < 6 and h.points < 2**32 else 0
    out = struct.pack("<4sHH16sBB32s32sHHHII", b"LASF", 0, h.encoding, b"", *h.version, b"", software.encode(), *h.created, h.header_size, h.data_offset, h.vlr_count)
    out += struct.pack("<BHI5I", h.point_format | (0x80 if h.compressed else 0), h.record_length, legacy, *(h.returns[:5] if legacy else (0,) * 5))
    out += struct.pack("<6d", *h.scale, *h.offset) + struct.pack("<6d", *[v for a in range(3) for v in (h.high[a], h.low[a])])
    return out + struct.pack("<QQIQ15Q", 0, h.evlr_start, h.evlr_count, h.points, *h.returns)


def pack_vlr(user: str, record: int, data: bytes, description: str = "") -> bytes:
    if len(data) > MOST_VLR:
        raise ValueError(f"a record of {len(data)} bytes doesn't fit a VLR")
    return struct.pack("<H16sHH32s", 0, user.encode(), record, len(data), description.encode()) + data


def pack_evlr(user: str, record: int, data: bytes, description: str = "") -> bytes:
    return struct.pack("<H16sHQ32s", 0, user.encode(), record, len(data), description.encode()) + data


def parse_vlrs(data: bytes, count: int, wide: bool = False) -> dict[tuple[str, int], bytes]:
    """Records by (user, number); the first of each stays."""
    out, at = {}, 0
    for _ in range(count):
        _, user, record, size = struct.unpack_from("<H16sHQ" if wide else "<H16sHH", data, at)
        at += EVLR_HEADER if wide else VLR_HEADER
        out.setdefault((user.split(b"\0")[0].decode("latin-1"), record), data[at : at + size])
        at += size
    return out


def geotiff_epsg(data: bytes) -> tuple[int | None, int | None]:
    """Horizontal and vertical codes of a GeoTIFF key directory."""
    found = {}
    for key, place, _, value in struct.iter_unpack("<4H", data[8 : 8 + struct.unpack_from("<H", data, 6)[0] * 8]):
        if place == 0:
            found[key] = value
    return found.get(3072) or found.get(2048), found.get(4096)


# COPC and temporal index records


def pack_info(center: tuple, half: float, spacing: float, root_offset: int, root_size: int, gps: tuple[float, float]) -> bytes:
    return struct.pack("<5dQQ2d88x", *center, half, spacing, root_offset, root_size, *gps)


def parse_info(data: bytes) -> dict:
    x, y, z, half, spacing, root_offset, root_size, low, high = struct.unpack_from("<5dQQ2d", data)
    return {"center": (x, y, z), "half": half, "spacing": spacing, "root_offset": root_offset, "root_size": root_size, "gps_min": low, "gps_max": high}


def pack_entry(key: tuple[int, int, int, int], offset: int, size: int, points: int) -> bytes:
    return struct.pack("<4iQii", *key, offset, size, points)


def parse_entries(data: bytes) -> list[tuple]:
    """(level, x, y, z, offset, byte_size, point_count); a count of -1 points to a page."""
    return list(struct.iter_unpack("<4iQii", data))


def pack_temporal_header(stride: int, nodes: int, pages: int, root_offset: int, root_size: int) -> bytes:
    return struct.pack("<IIIIQII", 1, stride, nodes, pages, root_offset, root_size, 0)


def parse_temporal_header(data: bytes) -> dict:
    names = ("version", "stride", "nodes", "pages", "root_offset", "root_size")
    return dict(zip(names, struct.unpack_from("<IIIIQI", data)))


def pack_temporal_entry(key: tuple[int, int, int, int], samples: list[float]) -> bytes:
    return struct.pack(f"<4iI{len(samples)}d", *key, len(samples), *samples)


def pack_temporal_pointer(key: tuple[int, int, int, int], offset: int, size: int, low: float, high: float) -> bytes:
    """A page pointer: an entry without samples, then where the page lies and the times of its subtree."""
    return struct.pack("<4iIQI2d", *key, 0, offset, size, low, high)


def parse_temporal_page(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """(entries, pointers) of a page."""
    entries, pointers, at = [], [], 0
    while at < len(data):
        *key, n = struct.unpack_from("<4iI", data, at)
        at += 20
        if n == 0:
            pointers.append((*key, *struct.unpack_from("<QI2d", data, at)))
            at += 28
        else:
            entries.append((*key, list(struct.unpack_from(f"<{n}d", data, at))))
            at += 8 * n
    return entries, pointers
