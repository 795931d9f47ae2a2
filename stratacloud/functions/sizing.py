"""Planner sizes from counts and memory, and their readable forms."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LEAF_POINTS = 100_000
MIN_CHUNK_POINTS = 500_000
SPLIT_LEVEL_CAP = 6
LOCAL_LEVEL_CAP = 13
#: Bytes that planning and building reckon with for a point, and the part of the budget that planning uses.
PLAN_POINT_BYTES, BUILD_POINT_BYTES, PLAN_PART = 170, 600, 0.6
SLOT_BYTES, MOST_SLOTS, POOL_PART = 512 << 20, 16, 0.4


def _levels(count: Column, limit: int, cap: int) -> Column:
    out = F.lit(cap)
    for k in range(cap - 1, -1, -1):
        out = F.when(count.cast("double") / float(8**k) <= float(limit), k).otherwise(out)
    return out


def split_levels(count: Column, target: int) -> Column:
    """Levels that a finest cell is divided by so that its parts hold about `target` points."""
    return _levels(count, target, SPLIT_LEVEL_CAP)


def local_levels(count: Column, limit: int = MAX_LEAF_POINTS) -> Column:
    """Levels below a chunk root at which evenly spread points fill leaves of at most `limit`."""
    return _levels(count, limit, LOCAL_LEVEL_CAP)


def grid_size(total: int, budget: int) -> int:
    """Cells along an axis of the counting grid: more for more points, within a twentieth of the budget."""
    wanted = 128 if total < 100_000_000 else 256 if total < 500_000_000 else 512
    room = budget * 5 // 100 // 4
    return next((g for g in (512, 256) if g <= wanted and g**3 <= room), 128)


def grid_size_column(total: Column, budget: Column) -> Column:
    room = F.call_function("div", F.call_function("div", budget * 5, F.lit(100)), F.lit(4))
    return F.when((total >= 500_000_000) & (room >= 512**3), 512).when((total >= 100_000_000) & (room >= 256**3), 256).otherwise(128)


def build_slots(budget: int, cores: int) -> tuple[int, int]:
    """(slots, points that a slot holds) of the in-memory build."""
    pool = int(budget * POOL_PART)
    slots = max(1, min(pool // SLOT_BYTES, MOST_SLOTS, cores))
    return slots, pool // slots // BUILD_POINT_BYTES


def chunk_target(budget: int, workers: int, total: int, cores: int) -> int:
    """Points that a chunk should hold: within memory, at least four chunks a worker, never tiny."""
    workers = max(1, workers)
    by_memory = int(budget * PLAN_PART / (workers * PLAN_POINT_BYTES))
    by_workers = max(total // (workers * 4), MIN_CHUNK_POINTS)
    most = max(build_slots(budget, cores)[1], MIN_CHUNK_POINTS)
    return max(MIN_CHUNK_POINTS, min(by_memory, by_workers, most))


def writer_window(budget: int, record: int, extra: int = 0, point: int = 64) -> int:
    """Points written at a time, from half the budget."""
    return max(100_000, min(4_000_000, budget // 2 // (point + extra + 2 * record)))


def workers(cores: int, files: int) -> int:
    return max(1, min(max(2 * cores // 3, 2), files))


_BINARY = {"": 1, "k": 1 << 10, "ki": 1 << 10, "m": 1 << 20, "mi": 1 << 20, "g": 1 << 30, "gi": 1 << 30, "t": 1 << 40, "ti": 1 << 40}
_DECIMAL = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "b": 10**9, "t": 10**12}


def _parse(text: Column, units: dict[str, int]) -> Column:
    """Number with a unit as a whole count; null if it isn't one."""
    shape = r"^\s*([0-9]+(?:\.[0-9]*)?|\.[0-9]+)\s*([A-Za-z]*)\s*$"
    number, unit = F.regexp_extract(text, shape, 1), F.lower(F.regexp_extract(text, shape, 2))
    unit = F.regexp_replace(unit, "(?<=[kmgt]i?)b$", "")
    factor = F.lit(None).cast("double")
    for k, v in units.items():
        factor = F.when(unit == k, float(v)).otherwise(factor)
    return F.when(number != "", F.floor(number.try_cast("double") * factor))


def parse_size(text: Column) -> Column:
    """Bytes of "16Gi", "1.5T", "512m": units are binary."""
    return _parse(text, _BINARY)


def parse_count(text: Column) -> Column:
    """Points of "10M", "1.5k": units are decimal."""
    return _parse(text, _DECIMAL)


def human_count(n: Column) -> Column:
    """1234 as 1.2K, 5600000 as 5.6M."""
    x = n.cast("double")
    return F.when(x >= 1e9, F.format_string("%.1fG", x / 1e9)).when(x >= 1e6, F.format_string("%.1fM", x / 1e6)).when(x >= 1e3, F.format_string("%.1fK", x / 1e3)).otherwise(F.format_string("%d", n.cast("long")))


def human_bytes(n: Column) -> Column:
    x = n.cast("double")
    out = F.format_string("%d B", n.cast("long"))
    for name, size in (("KiB", 2.0**10), ("MiB", 2.0**20), ("GiB", 2.0**30), ("TiB", 2.0**40)):
        out = F.when(x >= size, F.format_string(f"%.1f {name}", x / size)).otherwise(out)
    return out


def human_seconds(seconds: Column) -> Column:
    """75.2 as 1m15s, 3700 as 1h01m40s."""
    s = F.floor(seconds).cast("long")
    h, m = F.call_function("div", s, F.lit(3600)), F.call_function("div", s % 3600, F.lit(60))
    return F.when(s >= 3600, F.format_string("%dh%02dm%02ds", h, m, s % 60)).when(s >= 60, F.format_string("%dm%02ds", m, s % 60)).otherwise(F.format_string("%ds", s))


def day_and_year(days: Column) -> tuple[Column, Column]:
    """(day of year, year) of a day number since 1970; (0, 0) before it."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))
    return F.when(days < 0, 0).otherwise(F.dayofyear(day)), F.when(days < 0, 0).otherwise(F.year(day))


def header_date(days: int) -> tuple[int, int]:
    """The same for the header of a file, on the driver."""
    if days < 0:
        return 0, 0
    day = date(1970, 1, 1) + timedelta(days=days)
    return day.timetuple().tm_yday, day.year
