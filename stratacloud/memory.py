"""The memory that this process may use: the tightest limit of its control groups, or the machine's memory."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

DEFAULT_LIMIT = 16 << 30
#: Version 1 writes this or more where nothing is limited: the largest signed number of whole pages.
UNLIMITED = 0x7FFFFFFFFFFFF000


def _limit_files(listing: str, root: Path) -> Iterator[Path]:
    """Files that may hold a limit: those of each listed group and of all groups above it."""
    for line in listing.splitlines():
        number, _, rest = line.partition(":")
        controllers, found, group = rest.partition(":")
        if not found:
            continue
        if number == "0" and not controllers:
            base, names = root, ("memory.max", "memory.high")
        elif "memory" in controllers.split(","):
            base, names = root / "memory", ("memory.limit_in_bytes",)
        else:
            continue
        leaf = base / group.lstrip("/")
        # a container may list a path of its host, which it can't see
        folders = [leaf, *(f for f in leaf.parents if f.is_relative_to(base))] if leaf.is_dir() else [base]
        yield from (folder / name for folder in folders for name in names)


def group_limit(listing: str, root: Path) -> int | None:
    """The least limit in bytes along the groups of a listing (as in /proc/self/cgroup); None without one."""
    limits = []
    for file in _limit_files(listing, root):
        try:
            value = int(file.read_text())
        except (OSError, ValueError):  # not there, not readable, or "max"
            continue
        if value < UNLIMITED:
            limits.append(value)
    return min(limits, default=None)


def machine_memory() -> int | None:
    try:
        return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (OSError, ValueError):
        return None


def detect(listing: Path = Path("/proc/self/cgroup"), root: Path = Path("/sys/fs/cgroup")) -> int:
    """Bytes: the least of group limits and the machine's memory, 16 GiB if neither is known."""
    try:
        limited = group_limit(listing.read_text(), root)
    except OSError:
        limited = None
    return min((v for v in (limited, machine_memory()) if v is not None), default=DEFAULT_LIMIT)
