"""Vectorised word and shingle hashing over Arrow string buffers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D.  Every word gets a 64-bit
hash that depends on its bytes alone (polynomial over random byte values, then a mixing
finaliser), so hashes agree between executors and runs.  The work is done on slices of a
quarter megabyte, whatever the batch size, so memory stays bounded by the longest text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator: a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        values = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _GOLD)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {lower: _byte_values(lower) for lower in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _inverse(a: int) -> int:
    x = a
    for _ in range(6):
        x = x * (2 - a * x) % 2**64
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n; kept for the usual slice size only."""
    if "up" in _POWERS and len(_POWERS["up"]) >= n:
        return _POWERS["up"], _POWERS["down"]
    size = max(n, SLICE_BYTES + 1)

    def run(base: int) -> np.ndarray:
        out = np.full(size, base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            return np.multiply.accumulate(out)

    up, down = run(int(_BASE)), run(_inverse(int(_BASE)))
    if size <= SLICE_BYTES + 1:
        _POWERS.update(up=up, down=down)
    return up, down


_RESIDENT: dict[tuple, object] = {}


def resident(make: Callable, *args):
    """make(*args), kept for the next task of this worker; only one such model is kept at a time."""
    key = (make.__module__, make.__qualname__, *args)
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make(*args)
    return _RESIDENT[key]


def frugal(run: Callable) -> Callable:
    """run for mapInArrow, with Arrow's buffers from the system and freed memory given back when a task ends.

    Workers live on between tasks; what one task has freed would else stay with each of them.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library than glibc
                pass

    return task


class Words:
    """Words of consecutive texts: hashes, byte spans, and the first word of each text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray):
        self.data, self.starts, self.ends, self.hashes, self.first = data, starts, ends, hashes, first

    def __len__(self) -> int:
        return len(self.first) - 1


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    base = int(offsets[0])
    data = data[base : int(offsets[-1])]
    offsets = (offsets - base).astype(np.int64)
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64))
    word = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_VALUES[lower][data] * up[:n], out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _GOLD)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words; fewer than k words make one shingle, none make none."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    with np.errstate(over="ignore"):
        out = np.full(n - k + 1, np.uint64(k), dtype=np.uint64)
        for j in range(k):
            out = mix64(out * _GOLD + hashes[j : n - k + 1 + j])
    return out


def string_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, bytes, offsets) of runs of texts of about `limit` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, data, offsets[i : j + 1]
        i = j
