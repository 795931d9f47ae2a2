"""Random access to bytes: local files and HTTP servers with range requests."""

from __future__ import annotations

import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

GAP = 1024
RETRIES, FIRST_WAIT, LONGEST_WAIT = 5, 0.2, 5.0
IN_FLIGHT = 8


def merge_ranges(ranges: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """(start, length) requests that cover the ranges, those at most `gap` bytes apart together."""
    out: list[list[int]] = []
    for start, end in sorted((s, s + n) for s, n in ranges):
        if out and start <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b - a) for a, b in out]


class LocalBytes:
    def __init__(self, path: str) -> None:
        self.path = path

    def size(self) -> int:
        return os.path.getsize(self.path)

    def read(self, start: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(start)
            return f.read(length)

    def read_many(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        return [self.read(*r) for r in ranges]


class HttpBytes:
    """Range requests that are repeated after network errors, 429 and 5xx, with growing waits."""

    def __init__(self, url: str, opener: Callable = urllib.request.urlopen, sleep: Callable = time.sleep) -> None:
        self.url, self.opener, self.sleep = url, opener, sleep

    def _get(self, start: int, length: int) -> tuple[bytes, str]:
        wait = FIRST_WAIT
        for attempt in range(RETRIES + 1):
            try:
                request = urllib.request.Request(self.url, headers={"Range": f"bytes={start}-{start + length - 1}"})
                with self.opener(request, timeout=30) as answer:
                    return answer.read(), answer.headers.get("Content-Range", "")
            except urllib.error.HTTPError as e:
                if attempt == RETRIES or not (e.code == 429 or e.code >= 500):
                    raise
            except (urllib.error.URLError, ConnectionError, TimeoutError):
                if attempt == RETRIES:
                    raise
            self.sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)
        raise AssertionError

    def size(self) -> int:
        return int(self._get(0, 1)[1].rpartition("/")[2])

    def read(self, start: int, length: int) -> bytes:
        return self._get(start, length)[0] if length else b""

    def read_many(self, ranges: list[tuple[int, int]]) -> list[bytes]:
        """Bytes of the ranges in their order, from merged requests of which a few run at a time."""
        requests = merge_ranges([r for r in ranges if r[1]])
        with ThreadPoolExecutor(IN_FLIGHT) as pool:
            parts = dict(zip(requests, pool.map(lambda r: self.read(*r), requests)))
        out = []
        for start, length in ranges:
            at = next(((s, d) for (s, n), d in parts.items() if s <= start and start + length <= s + n), (start, b""))
            out.append(at[1][start - at[0] : start - at[0] + length])
        return out


def open_bytes(path: str) -> LocalBytes | HttpBytes:
    return HttpBytes(path) if path.startswith(("http://", "https://")) else LocalBytes(path.removeprefix("file://"))
