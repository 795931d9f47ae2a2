"""Progress of a run: observers get the start, the progress and the end of each stage."""

from __future__ import annotations

import json
import sys
import time
from typing import Protocol, TextIO

STAGES = ("scan", "validate", "plan", "build", "thin", "write")


class Observer(Protocol):
    def event(self, stage: str, what: str, **facts) -> None: ...


class Silent:
    def event(self, stage: str, what: str, **facts) -> None:
        pass


class JsonLines:
    """One JSON object a line; progress at most once for each tenth."""

    def __init__(self, out: TextIO = sys.stdout) -> None:
        self.out, self.tenth = out, {}

    def event(self, stage: str, what: str, **facts) -> None:
        if what == "progress":
            tenth = int(10 * facts["done"] / max(1, facts["total"]))
            if self.tenth.get(stage) == tenth:
                return
            self.tenth[stage] = tenth
        print(json.dumps({"stage": stage, "event": what} | facts), file=self.out, flush=True)


class Plain:
    def __init__(self, out: TextIO = sys.stderr) -> None:
        self.out = out

    def event(self, stage: str, what: str, **facts) -> None:
        if what == "done":
            number = STAGES.index(stage) + 1
            print(f"[{number}/{len(STAGES)}] {stage}: {facts.get('seconds', 0):.1f} s", file=self.out, flush=True)


class Timed:
    """with Timed(observer, stage): start and end of a stage with its seconds."""

    def __init__(self, observer: Observer, stage: str) -> None:
        self.observer, self.stage = observer, stage

    def __enter__(self) -> Timed:
        self.began = time.perf_counter()
        self.observer.event(self.stage, "start")
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None:
            self.observer.event(self.stage, "done", seconds=round(time.perf_counter() - self.began, 3))
