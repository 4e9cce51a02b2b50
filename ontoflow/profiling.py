"""A tree of timings: nested steps, wall-clock milliseconds, rendered as rows."""

from __future__ import annotations

import time
from contextlib import contextmanager
from dataclasses import dataclass, field


@dataclass
class Step:
    name: str
    ms: float = 0.0
    children: list["Step"] = field(default_factory=list)
    notes: dict = field(default_factory=dict)

    def rows(self, depth: int = 0) -> list[dict]:
        """The step and all below it, each with its own share beside the children's."""
        own = {"depth": depth, "name": self.name, "ms": round(self.ms, 3), "own_ms": round(self.ms - sum(c.ms for c in self.children), 3), **self.notes}
        return [own, *(r for c in self.children for r in c.rows(depth + 1))]


class Profiler:
    """``with profiler.step("name")`` around Spark actions; steps nest as the blocks do."""

    def __init__(self, name: str = "total"):
        self.root = Step(name)
        self._open = [self.root]

    @contextmanager
    def step(self, name: str, **notes):
        own = Step(name, notes=notes)
        self._open[-1].children.append(own)
        self._open.append(own)
        began = time.perf_counter()
        try:
            yield own
        finally:
            own.ms = (time.perf_counter() - began) * 1000
            self._open.pop()
            self.root.ms = sum(c.ms for c in self.root.children)
