"""The dataset under analysis, its revisions, its cache and the log of its queries."""

from __future__ import annotations

import time
from collections import OrderedDict, deque
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from .limits import LIMITS


@dataclass(frozen=True)
class Dataset:
    """An immutable table with a time column; a change makes a new one of the next revision."""

    df: DataFrame
    ts: str
    revision: int = 0

    def replaced(self, df: DataFrame) -> Dataset:
        return replace(self, df=df, revision=(self.revision + 1) % (1 << 64))

    def rows(self) -> int:
        return self.df.count()


@dataclass
class ResultCache:
    """Results by (revision, request): they age, and the oldest go when there are too many or they are too large."""

    seconds: float = 60.0
    entries: int = 128
    bytes: int = 32 << 20
    held: OrderedDict[Hashable, tuple[float, int, Any]] = field(default_factory=OrderedDict)
    clock: Callable[[], float] = time.monotonic

    def get(self, key: Hashable) -> Any | None:
        found = self.held.get(key)
        if found and self.clock() - found[0] <= self.seconds:
            return found[2]
        self.held.pop(key, None)
        return None

    def put(self, key: Hashable, value: Any, size: int = 0) -> None:
        self.held.pop(key, None)
        self.held[key] = (self.clock(), size, value)
        while len(self.held) > self.entries or sum(s for _, s, _ in self.held.values()) > self.bytes:
            self.held.popitem(last=False)

    def clear(self) -> None:
        self.held.clear()


@dataclass
class QueryLog:
    """The latest queries, numbered from 1."""

    entries: deque = field(default_factory=lambda: deque(maxlen=LIMITS.query_log))
    number: int = 0

    def add(self, name: str, **details: Any) -> int:
        self.number += 1
        self.entries.append({"id": self.number, "name": name, **details})
        return self.number

    def drain(self) -> list[dict[str, Any]]:
        out = list(self.entries)
        self.entries.clear()
        return out
