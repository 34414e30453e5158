"""Bounds of requests and the errors that they raise before anything is planned."""

from __future__ import annotations

import datetime
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


# The bounds that requests have.
@dataclass(frozen=True)
class Limits:
    width: tuple[int, int] = (1, 20_000)
    buckets: tuple[int, int] = (1, 10_000)
    scatter: tuple[int, int] = (1, 5_000_000)
    scatter_head: int = 200_000
    columns: int = 100
    upload_bytes: int = 512 << 20
    expression: int = 500
    table_rows: int = 1_000_000
    query_log: int = 512


LIMITS = Limits()


def within(name: str, value: int, bounds: tuple[int, int]) -> int:
    if not bounds[0] <= value <= bounds[1]:
        raise ValueError(f"{name} must be between {bounds[0]} and {bounds[1]}, not {value}")
    return value


def window(start: datetime.datetime, end: datetime.datetime) -> None:
    if start >= end:
        raise ValueError("the start of a time window must precede its end")


def positive(name: str, value: int | float) -> None:
    if value <= 0:
        raise ValueError(f"{name} must be positive, not {value}")


def upload(size: int, limits: Limits = LIMITS) -> None:
    if size > limits.upload_bytes:
        raise ValueError(f"{size} bytes exceed the limit of {limits.upload_bytes}")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def numeric_columns(df: DataFrame, names: list[str], limits: Limits = LIMITS) -> list[str]:
    """The names without repetitions; an error for none, too many, unknown or non-numeric ones."""
    names = list(dict.fromkeys(n.strip() for n in names if n.strip()))
    if not names:
        raise ValueError("at least one column is needed")
    if len(names) > limits.columns:
        raise ValueError(f"at most {limits.columns} columns are allowed")
    for n in names:
        if n not in df.columns:
            raise ValueError(f"unknown column {n!r}")
        if not is_numeric(df.schema[n].dataType):
            raise ValueError(f"column {n!r} is not numeric")
    return names


class RateLimiter:
    """At most `most` requests of a client in each window of time, which begins with its first request."""

    def __init__(self, most: int, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.most, self.seconds, self.clock = most, max(seconds, 1.0), clock
        self.windows: dict[str, tuple[float, int]] = {}

    def check(self, client: str) -> tuple[bool, int, int | None]:
        """Whether a request may go on, how many more may follow, and the seconds to wait if not."""
        now = self.clock()
        self.windows = {c: w for c, w in self.windows.items() if now - w[0] < self.seconds}
        began, n = self.windows.get(client, (now, 0))
        if n >= self.most:
            return False, 0, max(int(self.seconds - (now - began)), 1)
        self.windows[client] = (began, n + 1)
        return True, self.most - n - 1, None


class Counters:
    """Requests, errors, cache hits and milliseconds, by name."""

    def __init__(self) -> None:
        self.values: dict[str, float] = {}

    def add(self, name: str, amount: float = 1) -> None:
        self.values[name] = self.values.get(name, 0) + amount

    def ratio(self, part: str, rest: str) -> float:
        total = self.values.get(part, 0) + self.values.get(rest, 0)
        return self.values.get(part, 0) / total if total else 0.0


#: HTTP status for what an analysis may raise.
STATUS = {ValueError: 400, KeyError: 400, FileNotFoundError: 404, PermissionError: 403, TimeoutError: 504}


def status_of(error: BaseException) -> int:
    return next((code for kind, code in STATUS.items() if isinstance(error, kind)), 500)
