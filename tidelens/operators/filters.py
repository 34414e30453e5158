"""Row predicates: time windows, value ranges, lines across the time-value plane."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import all_of, at, epoch_ms
from ..plans.limits import is_numeric, is_temporal


def time_between(ts: str, start: Any = None, end: Any = None) -> Column | None:
    """Both ends count; an end that is None is open; None for no bound at all."""
    return all_of([None if start is None else F.col(ts) >= at(start), None if end is None else F.col(ts) <= at(end)])


def value_between(column: str, low: float | None = None, high: float | None = None) -> Column | None:
    x = F.col(column)
    return all_of([None if low is None else x >= F.lit(low), None if high is None else x <= F.lit(high)])


def one_of(column: str, values: list[str]) -> Column:
    """Nulls are in no list."""
    return F.col(column).isin(values)


def not_null(column: str) -> Column:
    return F.col(column).isNotNull()


class Predicates:
    """Collects predicates that must all hold."""

    def __init__(self) -> None:
        self.parts: list[Column] = []

    def _add(self, part: Column | None) -> Predicates:
        self.parts += [] if part is None else [part]
        return self

    def time_range(self, ts: str, start: Any = None, end: Any = None) -> Predicates:
        return self._add(time_between(ts, start, end))

    def numeric_range(self, column: str, low: float | None = None, high: float | None = None) -> Predicates:
        return self._add(value_between(column, low, high))

    def is_null(self, column: str) -> Predicates:
        return self._add(F.col(column).isNull())

    def build(self) -> Column | None:
        return all_of(list(self.parts))

    def apply_to(self, df: DataFrame) -> DataFrame:
        whole = self.build()
        return df if whole is None else df.where(whole)


@dataclass(frozen=True)
class RangeFilter:
    column: str
    start: float
    end: float


@dataclass(frozen=True)
class LineFilter:
    column: str
    x1: float
    y1: float
    x2: float
    y2: float
    keep_above: bool = True


def _objects(text: str | None, allowed: set[str]) -> list[dict[str, Any]]:
    if not text or not text.strip():
        return []
    items = json.loads(text)
    if not isinstance(items, list) or any(not isinstance(x, dict) or set(x) - allowed for x in items):
        raise ValueError("filters are a JSON list of objects with known fields only")
    return items


def parse_range_filters(text: str | None) -> list[RangeFilter]:
    return [RangeFilter(x["column"], float(x["from"]), float(x["to"])) for x in _objects(text, {"column", "from", "to"})]


def parse_line_filters(text: str | None) -> list[LineFilter]:
    names = {"column", "x1", "y1", "x2", "y2", "keep_above", "keepAbove"}
    return [LineFilter(x["column"], *(float(x[k]) for k in ("x1", "y1", "x2", "y2")), x.get("keep_above", x.get("keepAbove", True))) for x in _objects(text, names)]


def parse_columns(text: str | None) -> list[str]:
    return [c.strip() for c in (text or "").split(",") if c.strip()] or ["value"]


def range_predicate(df: DataFrame, f: RangeFilter) -> Column:
    """Numeric columns compare as doubles, whole numbers with the whole numbers within, so that the comparison reaches the
    file scan; temporal ones take epoch milliseconds, floored at the start and ceiled at the end."""
    if f.column not in df.columns:
        raise ValueError(f"unknown column {f.column!r}")
    kind, (low, high) = df.schema[f.column].dataType, sorted((f.start, f.end))
    if is_temporal(kind):
        return F.col(f.column).between(at(math.floor(low)), at(math.ceil(high)))
    if not is_numeric(kind):
        raise ValueError(f"column {f.column!r} is neither numeric nor temporal")
    if isinstance(kind, T.IntegralType) and max(abs(low), abs(high)) < 2**53:
        return F.col(f.column).between(math.ceil(low), math.floor(high))
    return F.col(f.column).cast("double").between(low, high)


def line_predicate(ts: str, f: LineFilter, strict: bool = False, bounded: bool = True) -> Column | None:
    """Keeps what lies on the wanted side of a line; None if the line has no extent or no column.

    bounded: only rows between the line's ends are judged (a null value there goes); strict: the line itself goes too.
    """
    if f.x1 == f.x2 or not f.column.strip():
        return None
    t = epoch_ms(F.col(ts)).cast("double")
    line = F.lit(f.y1) + (t - F.lit(f.x1)) * F.lit((f.y2 - f.y1) / (f.x2 - f.x1))
    y = F.col(f.column).cast("double")
    good = (y > line if strict else y >= line) if f.keep_above else (y < line if strict else y <= line)
    return ~t.between(min(f.x1, f.x2), max(f.x1, f.x2)) | good if bounded else good


def apply_filters(df: DataFrame, ts: str, start: Any = None, end: Any = None, ranges: list[RangeFilter] | None = None, lines: list[LineFilter] | None = None) -> DataFrame:
    """All of them; the time window only if both its ends are given, in either order."""
    parts: list[Column | None] = []
    if start is not None and end is not None:
        parts.append(F.col(ts).between(*([at(start), at(end)] if _before(start, end) else [at(end), at(start)])))
    parts += [range_predicate(df, r) for r in ranges or []]
    for f in lines or []:
        if f.column.strip() and f.column not in df.columns:
            raise ValueError(f"unknown column {f.column!r}")
        parts.append(line_predicate(ts, f))
    whole = all_of(parts)
    return df if whole is None else df.where(whole)


def _before(a: Any, b: Any) -> bool:
    from ..functions.columns import instant

    return instant(a) <= instant(b)


def filter_time_range(df: DataFrame, ts: str, start: Any, end: Any, columns: list[str]) -> DataFrame:
    whole = time_between(ts, start, end)
    return project(df if whole is None else df.where(whole), [ts, *columns])


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column once, in the order given."""
    return df.select(*dict.fromkeys(columns))


def project_known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Those of the columns that df has; df itself if none."""
    known = [c for c in columns if c in df.columns]
    return project(df, known) if known else df


def client_range_filter(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Drops a row if any listed series is outside its bounds; NaN and null pass."""
    for c, (low, high) in bounds.items():
        x = F.col(c).cast("double")
        df = df.where(x.isNull() | F.isnan(x) | x.between(low, high))
    return df


def client_line_filter(df: DataFrame, ts: str, f: LineFilter) -> DataFrame:
    """Strict and without limit along time, as the browser does it."""
    part = line_predicate(ts, f, strict=True, bounded=False)
    return df if part is None else df.where(part)
