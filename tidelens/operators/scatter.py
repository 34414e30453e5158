"""Scatter queries: filtered pairs with colour and size."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.limits import LIMITS, is_numeric, is_temporal
from .filters import apply_filters, project
from .reduce import downsample_pairs, head_rows
from .stats import as_number, clean_label


def scatter_frame(df: DataFrame, x: str, y: str, colour: str | None = None, size: str | None = None) -> DataFrame:
    """The distinct columns of x, y, colour and size; x and y must be numbers or times."""
    for c in (x, y):
        kind = df.schema[c].dataType
        if not (is_numeric(kind) or is_temporal(kind)):
            raise ValueError(f"column {c!r} is neither numeric nor temporal")
    return project(df, [c for c in (x, y, colour, size) if c])


def clamp_limit(limit: int | None) -> int:
    low, high = LIMITS.scatter
    return min(min(max(1_000_000 if limit is None else limit, low), high), LIMITS.scatter_head)


def scatter_points(df: DataFrame, ts: str, x: str, y: str, colour: str | None = None, size: str | None = None, limit: int | None = None, *order: str, sample: int | None = None, **filters: Any) -> DataFrame:
    """x, y, and colour and size if asked for, of the first rows in order that have both x and y.

    Colour is a number where its column is one or a time, else a label. Gaps in colour stay aligned with their points.
    sample: at most so many of these points, which keep the shape of y along the order.
    """
    rows = head_rows(apply_filters(df, ts, **filters), clamp_limit(limit), *(order or (ts,)))
    out = [as_number(df, x).alias("x"), as_number(df, y).alias("y")]
    if colour:
        kind = df.schema[colour].dataType
        out.append((as_number(df, colour) if is_numeric(kind) or is_temporal(kind) else clean_label(F.col(colour))).alias("colour"))
    if size:
        out.append(as_number(df, size).alias("size"))
    if sample is None:
        return rows.select(*out).where("x is not null and y is not null")
    keys = list(order or (ts,))
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    points = rows.select(*out, *named).where("x is not null and y is not null")
    return downsample_pairs(points, "y", sample, *[f"__k{i}" for i in range(len(keys))]).drop(*[f"__k{i}" for i in range(len(keys))])


def scatter_summary(points: DataFrame) -> DataFrame:
    """Points, and the extent of colour and size where they are numbers."""
    made = [F.count("*").alias("points")]
    for c in ("colour", "size"):
        if c in points.columns and is_numeric(points.schema[c].dataType):
            made += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return points.agg(*made)
