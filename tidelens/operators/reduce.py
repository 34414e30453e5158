"""Reductions of a time series: buckets, windows, strides, head rows, shape-preserving downsampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms, finite, from_ms
from ..plans.limits import LIMITS
from .rowindex import stride, with_row_index

AGGREGATES = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}

#: Candidates that the first stage of the downsampling leaves for each wanted point, and the default window.
MINMAX_RATIO, WINDOW_MS = 4, 60_000


def aggregate(name: str, x: Column) -> Column:
    """An aggregate by name; an unknown name means the mean. Nulls do not count; counts are doubles."""
    out = AGGREGATES.get(name, F.avg)(x)
    return out.cast("double")


def _span(df: DataFrame, ts: str) -> tuple[int, int] | None:
    low, high = df.agg(F.min(epoch_ms(F.col(ts))), F.max(epoch_ms(F.col(ts)))).head()
    return None if low is None else (low, high)


def bucket_aggregate(df: DataFrame, ts: str, columns: list[str], buckets: int, how: str = "mean") -> DataFrame:
    """Equal-width buckets over the data's own time range; ts is a bucket's middle, empty buckets are left out.

    One pass for the range, one hash aggregation with partial sums; rows of null time are left out.
    """
    buckets = min(max(buckets, LIMITS.buckets[0]), LIMITS.buckets[1])
    low, high = _span(df, ts) or (0, 0)
    width = max(high - low, 1) / buckets
    number = F.least(F.greatest(F.floor((epoch_ms(F.col(ts)) - low) / F.lit(width)), F.lit(0)), F.lit(buckets - 1))
    out = df.where(F.col(ts).isNotNull()).groupBy(number.alias("bucket")).agg(*[aggregate(how, F.col(c)).alias(c) for c in columns])
    middle = F.floor(F.lit(low) + (F.col("bucket") + 0.5) * F.lit(width))
    return out.select(from_ms(middle).alias(ts), *columns)


def sliding_aggregate(df: DataFrame, ts: str, columns: list[str], size_ms: int = WINDOW_MS, step_ms: int | None = None, how: str = "mean") -> DataFrame:
    """Windows [s, s + size) from the first time on, every step; ts is s + size // 2, windows without rows are left out.

    Only finite values count; a window without any gives null, also as a count. A row is copied to each of the
    size / step windows that hold it, none where the step leaves a gap.
    """
    step_ms = step_ms or size_ms
    low, _ = _span(df, ts) or (0, 0)
    since = epoch_ms(F.col(ts)) - low
    last = F.floor(since / step_ms)
    rows = df.where(F.col(ts).isNotNull())
    if size_ms == step_ms:
        rows = rows.withColumn("k", last)
    else:
        first = F.greatest(F.floor((since - size_ms) / step_ms) + 1, F.lit(0))
        rows = rows.withColumn("k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    made = [F.when(F.count(finite(F.col(c))) > 0, aggregate(how, finite(F.col(c)))).alias(c) for c in columns]
    return rows.groupBy("k").agg(*made).select(from_ms(F.lit(low) + F.col("k") * step_ms + size_ms // 2).alias(ts), *columns)


def tumbling_aggregate(df: DataFrame, ts: str, columns: list[str], size_ms: int = WINDOW_MS, how: str = "mean") -> DataFrame:
    return sliding_aggregate(df, ts, columns, size_ms, size_ms, how)


def aggregate_by_time(df: DataFrame, ts: str, column: str, how: str = "mean") -> DataFrame:
    """One row per distinct time."""
    return df.groupBy(ts).agg(aggregate(how, F.col(column)).alias(column))


def _bucket_of(df: DataFrame, ts: str, buckets: int) -> Column:
    low, high = _span(df, ts) or (0, 0)
    width = max(high - low, 1) / buckets
    return F.least(F.floor((epoch_ms(F.col(ts)) - low) / F.lit(width)), F.lit(buckets - 1))


def ohlc(df: DataFrame, ts: str, column: str, buckets: int) -> DataFrame:
    """First, highest, lowest and last value of each equal-width bucket."""
    return df.groupBy(_bucket_of(df, ts, buckets).alias("bucket")).agg(
        F.min_by(column, ts).alias("open"), F.max(column).alias("high"), F.min(column).alias("low"), F.max_by(column, ts).alias("close")
    )


def stride_downsample(df: DataFrame, limit: int, *order: str) -> DataFrame:
    """Rows 0, step, 2*step, ..., at most `limit`; the tail is cut where the count is no multiple."""
    return stride(df, limit, *order).drop("i")


def head_rows(df: DataFrame, limit: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def largest_triangles(index: np.ndarray, y: np.ndarray, target: int) -> np.ndarray:
    """Places of the points that largest-triangle-three-buckets keeps: the ends, and one of each bucket between."""
    n = len(index)
    if n <= target or target < 3:
        return np.arange(n)
    edges = np.linspace(1, n - 1, target - 1).astype(int)
    kept, last = [0], 0
    for b in range(target - 2):
        lo, hi = edges[b], max(edges[b + 1], edges[b] + 1)
        ahead = slice(edges[b + 1], max(edges[b + 2] if b + 2 < len(edges) else n, edges[b + 1] + 1)) if b + 1 < target - 2 else slice(n - 1, n)
        cx, cy = index[ahead].mean(), y[ahead].mean()
        area = np.abs((index[last] - cx) * (y[lo:hi] - y[last]) - (index[last] - index[lo:hi]) * (cy - y[last]))
        last = lo + int(area.argmax())
        kept.append(last)
    return np.array([*kept, n - 1])


def shape_rows(placed: DataFrame, y: Column, n: int, target: int) -> DataFrame:
    """At most `target` of n rows (indexed by i from 0) that keep the shape of y (Van Der Donckt et al. 2023).

    Bins of equally many rows first leave their lowest and highest; on those few rows, with all their columns, one task
    chooses the largest triangles. Places count, not times.
    """
    bins = max(1, target * MINMAX_RATIO // 2)
    inner = placed.where((F.col("i") > 0) & (F.col("i") < n - 1))
    extremes = inner.groupBy(F.floor((F.col("i") - 1) * bins / (n - 2)).alias("bin")).agg(F.array(F.min_by("i", F.struct(y, "i")), F.max_by("i", F.struct(y, -F.col("i")))).alias("at"))
    ends = placed.sparkSession.createDataFrame([(0,), (n - 1,)], "i long")
    few = extremes.select(F.explode("at").alias("i")).union(ends)  # 4 * target and two at most
    rows = placed.join(F.broadcast(few.distinct()), "i", "left_semi")
    columns = rows.columns

    def pick(part: pa.Table) -> pa.Table:
        index = part.column("i").to_numpy()
        order = np.argsort(index)
        at = largest_triangles(index[order].astype(float), part.column("__y").to_numpy()[order], target)
        return part.take(pa.array(order[at])).select(columns)

    return rows.withColumn("__y", y).groupBy(F.lit("all")).applyInArrow(pick, rows.schema)


def minmax_lttb(df: DataFrame, ts: str, columns: list[str], target: int, *order: str) -> DataFrame:
    """At most `target` rows that keep the first column's shape, in time order.

    A null value stands as 0. Few rows, or a target below 3, pass unchanged.
    """
    placed = with_row_index(df.select(*dict.fromkeys([ts, *columns, *[o for o in order if o in df.columns]])), *(order or (ts,)))
    n = placed.count()
    if n <= target or target < 3:
        return placed.select(ts, *columns)
    return shape_rows(placed, F.coalesce(F.col(columns[0]).cast("double"), F.lit(0.0)), n, target).orderBy("i").select(ts, *columns)


def downsample_pairs(points: DataFrame, y: str, target: int, *order: str) -> DataFrame:
    """At most `target` rows of points, in the given order, that keep the shape of y; colours and sizes stay with their points."""
    placed = with_row_index(points, *order)
    n = placed.count()
    if n <= target or target < 3:
        return points
    return shape_rows(placed, F.coalesce(F.col(y).cast("double"), F.lit(0.0)), n, target).drop("i")


def sampled(df: DataFrame, ts: str, column: str, buckets: int, mode: str) -> DataFrame:
    """A chart's sampling modes over equal-width buckets: average, max or min (bucket, value), or ohlc."""
    if mode == "ohlc":
        return ohlc(df, ts, column, buckets)
    how = {"average": F.avg, "max": F.max, "min": F.min}[mode]
    return df.groupBy(_bucket_of(df, ts, buckets).alias("bucket")).agg(how(finite(F.col(column))).alias("value"))


def reduce_series(df: DataFrame, ts: str, columns: list[str], strategy: str = "none", **options) -> DataFrame:
    """The reduction of a name: none, lttb (target), bucket (buckets, how), window (size_ms, step_ms, how)."""
    match strategy:
        case "lttb":
            return minmax_lttb(df, ts, columns, options["target"], *options.get("order", ()))
        case "bucket":
            return bucket_aggregate(df, ts, columns, options["buckets"], options.get("how", "mean"))
        case "window":
            return sliding_aggregate(df, ts, columns, options.get("size_ms", WINDOW_MS), options.get("step_ms"), options.get("how", "mean"))
        case "none":
            return df.select(ts, *columns)
    raise ValueError(f"unknown reduction {strategy!r}")

