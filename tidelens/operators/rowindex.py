"""Order across partitions without pulling all rows into one task.

Rows are range-partitioned and sorted once; what a partition needs from those before it (how many rows, which sums) is one
small row per partition, gathered and added up on the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scratch import settled

_BITS = 33


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    return settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")


def with_row_index(df: DataFrame, *order: Column | str, name: str = "i") -> DataFrame:
    """df with a dense index from 0 in the given total order; null keys come first unless order says otherwise."""
    placed = _ranged(df, list(order))
    part = F.shiftright("__id", _BITS)
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    parts = sorted(counts)
    before = dict(zip(parts, accumulate([0, *(counts[p] for p in parts)]), strict=False))
    if not parts:
        return placed.withColumn(name, F.lit(0).cast("long")).drop("__id")
    offset = F.element_at(F.map_from_arrays(F.lit(parts), F.lit([before[p] for p in parts])), part.cast("int"))
    return placed.withColumn(name, F.col("__id") - F.shiftleft(part, _BITS) + offset.cast("long")).drop("__id")


def with_running_sums(df: DataFrame, order: str, sums: dict[str, Column | str], following: str | None = None) -> DataFrame:
    """df with inclusive running sums along a unique numeric order column, and (following) the next row's order value."""
    placed = _ranged(df.withColumns({f"__{k}": F.expr(v) if isinstance(v, str) else v for k, v in sums.items()}), [order])
    placed = placed.withColumn("__p", F.shiftright("__id", _BITS).cast("int"))
    per = sorted(placed.groupBy("__p").agg(F.min(order).alias("first"), *[F.sum(f"__{k}").alias(k) for k in sums]).collect(), key=lambda r: r["__p"])
    own = Window.partitionBy("__p").orderBy(order)
    at = lambda values: F.element_at(F.map_from_arrays(F.lit([r["__p"] for r in per]), F.array(*[F.lit(v) for v in values])), F.col("__p"))
    out = placed
    if not per:
        return placed.select(*df.columns, *[F.col(f"__{k}").alias(k) for k in sums], *([F.col(order).alias(following)] if following else []))
    for k in sums:
        before = list(accumulate([0 * per[0][k], *(r[k] for r in per)]))[:-1]
        out = out.withColumn(k, F.sum(f"__{k}").over(own) + at(before))
    if following:
        later = [*(r["first"] for r in per[1:]), None]
        out = out.withColumn(following, F.coalesce(F.lead(order).over(own), at(later)))
    return out.select(*df.columns, *sums, *([following] if following else []))


def chunked(df: DataFrame, index: str, half: int, size: int = 1 << 20) -> DataFrame:
    """df in chunks of neighbouring rows, each with `half` further rows on both sides: chunk, and home (not a copy)."""
    size = max(size, 4 * half, 1)
    home = F.floor(F.col(index) / size)
    last = F.floor((F.col(index) + half) / size)
    first = F.floor(F.greatest(F.col(index) - half, F.lit(0)) / size)
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn("home", F.col("chunk") == home)


def rows_around(half_before: int, half_after: int, index: str = "i", by: list[str] | None = None):
    return Window.partitionBy("chunk", *(by or [])).orderBy(index).rowsBetween(-half_before, half_after)


def stride(df: DataFrame, limit: int, *order: Column | str, index: str = "i") -> DataFrame:
    """Every step-th row, step = max(rows // limit, 1), and `limit` of them at most; the index stays."""
    return strided(with_row_index(df, *order, name=index), limit, index)


def strided(placed: DataFrame, limit: int, index: str = "i") -> DataFrame:
    """stride() of rows that have their index already."""
    step = max(placed.count() // limit, 1)
    return placed.where((F.col(index) % step == 0) & (F.col(index) / step < limit))
