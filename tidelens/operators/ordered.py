"""Computations along time: rolling bands, anomaly regions, outliers, sample rate.

All use dense row positions (rowindex), so that no window runs over an unpartitioned table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms, finite
from .rowindex import chunked, rows_around, with_row_index
from .stats import column_quantiles, long_form, order_statistics, quantiles

#: Below this a spread counts as none.
EPSILON = 2.220446049250313e-16


def rolling_bands(df: DataFrame, ts: str, column: str, window: int = 50, *order: str, by: str | None = None) -> DataFrame:
    """Mean, mean +- std and mean +- 2 std (population) of the finite values in centred frames, cut at the ends.

    (window - 1) // 2 rows on each side; frames with fewer than two values give null. by: frames hold rows of one value of
    that column only, which comes first in the result.
    """
    half = (min(max(window, 2), 10_000) - 1) // 2
    groups = [by] if by else []
    rows = chunked(with_row_index(df, *groups, *(order or (ts,))), "i", half)
    frame, x = rows_around(half, half, by=groups), finite(F.col(column))
    mean, std = F.avg(x).over(frame), F.stddev_pop(x).over(frame)
    some = F.count(x).over(frame) >= 2
    keep = list(dict.fromkeys([*groups, ts, *order]))
    out = rows.select(*keep, "home", F.when(some, mean).alias("mean"), F.when(some, std).alias("std"))
    band = lambda k: (F.col("mean") + k * F.col("std"))
    return out.where("home").select(*keep, "mean", band(1).alias("upper1"), band(-1).alias("lower1"), band(2).alias("upper2"), band(-2).alias("lower2"))


def _regions(scored: DataFrame, ts: str) -> DataFrame:
    """Runs of neighbouring positions: the difference of position and rank is constant along a run."""
    flagged = with_row_index(scored, "i", name="j")
    return flagged.groupBy((F.col("i") - F.col("j")).alias("run")).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n"), F.min_by("score", "i").alias("score"), F.max("score").alias("max_score")
    ).drop("run")


def anomalies_zscore(df: DataFrame, ts: str, column: str, threshold: float = 3.0, *order: str) -> DataFrame:
    """Regions of consecutive rows with |z| > threshold; score is that of the first row, null values end a region."""
    x = finite(F.col(column))
    s = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("sd")).head()
    if s.n < 2 or s.sd < EPSILON:
        threshold, s_m, s_sd = float("inf"), 0.0, 1.0
    else:
        s_m, s_sd = s.m, s.sd
    placed = with_row_index(df, *(order or (ts,))).withColumn("score", F.abs((x - s_m) / F.lit(s_sd)))
    return _regions(placed.where(F.col("score") > threshold), ts)


def anomalies_iqr(df: DataFrame, ts: str, column: str, factor: float = 1.5, *order: str) -> DataFrame:
    """Regions beyond q1 - factor * iqr or q3 + factor * iqr; the score is the distance beyond, in iqr."""
    x = finite(F.col(column))
    _, (q1, q3) = column_quantiles(df, F.col(column), [0.25, 0.75])
    iqr = (q3 - q1) if q1 is not None else 0.0
    if iqr < EPSILON:
        q1, q3, iqr, factor = 0.0, 0.0, 1.0, float("inf")
    low, high = q1 - factor * iqr, q3 + factor * iqr
    beyond = F.when(x < low, (low - x) / F.lit(iqr)).when(x > high, (x - high) / F.lit(iqr))
    return _regions(with_row_index(df, *(order or (ts,))).withColumn("score", beyond).where("score is not null"), ts)


def _good(x: Column, low: Column, high: Column) -> Column:
    """Nulls stay, non-finite values go."""
    return x.isNull() | F.coalesce(finite(x).between(low, high), F.lit(False))


def remove_outliers(df: DataFrame, columns: list[str], method: str = "zscore", threshold: float | None = None) -> DataFrame:
    """Rows that are no outlier in any column, by z-score (3) or interquartile range (1.5); a flat column judges nothing."""
    threshold = threshold if threshold is not None else {"zscore": 3.0, "iqr": 1.5}[method]
    if method == "zscore":
        values = [finite(F.col(c)) for c in columns]
        row = df.agg(*[s.alias(f"s{i}") for i, s in enumerate(f(x) for x in values for f in (F.count, F.avg, F.stddev_pop))]).head()
        found = {c: row[3 * k : 3 * k + 3] for k, c in enumerate(columns)}
    else:
        found = {c: (r["n"], *q) for c, (r, q) in quantiles(long_form(df, columns), [0.25, 0.75]).items()}
    for c in columns:
        n, a, b = found.get(c, (0, None, None))
        if n < 2 or (b if method == "zscore" else b - a) < EPSILON:
            continue
        low, high = (a - threshold * b, a + threshold * b) if method == "zscore" else (a - threshold * (b - a), b + threshold * (b - a))
        df = df.where(_good(F.col(c), F.lit(low), F.lit(high)))
    return df


def remove_outliers_windowed(df: DataFrame, column: str, window: int = 50, method: str = "zscore", threshold: float | None = None, *order: str) -> DataFrame:
    """As remove_outliers, but against the rows around each: (max(window, 4) - 1) // 2 on each side, four finite values at least."""
    threshold = threshold if threshold is not None else {"zscore": 3.0, "iqr": 1.5}[method]
    half = (max(window, 4) - 1) // 2
    rows = chunked(with_row_index(df, *order), "i", half)
    x, frame = finite(F.col(column)), rows_around(half, half)
    n = F.count(x).over(frame)
    if method == "zscore":
        mean, sd = F.avg(x).over(frame), F.stddev_pop(x).over(frame)
        bad = (sd > EPSILON) & (F.abs(x - mean) > threshold * sd)
    else:
        q1, q3 = F.percentile(x, 0.25).over(frame), F.percentile(x, 0.75).over(frame)
        bad = (x < q1 - threshold * (q3 - q1)) | (x > q3 + threshold * (q3 - q1))
    judged = rows.withColumn("bad", F.coalesce((n >= 4) & bad, F.lit(False)))
    return judged.where("home and not bad").select(*df.columns)


def sample_rate(df: DataFrame, ts: str) -> DataFrame:
    """hz: 1000 over the upper median of the positive gaps in milliseconds; 1 without gaps."""
    return rate_of(with_row_index(df.where(F.col(ts).isNotNull()).select(ts), ts), ts)


def rate_of(placed: DataFrame, ts: str) -> DataFrame:
    """sample_rate() of rows that have an index i along ts."""
    rows = chunked(placed.select("i", epoch_ms(F.col(ts)).alias("t")), "i", 1)
    gaps = rows.withColumn("x", F.col("t") - F.lag("t").over(Window.partitionBy("chunk").orderBy("i"))).where("home and x > 0")
    middle = lambda _, n: [n // 2]
    found = order_statistics(gaps.select(F.lit("gap").alias("series"), F.col("x").cast("double").alias("x")), [0.5], middle)
    hz = next((1000.0 / at[r["n"] // 2] for r, at in found.values() if r["n"]), 1.0)
    return placed.sparkSession.createDataFrame([(hz,)], "hz double")


def sort_stage(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Nulls first either way."""
    return df.orderBy(F.col(column).desc_nulls_first() if descending else F.col(column).asc_nulls_first())
