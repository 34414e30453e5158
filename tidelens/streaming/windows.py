"""The time-window reductions over a stream: an extension for tables that still grow.

Windows are aligned to the epoch, since a stream's first time is not known beforehand; late rows count until the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.reduce import aggregate


def windowed(stream: DataFrame, ts: str, columns: list[str], size: str, step: str | None = None, how: str = "mean", late: str = "10 minutes", by: list[str] | None = None) -> DataFrame:
    """start, end, the grouping columns and the aggregates, for a stream or a table."""
    w = F.window(ts, size, step) if step else F.window(ts, size)
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    made = rows.groupBy(w.alias("w"), *(by or [])).agg(*[aggregate(how, F.col(c)).alias(c) for c in columns], F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(by or []), *columns, "n")


def sessions(stream: DataFrame, ts: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Sessions of rows of a key that follow each other within gap: start, end, rows."""
    rows = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    made = rows.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def to_parquet(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends closed windows; exactly once, as the file sink and the checkpoint give it."""
    return result.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
