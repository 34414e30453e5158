"""Writing results: Parquet, Arrow streams, JSON columns, CSV."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms
from ..operators.filters import apply_filters, project


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def export_series(df: DataFrame, ts: str, columns: list[str], path: str, **filters) -> None:
    to_parquet(project(apply_filters(df, ts, **filters), [ts, *columns]), path)


def export_scatter(df: DataFrame, ts: str, columns: list[str | None], path: str, **filters) -> None:
    to_parquet(project(apply_filters(df, ts, **filters), [c for c in columns if c]), path)


#: Rows that a result for one reader may have; larger ones are written as files.
MOST_ROWS = 5_000_000


def _small(df: DataFrame, most: int) -> pa.Table:
    table = df.limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} rows: write them with to_parquet() or to_csv()")
    return table


def to_arrow_stream(df: DataFrame, ts: str | None = None, most: int = MOST_ROWS) -> bytes:
    """An Arrow IPC stream of a reduced (small) result, with its time in milliseconds."""
    table = _small(df, most)
    if ts:
        table = table.set_column(table.column_names.index(ts), ts, table[ts].cast(pa.timestamp("ms"), safe=False))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def to_json_columns(df: DataFrame, ts: str, columns: list[str], colour: str | None = None, most: int = MOST_ROWS) -> str:
    """{ts: [ms], values: {column: [...]}, color, color_column} of a reduced (small) result; a missing number is NaN."""
    table = _small(df.select(epoch_ms(F.col(ts)).alias("__t"), *dict.fromkeys([*columns, *([colour] if colour else [])])), most)
    values = {c: [math.nan if v is None else v for v in table[c].to_pylist()] for c in columns}
    return json.dumps({"ts": table["__t"].to_pylist(), "values": values, "color": table[colour].to_pylist() if colour else None, "color_column": colour})


def long_rows(df: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """A row per time and series."""
    return df.select(ts, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(ts, columns, "series", "value")


def to_csv(df: DataFrame, path: str, ts: str | None = None, long: list[str] | None = None) -> None:
    out = long_rows(df, ts, long) if long else df
    out.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").option("header", True).csv(path)
