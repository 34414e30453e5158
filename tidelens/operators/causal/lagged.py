"""Lagged observations, as a DataFrame of any length or as a bounded matrix for the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ...functions.columns import finite
from ..rowindex import chunked, stride, with_row_index


def lag_frame(df: DataFrame, columns: list[str], tau_max: int, *order: str) -> DataFrame:
    """i and v{j}_l{k} for k = 0 .. 2 tau_max: only rows that have all their lags; gaps take the column's mean."""
    means = df.agg(*[F.avg(finite(F.col(c))).alias(f"m{j}") for j, c in enumerate(columns)]).head()
    placed = with_row_index(df.select(*dict.fromkeys([*order, *columns])), *order)
    rows = chunked(placed, "i", 2 * tau_max) if tau_max else placed.withColumns({"chunk": F.lit(0), "home": F.lit(True)})
    w = Window.partitionBy("chunk").orderBy("i")
    lags = [F.lag(F.coalesce(finite(F.col(c)), F.lit(means[j] or 0.0)), k).over(w).alias(f"v{j}_l{k}") if k else F.coalesce(finite(F.col(c)), F.lit(means[j] or 0.0)).alias(f"v{j}_l0") for j, c in enumerate(columns) for k in range(2 * tau_max + 1)]
    return rows.select("i", "home", *lags).where("home").drop("home").where(F.col("i") >= 2 * tau_max)


def gram(lagged: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums of products, sums and the row count of the columns: one row of partial sums per task, added up by columns."""
    d = len(names)

    def part(batches):
        total, sums, n = np.zeros((d, d)), np.zeros(d), 0
        for b in batches:
            x = b[names].to_numpy(float)
            total, sums, n = total + x.T @ x, sums + x.sum(axis=0), n + len(x)
        flat = np.concatenate((total.ravel(), sums, [n]))
        yield pd.DataFrame({"k": np.arange(len(flat)), "x": flat})

    out = np.zeros(d * d + d + 1)
    for r in lagged.select(*names).mapInPandas(part, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r.k] = r.x
    return out[: d * d].reshape(d, d), out[d * d : -1], int(out[-1])


@dataclass
class Series:
    """At most max_points rows of the columns, evenly spaced, gaps filled by the mean."""

    values: np.ndarray
    names: list[str]

    def at(self, var: int, lag: int, tau_max: int) -> np.ndarray:
        n = len(self.values)
        return self.values[2 * tau_max + lag : n + lag, var]


def bounded_series(df: DataFrame, columns: list[str], max_points: int = 5000, *order: str) -> Series:
    max_points = min(max(max_points, 100), 50_000)
    thin = stride(df.select(*dict.fromkeys([*order, *columns])), max_points, *order).orderBy("i")
    x = thin.select(*[finite(F.col(c)).alias(c) for c in columns]).toPandas().to_numpy(float)
    return Series(np.where(np.isnan(x), np.nan_to_num(np.nanmean(x, axis=0)) if len(x) else 0, x), columns)
