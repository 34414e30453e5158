"""Requests as a user makes them: each validates, plans over the current dataset, and logs itself."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from ..functions.columns import instant
from ..operators import drift, expr, filters, ordered, reduce, scatter, spectral, stats
from ..operators.causal import discovery
from . import limits
from .dataset import Dataset, QueryLog, ResultCache
from .scratch import settled


class Explorer:
    """One dataset and the analyses over it."""

    def __init__(self, dataset: Dataset):
        self.dataset, self.cache, self.log = dataset, ResultCache(), QueryLog()

    @property
    def df(self) -> DataFrame:
        return self.dataset.df

    def _run(self, name: str, **details: Any) -> str:
        self.log.add(name, revision=self.dataset.revision, **details)
        return self.dataset.ts

    def replace(self, df: DataFrame) -> Dataset:
        """A new revision; cached results no longer hold."""
        self.dataset = self.dataset.replaced(df)
        self.cache.clear()
        return self.dataset

    def data(self, start: Any, end: Any, width: int, columns: str = "") -> DataFrame:
        limits.window(instant(start), instant(end))
        limits.within("width", width, limits.LIMITS.width)
        names = limits.numeric_columns(self.df, filters.parse_columns(columns))
        ts, key = self.dataset.ts, (self.dataset.revision, "data", str(start), str(end), width, tuple(names))
        self._run("data", columns=names)
        if (held := self.cache.get(key)) is None:
            made = reduce.minmax_lttb(filters.filter_time_range(self.df, ts, start, end, names), ts, names, 2 * width)
            table = made.toArrow()  # 2 * width rows a column at most
            held = self.df.sparkSession.createDataFrame(table, made.schema)
            self.cache.put(key, held, table.nbytes)
        return held

    def aggregate(self, start: Any, end: Any, columns: str = "", mode: str = "bucket", buckets: int = 100, how: str = "mean", size_ms: int = reduce.WINDOW_MS, step_ms: int | None = None) -> DataFrame:
        limits.window(instant(start), instant(end))
        names = limits.numeric_columns(self.df, filters.parse_columns(columns))
        ts = self._run("aggregate", columns=names, mode=mode)
        rows = filters.filter_time_range(self.df, ts, start, end, names)
        if mode == "bucket":
            limits.within("buckets", buckets, limits.LIMITS.buckets)
            return reduce.bucket_aggregate(rows, ts, names, buckets, how)
        limits.positive("window", size_ms)
        limits.positive("step", step_ms or size_ms)
        return reduce.sliding_aggregate(rows, ts, names, size_ms, size_ms if mode == "tumbling" else step_ms, how)

    def metadata(self) -> dict[str, DataFrame]:
        ts = self._run("metadata")
        names = [*stats.numeric_columns(self.df), ts]
        return {"profile": stats.profile(self.df), "range": stats.time_range(self.df, ts), "histograms": stats.histogram(self.df, list(dict.fromkeys(names)))}

    def scatter(self, x: str, y: str, **options: Any) -> DataFrame:
        return scatter.scatter_points(self.df, self._run("scatter", x=x, y=y), x, y, **options)

    def correlations(self, base: str | None = None, threshold: float = 0.7) -> DataFrame:
        ts = self._run("correlations", base=base)
        return stats.correlation_suggestions(self.df, stats.numeric_columns(self.df), base, threshold, ts)

    def correlation_matrix(self) -> DataFrame:
        self._run("correlation_matrix")
        return stats.correlation_matrix(self.df, stats.numeric_columns(self.df))

    def rolling(self, column: str, window: int = 50) -> DataFrame:
        return ordered.rolling_bands(self.df, self._run("rolling", column=column), column, window)

    def anomalies(self, column: str, method: str = "zscore", threshold: float | None = None) -> DataFrame:
        ts = self._run("anomalies", column=column, method=method)
        if method == "iqr":
            return ordered.anomalies_iqr(self.df, ts, column, 1.5 if threshold is None else threshold)
        return ordered.anomalies_zscore(self.df, ts, column, 3.0 if threshold is None else threshold)

    def fft(self, columns: list[str], max_points: int = spectral.FFT_POINTS) -> DataFrame:
        return spectral.spectrum(self.df, self._run("fft", columns=columns), columns, max_points)

    def spectrogram(self, column: str, **options: Any) -> DataFrame:
        return spectral.spectrogram(self.df, self._run("spectrogram", column=column), column, **options)

    def spectral_filter(self, column: str, kind: str, **options: Any) -> DataFrame:
        return spectral.spectral_filter(self.df, self._run("spectral_filter", column=column, kind=kind), column, kind, **options)

    def drift(self, column: str, window: str, start: Any, end: Any, **options: Any) -> DataFrame:
        return drift.drift(self.df, self._run("drift", column=column, window=window), column, window, start, end, **options)

    def causal(self, columns: list[str], **options: Any) -> DataFrame:
        ts = self._run("causal", columns=columns)
        return discovery.causal_links(self.df, columns, order=(ts,), **options)

    def transform(self, expression: str, output: str) -> Dataset:
        ts = self._run("transform", expression=expression, output=output)
        return self.replace(expr.transform(self.df, expression, output, ts))

    def remove_outliers(self, columns: list[str], method: str = "zscore", threshold: float | None = None, window: int | None = None) -> dict[str, Any]:
        """Replaces the dataset; rows before, after and removed."""
        ts = self._run("remove_outliers", columns=columns, method=method)
        before, df = self.dataset.rows(), self.df
        if window is None:
            df = ordered.remove_outliers(df, columns, method, threshold)
        else:
            for c in columns:
                df = ordered.remove_outliers_windowed(df, c, window, method, threshold, ts)
        df = settled(df, "cleaned")
        after = self.replace(df).rows()
        return {"method": method + ("" if window is None else "_windowed"), "before": before, "after": after, "removed": before - after}
