"""Spectra, spectrograms and brick-wall filters of evenly sampled series.

The transform runs over at most max_points rows that a stride keeps, so its input is bounded; frames of a spectrogram are
groups of their own and run in parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms, from_ms, zero_filled
from .ordered import rate_of, sample_rate
from .rowindex import strided, with_row_index

#: Most points of a spectrum, a spectrogram and a filter; the default window of a spectrogram.
FFT_POINTS, STFT_POINTS, FILTER_POINTS, STFT_WINDOW = 8192, 32_768, 16_384, 256
PRESETS = [64, 128, 256, 512, 1024, 2048]


def amplitudes(x: np.ndarray) -> np.ndarray:
    """|FFT| / n under a symmetric Hann window after removing the mean, doubled but for the first bin and bin n // 2."""
    n = len(x)
    hann = 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    out = np.abs(np.fft.rfft((x - x.mean()) * hann)) / n
    out[1 : n // 2] *= 2
    return out


def _resampled_rate(hz: float, rows: int, limit: int) -> float:
    return hz / max(rows // limit, 1)


def _thinned(rows: DataFrame, ts: str, limit: int, *order: str) -> tuple[DataFrame, float, int]:
    """Every step-th row with its index, the sample rate of what is left, and the number of all rows: one sort for all of it."""
    order = order or (ts,)
    placed = with_row_index(rows, *order)
    n = placed.count()
    known = placed.where(F.col(ts).isNotNull())  # nulls come first, so they leave no gap
    rate = rate_of(known, ts) if order[0] == ts else sample_rate(rows, ts)
    return strided(placed, limit), _resampled_rate(rate.head()[0], n, limit), n


def spectrum(df: DataFrame, ts: str, columns: list[str], max_points: int = FFT_POINTS, *order: str) -> DataFrame:
    """series, bin, frequency, magnitude, power for each column; fewer than 4 rows give none."""
    max_points = max(max_points, 64)
    rows = df.select(*dict.fromkeys([ts, *order, *columns]))
    thin, hz, _ = _thinned(rows, ts, max_points, *order)
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), zero_filled(F.col(c)).alias("x")) for c in columns])
    long = thin.select("i", F.explode(pairs).alias("p")).select("i", "p.series", "p.x")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("i")["x"].to_numpy()
        n = len(x)
        m = amplitudes(x) if n >= 4 else np.zeros(0)
        k = np.arange(len(m))
        return pd.DataFrame({"series": part["series"].iloc[0], "bin": k.astype("int32"), "frequency": k * hz / max(n, 1), "magnitude": m, "power": m**2})

    return long.groupBy("series").applyInPandas(run, "series string, bin int, frequency double, magnitude double, power double")


def dominant_peaks(spectra: DataFrame, k: int = 5) -> DataFrame:
    """The k bins of largest magnitude of each series, the first bin excepted, ranked from 1."""
    w = Window.partitionBy("series").orderBy(F.desc("magnitude"), "bin")
    good = spectra.where((F.col("bin") >= 1) & (F.col("magnitude") > 0) & ~F.isnan("magnitude"))
    return good.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def spectrogram(df: DataFrame, ts: str, column: str, window: int = STFT_WINDOW, hop: int | None = None, max_points: int = STFT_POINTS, *order: str) -> DataFrame:
    """frame, t_ms (time at the frame's middle), bin, frequency, magnitude; frames reach fully into the series."""
    window = min(max(window, 16), 4096)
    hop = min(max(hop or window // 2, 1), window)
    max_points = max(max_points, 256)
    rows = df.select(*dict.fromkeys([ts, *order, column]))
    thin, hz, every = _thinned(rows, ts, max_points, *order)
    n = min(-(-every // max(every // max_points, 1)), max_points)
    placed = thin.withColumn("i", F.floor(F.col("i") / max(every // max_points, 1)))
    if n < window:
        raise ValueError(f"{n} rows are fewer than a window of {window}")
    last = (n - window) // hop
    lo, hi = F.greatest(F.ceil((F.col("i") - window + 1) / hop), F.lit(0)), F.least(F.floor(F.col("i") / hop), F.lit(last))
    frames = placed.select("i", epoch_ms(F.col(ts)).alias("t"), zero_filled(F.col(column)).alias("x"), F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))).alias("frame"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        m = amplitudes(part["x"].to_numpy())
        k = np.arange(len(m))
        return pd.DataFrame({"frame": part["frame"].iloc[0], "t_ms": part["t"].iloc[window // 2], "bin": k.astype("int32"), "frequency": k * hz / window, "magnitude": m})

    return frames.groupBy("frame").applyInPandas(run, "frame long, t_ms long, bin int, frequency double, magnitude double")


def keep_band(x: np.ndarray, hz: float, kind: str, low: float | None, high: float | None) -> np.ndarray:
    """x with only the wanted frequencies; the mean is kept."""
    mean = x.mean()
    f = np.fft.rfftfreq(len(x), 1 / hz)
    low, high = 0.0 if low is None else low, hz / 2 if high is None else high
    keep = {"lowpass": f <= high, "highpass": f >= low, "bandpass": (f >= low) & (f <= high), "bandstop": (f < low) | (f > high)}[kind]
    return np.fft.irfft(np.fft.rfft(x - mean) * keep, len(x)) + mean


def spectral_filter(df: DataFrame, ts: str, column: str, kind: str, low_hz: float | None = None, high_hz: float | None = None, max_points: int = FILTER_POINTS, *order: str) -> DataFrame:
    """ts, original, filtered; lowpass, highpass, bandpass or bandstop with inclusive band ends."""
    max_points = min(max(max_points, 64), 65_536)
    rows = df.select(*dict.fromkeys([ts, *order, column]))
    thin, hz, n = _thinned(rows, ts, max_points, *order)
    if n < 4:
        raise ValueError("a filter needs 4 rows")
    thin = thin.select("i", epoch_ms(F.col(ts)).alias("t"), zero_filled(F.col(column)).alias("original"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("i")
        part["filtered"] = keep_band(part["original"].to_numpy(), hz, kind, low_hz, high_hz)
        return part[["t", "original", "filtered"]]

    return thin.groupBy(F.lit("all")).applyInPandas(run, "t long, original double, filtered double").select(from_ms(F.col("t")).alias(ts), "original", "filtered")


def dft(rows: DataFrame, index: str, value: str, n: int) -> DataFrame:
    """The same amplitudes by sums of sines and cosines, one aggregate per bin; for short series and for checks."""
    mean = rows.agg(F.avg(value)).head()[0]
    hann = 0.5 * (1 - F.cos(F.lit(2 * np.pi) * F.col(index) / (n - 1)))
    x = (F.col(value) - mean) * hann
    angle = lambda k: F.col(index) * k % n * F.lit(2 * np.pi / n)
    sums = [s for k in range(n // 2 + 1) for s in (F.sum(x * F.cos(angle(k))).alias(f"c{k}"), F.sum(x * F.sin(angle(k))).alias(f"s{k}"))]
    one = rows.agg(*sums)
    cells = [F.struct(F.lit(k).alias("bin"), (F.sqrt(F.pow(f"c{k}", F.lit(2.0)) + F.pow(f"s{k}", F.lit(2.0))) / n * (1 if k in (0, n // 2) else 2)).alias("magnitude")) for k in range(n // 2 + 1)]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


# --- display ------------------------------------------------------------------------------------


def decibels(magnitude: Column) -> Column:
    return 20 * F.log10(F.greatest(magnitude, F.lit(1e-12)))


def from_decibels(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def near_nyquist(frequency: Column, hz: float) -> Column:
    """Whether a frequency may be an alias: beyond 0.8 of half the sample rate."""
    return frequency > 0.8 * hz / 2


def frequency_label(hz: Column) -> Column:
    fmt = lambda x, unit: F.concat(F.format_number(x, 2), F.lit(unit))
    return F.when(hz >= 1000, fmt(hz / 1000, " kHz")).when(hz >= 1, fmt(hz, " Hz")).when(hz >= 0.001, fmt(hz * 1000, " mHz")).otherwise(fmt(hz * 1e6, " µHz"))


def suggest_preset(frequency: float, hz: float, current: int) -> int:
    """A longer window for frequencies below a tenth of half the rate, a shorter one beyond half of it."""
    share, at = frequency / (hz / 2), min(range(len(PRESETS)), key=lambda i: abs(PRESETS[i] - current))
    return PRESETS[min(at + 1, len(PRESETS) - 1)] if share < 0.1 else PRESETS[max(at - 1, 0)] if share > 0.5 else PRESETS[at]
