"""Two-sample tests, and drift of a column over time windows against a reference window."""

from __future__ import annotations

import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, epoch_ms, finite, instant
from ..functions.special import ks_tail
from ..plans.scratch import settled
from .rowindex import with_row_index, with_running_sums
from .stats import QUANTILES, edge_bin

#: Window lengths in milliseconds by name; fewest values of a window that is tested; most reference values of a test by permutation.
WINDOWS, LEAST, ES_REFERENCE = {"hourly": 3_600_000, "daily": 86_400_000, "weekly": 604_800_000}, 5, 400
#: Least share of a bin; PSI of a red and a yellow level; the KS threshold that is reported only.
FLOOR, RED, YELLOW, KS_LEVEL = 1e-10, 0.2, 0.1, 0.05


def two_samples(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """v, side (0 and 1) of both samples' finite values."""
    pick = lambda df, s: df.select(finite(F.col(column)).alias("v"), F.lit(s).alias("side")).where("v is not null")
    return pick(a, 0).unionByName(pick(b, 1))


def _cumulative(samples: DataFrame) -> tuple[DataFrame, int, int]:
    by = samples.groupBy("v").agg(F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("c0"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("c1"))
    n = samples.agg(F.sum((F.col("side") == 0).cast("long")), F.sum((F.col("side") == 1).cast("long"))).head()
    return with_running_sums(by, "v", {"f0": "c0", "f1": "c1"}, following="next"), n[0] or 0, n[1] or 0


def ks(samples: DataFrame, corrected: bool = True) -> DataFrame:
    """n0, n1, d, p. corrected: Stephens' small-sample form; else the plain series. Empty samples: 0 and 1, or NaN."""
    table, n0, n1 = _cumulative(samples)
    if not n0 or not n1:
        nothing = (0.0, 1.0) if corrected else (math.nan, math.nan)
        return samples.sparkSession.createDataFrame([(n0, n1, *nothing)], "n0 long, n1 long, d double, p double")
    d = table.agg(F.max(F.abs(F.col("f0") / n0 - F.col("f1") / n1)).alias("d"))
    n0c, n1c = F.lit(float(n0)), F.lit(float(n1))
    if corrected:
        p = ks_tail(F.col("d"), n0c, n1c)
    else:
        z = F.col("d") * F.sqrt(n0c * n1c / (n0c + n1c))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2 * k * k * z * z))
        p = F.least(F.lit(1.0), F.abs(2 * series))
    return d.select(F.lit(n0).cast("long").alias("n0"), F.lit(n1).cast("long").alias("n1"), "d", p.alias("p"))


def wasserstein(samples: DataFrame) -> DataFrame:
    """w: the area between both distribution functions."""
    table, n0, n1 = _cumulative(samples)
    gap = F.abs(F.col("f0") / max(n0, 1) - F.col("f1") / max(n1, 1)) * (F.col("next") - F.col("v"))
    return table.agg(F.coalesce(F.sum(gap), F.lit(0.0)).alias("w"))


def psi_terms(c: Column, r: Column) -> Column:
    """One bin's part of the population stability index, from both shares."""
    c, r = F.greatest(c, F.lit(FLOOR)), F.greatest(r, F.lit(FLOOR))
    return (c - r) * F.log(c / r)


def psi(samples: DataFrame, edges: list[float]) -> DataFrame:
    """psi of side 1 against side 0 over the bins of the edges."""
    bins = samples.select(edge_bin(F.col("v"), edges).alias("bin"), "side").where("bin is not null")
    by = bins.groupBy("bin").agg(F.sum((F.col("side") == 0).cast("long")).alias("r"), F.sum((F.col("side") == 1).cast("long")).alias("c"))
    grid = samples.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    n = bins.agg(F.sum((F.col("side") == 0).cast("long")), F.sum((F.col("side") == 1).cast("long"))).head()
    r, c = F.coalesce("r", F.lit(0)) / max(n[0] or 0, 1), F.coalesce("c", F.lit(0)) / max(n[1] or 0, 1)
    return grid.join(by, "bin", "left").agg(F.greatest(F.sum(psi_terms(c, r)), F.lit(0.0)).alias("psi"))


def es_statistic(samples: DataFrame, points: int = 64) -> DataFrame:
    """Epps-Singleton-like distance: mean squared gap of both characteristic functions on a grid, weighted by exp(-t*t/2)."""
    s = samples.agg(F.stddev_pop("v").alias("sd"), F.sum((F.col("side") == 0).cast("long")).alias("n"), F.sum((F.col("side") == 1).cast("long")).alias("m")).head()
    if not s.n or not s.m:
        return samples.sparkSession.createDataFrame([(0.0,)], "es double")
    top = min(5 / s.sd, 50.0) if s.sd > 0 else 50.0
    grid = [top * (k + 1) / points for k in range(points)]
    mean = lambda f, t, side: F.avg(F.when(F.col("side") == side, f(F.col("v") * t)))
    cells = [F.pow(mean(F.cos, t, 0) - mean(F.cos, t, 1), F.lit(2.0)) + F.pow(mean(F.sin, t, 0) - mean(F.sin, t, 1), F.lit(2.0)) for t in grid]
    total = cells[0] * math.exp(-grid[0] ** 2 / 2)
    for cell, t in zip(cells[1:], grid[1:], strict=True):
        total = total + cell * math.exp(-(t**2) / 2)
    return samples.agg((total / points * (s.n * s.m / (s.n + s.m))).alias("es"))


def es_test(a: np.ndarray, b: np.ndarray, seed: int = 42) -> tuple[float, float]:
    """The same statistic for small samples, and its p-value by seeded permutations."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, 1.0
    points, rounds = (16, 20) if n + m > 50 else (64, 200)
    both, rng = np.concatenate((a, b)), np.random.default_rng(seed)
    sd = both.std()
    t = min(5 / sd, 50.0) * np.arange(1, points + 1) / points if sd > 0 else 50.0 * np.arange(1, points + 1) / points
    e, w = np.exp(1j * np.outer(both, t)), np.exp(-(t**2) / 2)
    stat = lambda order: float((np.abs(e[order[:n]].mean(axis=0) - e[order[n:]].mean(axis=0)) ** 2 * w).mean() * n * m / (n + m))
    found = stat(np.arange(n + m))
    more = sum(stat(rng.permutation(n + m)) >= found for _ in range(rounds))
    return found, (more + 1) / (rounds + 1)


def reference_edges(placed: DataFrame, n: int, bins: int) -> tuple[list[float], bool]:
    """Quantile edges without repetitions, or equal-width ones (and True) if too few are left. placed: v with its index i."""
    wanted = sorted({int((n - 1) * i / bins + 0.5) for i in range(bins + 1)})
    edges = sorted({r.v for r in placed.where(F.col("i").isin(wanted)).collect()})
    if len(edges) >= 2 and len(edges) >= bins / 2 + 2:
        return edges, False
    low, high = edges[0], edges[-1]
    high = high if high > low else low + 1
    return [low + (high - low) * i / bins for i in range(bins + 1)], True


def level(w: Column, psi_: Column, threshold: float) -> Column:
    return F.when((w > threshold) | (psi_ >= RED), "red").when(psi_ >= YELLOW, "yellow").otherwise("green")


def against_reference(counts: DataFrame, sizes: DataFrame, reference: DataFrame, placed: DataFrame, n: int) -> DataFrame:
    """w, ks, wasserstein of each window (counts: w, v, c; sizes: w, nw) against a reference (v, r; placed: v with index i).

    On the values of both, running sums give the reference's distribution function F and its integral at any value, so a
    window needs them at its own values only. Between two of these its own function g is constant; F - g is largest at one
    end, and where F crosses g inside, it does so at the reference's value of rank g * n, which the index has.
    """
    own = counts.select("v").distinct().withColumn("r", F.lit(0).cast("long"))
    both = reference.select("v", "r").union(own).groupBy("v").agg(F.sum("r").alias("r"))
    sums = with_running_sums(both.withColumn("vr", F.col("v") * F.col("r")), "v", {"upto": "r", "total": "vr"})
    at_value = sums.select("v", (F.col("upto") / n).alias("f"), ((F.col("upto") - F.col("r")) / n).alias("f0"), ((F.col("v") * F.col("upto") - F.col("total")) / n).alias("area"))
    at_value = settled(at_value, "reference")
    ends = at_value.where("f >= 1").agg(F.min(F.struct("v", "area")).alias("e")).head()
    top, top_area = (ends.e["v"], ends.e["area"]) if ends.e else (0.0, 0.0)
    order = Window.partitionBy("w").orderBy("v")
    rows = counts.join(sizes, "w").join(at_value, "v")
    rows = rows.withColumn("seen", F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"g": F.col("seen") / F.col("nw"), "first": F.row_number().over(order) == 1, **{f"next_{c}": F.lead(c).over(order) for c in ("v", "f0", "area")}})
    rows = settled(rows, "windows")
    above, below = F.col("f") >= F.col("g"), F.col("next_f0") <= F.col("g")
    rise, flat = F.col("next_area") - F.col("area"), F.col("g") * (F.col("next_v") - F.col("v"))
    plain = rows.where("next_v is null or f >= g or next_f0 <= g")
    gap = F.greatest(F.abs(F.col("f") - F.col("g")), F.abs(F.coalesce(F.col("next_f0"), F.lit(1.0)) - F.col("g")), F.when(F.col("first"), F.col("f0")).otherwise(0.0))
    before = F.when(F.col("first"), F.col("area")).otherwise(0.0)
    after = F.when(F.col("v") < top, (top - F.col("v")) - (top_area - F.col("area"))).otherwise(0.0)
    inside = F.when(F.col("next_v").isNull(), after).when(above, rise - flat).when(below, flat - rise)
    part = plain.select("w", gap.alias("ks"), (inside + before).alias("wasserstein"))
    crossing = rows.where("next_v is not null and f < g and next_f0 > g").withColumn("rank", F.ceil(F.col("g") * n - 1e-9).cast("long") - 1)
    met = crossing.join(placed.select(F.col("i").alias("rank"), F.col("v").alias("cv")), "rank").join(at_value.select(F.col("v").alias("cv"), F.col("area").alias("carea")), "cv")
    up_to, beyond = F.col("carea") - F.col("area"), F.col("next_area") - F.col("carea")
    middle = F.col("g") * (F.col("cv") - F.col("v")) - up_to + beyond - F.col("g") * (F.col("next_v") - F.col("cv"))
    part = part.union(met.select("w", gap, middle + before))
    return part.groupBy("w").agg(F.max("ks").alias("ks"), F.sum("wasserstein").alias("wasserstein"))


def drift(df: DataFrame, ts: str, column: str, window: str, start: Any, end: Any, bins: int = 20, threshold: float | None = None, permutations: bool = True) -> DataFrame:
    """A row per window from the reference's end to the last time: counts, moments, KS, Wasserstein, PSI, Epps-Singleton, level.

    Windows are aligned to the epoch; those without rows are there too. The last time itself is in no window, the
    reference's end on both sides. Windows of fewer than 5 values are not tested (0, 1, 0, 1, 0, 0).
    """
    size, bins = WINDOWS[window], min(max(bins, 4), 50)
    t = epoch_ms(F.col(ts))
    rows = df.select(F.col(ts), t.alias("t"), finite(F.col(column)).alias("v"))
    ref = rows.where(F.col(ts).between(at(start), at(end))).where("v is not null").select("v")
    s = ref.agg(F.count("v").alias("n"), F.stddev_pop("v").alias("sd")).head()
    if s.n < LEAST:
        raise ValueError(f"the reference has {s.n} values, fewer than {LEAST}")
    threshold = threshold if threshold is not None else max(0.1 * s.sd, 1e-9)
    placed = with_row_index(ref, "v")
    edges, fallback = reference_edges(placed, s.n, bins)
    last = rows.agg(F.max("t")).head()[0]
    from_ms = int((instant(end) - instant(0)).total_seconds() * 1000)
    current = rows.where((F.col(ts) >= at(end)) & (F.col("t") < last)).withColumn("w", F.floor(F.col("t") / size).cast("long"))
    spark = df.sparkSession
    grid = spark.range(from_ms // size, max(last - 1, from_ms) // size + 1).select(F.col("id").alias("w"))
    stats = current.groupBy("w").agg(
        F.count("v").alias("n"), F.sum(F.col("v").isNull().cast("long")).alias("nulls"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    tested = stats.where(F.col("n") >= LEAST).select("w", F.col("n").alias("nw"))
    counts = current.where("v is not null").groupBy("w", "v").agg(F.count("*").alias("c"))
    gaps = against_reference(counts, tested, placed.groupBy("v").agg(F.count("*").alias("r")), placed, s.n)
    # PSI: the reference's shares are computed once.
    shares = {r.bin: r.n for r in ref.select(edge_bin(F.col("v"), edges).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    ref_rows = spark.createDataFrame([(i, shares.get(i, 0) / total) for i in range(len(edges) - 1)], "bin int, r double")
    binned = current.select("w", edge_bin(F.col("v"), edges).alias("bin")).where("bin is not null").groupBy("w", "bin").agg(F.count("*").alias("c"))
    inside = binned.groupBy("w").agg(F.sum("c").alias("inside"))
    cells = tested.select("w").crossJoin(F.broadcast(ref_rows)).join(binned, ["w", "bin"], "left").join(inside, "w", "left")
    psis = cells.groupBy("w").agg(F.greatest(F.sum(psi_terms(F.coalesce("c", F.lit(0)) / F.greatest(F.coalesce("inside", F.lit(1)), F.lit(1)), F.col("r"))), F.lit(0.0)).alias("psi"))
    out = grid.join(stats, "w", "left").join(gaps, "w", "left").join(psis, "w", "left")
    if permutations:
        step = max(-(-s.n // ES_REFERENCE), 1)
        thin = np.array([r.v for r in placed.where(F.col("i") % step == 0).collect()])  # at most ES_REFERENCE values

        def test(part: pd.DataFrame) -> pd.DataFrame:
            es, p = es_test(thin, part["v"].dropna().to_numpy())
            return pd.DataFrame({"w": [part["w"].iloc[0]], "es": [es], "es_p": [p]})

        out = out.join(current.join(tested.select("w"), "w", "left_semi").select("w", "v").groupBy("w").applyInPandas(test, "w long, es double, es_p double"), "w", "left")
    else:
        out = out.withColumns({"es": F.lit(None).cast("double"), "es_p": F.lit(None).cast("double")})
    n = F.coalesce("n", F.lit(0))
    ok = n >= LEAST
    ks_p = F.when(ok, ks_tail(F.col("ks"), F.lit(float(s.n)), F.when(ok, n.cast("double")).otherwise(1.0)))
    w_, p_ = F.coalesce("wasserstein", F.lit(0.0)), F.coalesce("psi", F.lit(0.0))
    return out.select(
        (F.col("w") * size).alias("window_ms"), F.date_format(F.timestamp_millis(F.col("w") * size), "yyyy-MM-dd").alias("label"), n.cast("long").alias("n"),
        F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"), F.when(n + F.coalesce("nulls", F.lit(0)) > 0, n / F.greatest(n + F.coalesce("nulls", F.lit(0)), F.lit(1))).otherwise(1.0).alias("completeness"),
        "mean", "std", "min", "max", F.coalesce("ks", F.lit(0.0)).alias("ks"), F.coalesce(ks_p, F.lit(1.0)).alias("ks_p"), w_.alias("wasserstein"), p_.alias("psi"),
        F.coalesce("es", F.lit(0.0)).alias("es"), F.coalesce("es_p", F.lit(1.0)).alias("es_p"), F.when(ok, level(w_, p_, threshold)).otherwise("green").alias("level"),
        F.lit(threshold).alias("threshold"), F.lit(fallback).alias("equal_width"), F.lit(len(edges) - 1).alias("bins"), (n < LEAST).alias("low_sample"),
    )


def window_distributions(df: DataFrame, ts: str, column: str, window: str, start: Any, end: Any, bins: int = 20, points: int = 200) -> dict[str, DataFrame]:
    """What each of drift()'s windows looks like: quantiles (w, q, x: nearest rank), histogram (w, bin, n: over the bins of the
    reference) and ecdf (w, x, y: every step-th value, step = max(n // points, 1)). Windows without values have no rows.

    One sort by window and value places every value in its window; no window is in one task.
    """
    size, bins = WINDOWS[window], min(max(bins, 4), 50)
    rows = df.select(F.col(ts), epoch_ms(F.col(ts)).alias("t"), finite(F.col(column)).alias("v")).where("v is not null")
    reference = with_row_index(rows.where(F.col(ts).between(at(start), at(end))).select("v"), "v")
    n = reference.count()
    if n < LEAST:
        raise ValueError(f"the reference has {n} values, fewer than {LEAST}")
    edges, _ = reference_edges(reference, n, bins)
    last = df.agg(F.max(epoch_ms(F.col(ts)))).head()[0]
    current = rows.where((F.col(ts) >= at(end)) & (F.col("t") < last)).select(F.floor(F.col("t") / size).cast("long").alias("w"), "v")
    placed = with_row_index(current, "w", "v")
    sizes = placed.groupBy("w").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    inside = placed.join(F.broadcast(sizes), "w").select("w", "v", "n", (F.col("i") - F.col("first")).alias("at"))
    wanted = F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.floor(F.lit(q) * (F.col("n") - 1) + 0.5).alias("at")) for q in QUANTILES]))
    asked = sizes.select("w", wanted.alias("p")).select("w", "p.q", "p.at")
    histogram = current.select("w", edge_bin(F.col("v"), edges).alias("bin")).where("bin is not null").groupBy("w", "bin").agg(F.count("*").alias("n"))
    step = F.greatest(F.floor(F.col("n") / points), F.lit(1))
    return {
        "quantiles": inside.join(F.broadcast(asked), ["w", "at"]).select("w", "q", F.col("v").alias("x")),
        "histogram": histogram,
        "ecdf": inside.where(F.col("at") % step == 0).select("w", F.col("v").alias("x"), ((F.col("at") + 1) / F.col("n")).alias("y")),
    }


def drift_metadata(windows: DataFrame, reference_rows: int) -> DataFrame:
    """Windows, their mean number of values among those tested, whether the reference is over 10 times as large, and how many
    bins there are in effect."""
    mean = F.avg(F.when(~F.col("low_sample"), F.col("n")))
    return windows.agg(F.count("*").alias("windows"), mean.alias("mean_n"), F.coalesce(F.lit(reference_rows) / F.when(mean > 0, mean) > 10, F.lit(False)).alias("unbalanced"), F.sum(F.col("low_sample").cast("long")).alias("low_sample"), F.max("bins").alias("effective_bins"), F.coalesce(F.max("equal_width"), F.lit(False)).alias("bin_warning"))


def order_windows(windows: DataFrame, by: str = "time") -> DataFrame:
    """time: ascending; psi: descending; severity: red, yellow, green, then psi, then the latest."""
    rank = F.when(F.col("level") == "red", 2).when(F.col("level") == "yellow", 1).otherwise(0)
    keys = {"time": [F.asc("window_ms")], "psi": [F.desc("psi"), F.asc("window_ms")], "severity": [rank.desc(), F.desc("psi"), F.desc("window_ms")]}
    return windows.orderBy(*keys[by])
