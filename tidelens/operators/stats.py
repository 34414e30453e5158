"""Profiles, histograms, quantiles, correlations, densities."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms, finite
from ..plans.limits import is_numeric, is_temporal
from .rowindex import with_row_index, with_running_sums

#: Bins of a histogram unless asked otherwise and their bounds; quantiles of a distribution; points of an ECDF and a KDE.
BINS, BIN_BOUNDS, QUANTILES, ECDF_POINTS, KDE_POINTS = 24, (2, 1000), (0.05, 0.25, 0.5, 0.75, 0.95), 200, 64
#: Relative accuracy of the first look that brackets exact quantiles, and values that the driver holds for them at most.
LOOK, HELD = 2000, 200_000
#: Different values whose ranks are added up on the driver at most (16 bytes each), and those that are broadcast.
RANKED, BROADCAST_VALUES = 1_000_000, 100_000
#: A denominator below this counts as zero.
EPSILON = 2.220446049250313e-16


def as_number(df: DataFrame, column: str) -> Column:
    """A column as a finite double; times as epoch milliseconds."""
    return epoch_ms(F.col(column)).cast("double") if is_temporal(df.schema[column].dataType) else finite(F.col(column))


def long_form(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row (series, x) for each value."""
    pairs = [F.struct(F.lit(c).alias("series"), as_number(df, c).alias("x")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.series", "p.x")


def numeric_columns(df: DataFrame, ts: str | None = None) -> list[str]:
    """Numeric columns in order of their names; the time column too if it is given."""
    return sorted(f.name for f in df.schema.fields if is_numeric(f.dataType) or f.name == ts)


# --- exact positions ----------------------------------------------------------------------------


def order_statistics(long: DataFrame, points: list[float], ranks: Callable[[float, int], list[int]], extra: list[Column] | None = None) -> dict[str, tuple[Row, dict[int, float]]]:
    """Of each series (rows series, x) a row of n and `extra` aggregates, and the values at given places of its sorted x.

    ranks: the places, from 0, near p * n for each point p. No value goes to one task: a first look brackets each place
    within 2 / LOOK, then rows in a bracket are counted by value and the others by where they lie, and only what lies in
    brackets reaches the driver. Where that is more than HELD, running sums of the values' counts take its place.
    """
    bounds = [b for p in points for b in (max(0.0, p - 2 / LOOK), min(1.0, p + 2 / LOOK))]
    looks = [F.count("x").alias("n"), F.min("x").alias("lo__"), F.max("x").alias("hi__"), F.percentile_approx("x", bounds, LOOK).alias("b__")]
    first = {r["series"]: r for r in long.groupBy("series").agg(*looks, *(extra or [])).collect()}
    there = [r for r in first.values() if r["n"]]
    wanted = {r["series"]: sorted({k for p in points for k in ranks(p, r["n"])}) for r in there}
    out = {name: (r, {}) for name, r in first.items()}
    brackets: dict[str, list[tuple[float, float]]] = {}
    for r in there:
        if r["n"] * len(there) <= HELD:
            brackets[r["series"]] = [(r["lo__"], r["hi__"])]
        elif 4 * r["n"] * len(points) * len(there) <= LOOK * HELD:
            own: list[tuple[float, float]] = []
            for a, b in sorted(zip(r["b__"][::2], r["b__"][1::2], strict=True)):
                own = [*own[:-1], (own[-1][0], max(b, own[-1][1]))] if own and a <= own[-1][1] else [*own, (a, b)]
            brackets[r["series"]] = own
    if brackets:
        x, slot, key = F.col("x"), F.lit(None).cast("int"), F.lit(None).cast("double")
        for name, own in brackets.items():
            mine = F.col("series") == name
            slot = F.when(mine, sum(((x > b).cast("int") for _, b in own), F.lit(0))).otherwise(slot)
            key = F.when(mine & reduce(lambda u, v: u | v, (x.between(a, b) for a, b in own)), x).otherwise(key)
        rows = long.where(x.isNotNull() & F.col("series").isin(*brackets)).groupBy("series", slot.alias("slot"), key.alias("key")).count()
        table = rows.toArrow().to_pandas().sort_values(["series", "slot", "key"], na_position="first")
        for name, part in table.groupby("series"):
            upto = part["count"].cumsum().to_numpy()
            at = part["key"].to_numpy()[np.searchsorted(upto, wanted[name], side="right")]
            if not np.isnan(at).any():
                out[name] = (first[name], dict(zip(wanted[name], at.tolist(), strict=True)))
    for name, places in wanted.items():
        if not out[name][1]:
            counts = long.where((F.col("series") == name) & F.col("x").isNotNull()).groupBy("x").agg(F.count("*").alias("c"))
            sums = with_running_sums(counts, "x", {"upto": "c"})
            row = sums.agg(*[F.min(F.when(F.col("upto") > k, F.col("x"))) for k in places]).head()
            out[name] = (first[name], dict(zip(places, row, strict=True)))
    return out


def _around(p: float, n: int) -> list[int]:
    return [int((n - 1) * p), min(int((n - 1) * p) + 1, n - 1)]


def quantiles(long: DataFrame, points: list[float], extra: list[Column] | None = None) -> dict[str, tuple[Row, list[float | None]]]:
    """Of each series a row of n and `extra` aggregates, and its quantiles by linear interpolation; None without values."""
    out = {}
    for name, (row, at) in order_statistics(long, points, _around, extra).items():
        n, found = row["n"], []
        for p in points if n else []:
            low, high = _around(p, n)
            share = (n - 1) * p - low
            found.append((1 - share) * at[low] + share * at[high])
        out[name] = (row, found or [None] * len(points))
    return out


def column_quantiles(df: DataFrame, column: Column, points: list[float], extra: list[Column] | None = None) -> tuple[Row | None, list[float | None]]:
    """quantiles() of one column's finite values."""
    long = df.select(F.lit("x").alias("series"), finite(column).alias("x"))
    return quantiles(long, points, extra).get("x", (None, [None] * len(points)))


# --- profiles -----------------------------------------------------------------------------------


def profile(df: DataFrame) -> DataFrame:
    """Per column in one pass: dtype, non_null, nulls, rows, and least and greatest of numbers and times."""
    made = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        x = as_number(df, f.name) if is_numeric(f.dataType) or is_temporal(f.dataType) else F.lit(None).cast("double")
        made += [F.count(c), F.min(x), F.max(x)]
    one = df.agg(F.count("*").alias("rows"), *[m.alias(f"m{i}") for i, m in enumerate(made)])
    rows = [
        F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"m{3 * i}").alias("non_null"),
            (F.col("rows") - F.col(f"m{3 * i}")).alias("nulls"), F.col("rows").alias("rows"),
            F.col(f"m{3 * i + 1}").alias("min"), F.col(f"m{3 * i + 2}").alias("max"),
        )
        for i, f in enumerate(df.schema.fields)
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def sorted_profile(profiled: DataFrame, by: str, descending: bool = False, name_part: str = "") -> DataFrame:
    """A profile filtered by a part of the column name and sorted; missing and non-finite values last."""
    kept = profiled.where(F.lower("column").contains(name_part.lower()))
    key = F.lower(by) if by in ("column", "dtype") else finite(F.col(by))
    return kept.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "column")


def time_range(df: DataFrame, ts: str) -> DataFrame:
    return df.agg(F.min(epoch_ms(F.col(ts))).alias("start_ms"), F.max(epoch_ms(F.col(ts))).alias("end_ms"))


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """series, n, min, max, mean, std (population) and quartiles by linear interpolation, of finite values."""
    found = quantiles(long_form(df, columns), [0.25, 0.5, 0.75], [F.avg("x").alias("mean"), F.stddev_pop("x").alias("std")])
    rows = [(name, r["n"], r["lo__"], r["hi__"], r["mean"], r["std"], *q) for name, (r, q) in found.items()]
    return df.sparkSession.createDataFrame(rows, "series string, n long, min double, max double, mean double, std double, q1 double, median double, q3 double")


def moments(df: DataFrame, column: str) -> DataFrame:
    """n, mean, std, iqr, skewness and excess kurtosis of the population; the last two null without spread."""
    flat = F.stddev_pop("x") > 0
    extra = [F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.when(flat, F.skewness("x")).alias("skewness"), F.when(flat, F.kurtosis("x")).alias("kurtosis")]
    found = quantiles(long_form(df, [column]), [0.25, 0.75], extra)
    rows = [(r["n"], r["mean"], r["std"], None if q[0] is None else q[1] - q[0], r["skewness"], r["kurtosis"]) for r, q in found.values()]
    return df.sparkSession.createDataFrame(rows or [(0, *[None] * 5)], "n long, mean double, std double, iqr double, skewness double, kurtosis double")


def box_stats(df: DataFrame, column: str, floor_index: bool = False) -> DataFrame:
    """least, q1, median, q3, greatest: by linear interpolation, or the values at floor(n * p)."""
    long, points = long_form(df, [column]), [0.25, 0.5, 0.75]
    if floor_index:
        places = lambda p, n: [int(n * p)]
        found = {name: (r, [at.get(int(r["n"] * p)) for p in points]) for name, (r, at) in order_statistics(long, points, places).items()}
    else:
        found = quantiles(long, points)
    rows = [(r["lo__"], *q, r["hi__"]) for r, q in found.values()]
    return df.sparkSession.createDataFrame(rows or [(None,) * 5], "low double, q1 double, median double, q3 double, high double")


# --- histograms ---------------------------------------------------------------------------------


def histogram(df: DataFrame, columns: list[str], bins: int = BINS, domain: tuple[float, float] | None = None) -> DataFrame:
    """series, bin, low, high, n for every bin; the greatest value is in the last. A series without spread has one bin.

    Two passes: the ranges, then counts with partial sums; a series without finite values has no rows.
    """
    bins = min(max(bins, BIN_BOUNDS[0]), BIN_BOUNDS[1])
    long = long_form(df, columns).where("x is not null")
    if domain:
        ranges = df.sparkSession.createDataFrame([(c, float(domain[0]), float(domain[1])) for c in columns], "series string, lo double, hi double")
        long = long.where(F.col("x").between(*domain))
    else:
        found = long.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
        ranges = df.sparkSession.createDataFrame([tuple(r) for r in found], "series string, lo double, hi double")
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.when(F.col("hi") > F.col("lo"), bins - 1).otherwise(0))))
    span = F.col("hi") - F.col("lo")
    number = F.when(span > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.when(span > 0, span) * bins), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = long.join(F.broadcast(ranges), "series").groupBy("series", number.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda i: F.when(span > 0, F.col("lo") + span * i / bins).otherwise(F.when(i == F.col("bin"), F.col("lo")).otherwise(F.col("hi")))
    return grid.join(counts, ["series", "bin"], "left").select("series", "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def edge_bin(x: Column, edges: list[float]) -> Column:
    """Number of the bin between given edges; a value on an inner edge is to its right, one on the last edge in the last bin."""
    last = len(edges) - 2
    at = reduce(lambda n, e: n + F.when(x >= e, 1).otherwise(0), edges[:-1], F.lit(-1))
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.least(at, F.lit(last)))


def histogram_edges(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    x = df.select(edge_bin(finite(F.col(column)), edges).alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(x, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def nearest_rank_quantiles(df: DataFrame, column: str, points: tuple[float, ...] = QUANTILES) -> DataFrame:
    """q, x: the value at round(q * (n - 1)), halves away from zero."""
    place = lambda q, n: [int(q * (n - 1) + 0.5)]
    found = order_statistics(df.select(F.lit("x").alias("series"), finite(F.col(column)).alias("x")), list(points), place)
    rows = [(q, at[place(q, r["n"])[0]]) for r, at in found.values() if r["n"] for q in points]
    return df.sparkSession.createDataFrame(rows, "q double, x double")


def ecdf(df: DataFrame, column: str, points: int = ECDF_POINTS) -> DataFrame:
    """x, y at every step-th of the sorted values, step = max(n // points, 1)."""
    placed = with_row_index(df.select(finite(F.col(column)).alias("x")).where("x is not null"), "x")
    n = placed.count()
    step = max(n // points, 1)
    return placed.where(F.col("i") % step == 0).select("x", ((F.col("i") + 1) / F.lit(max(n, 1))).alias("y"))


def expand_histogram(counts: DataFrame, most: int = 320) -> DataFrame:
    """Middles of histogram bins (low, high, n), each as often as its share of at most `most` values."""
    total = counts.agg(F.sum("n")).head()[0] or 0
    scale = min(1.0, most / total) if total else 0.0
    times = F.when(F.col("n") > 0, F.greatest(F.lit(1), F.round(F.col("n") * scale))).otherwise(0).cast("int")
    return counts.select(F.explode(F.array_repeat((F.col("low") + F.col("high")) / 2, times)).alias("x"))


def kde(df: DataFrame, column: str, points: int = KDE_POINTS, plain: bool = False) -> DataFrame:
    """Gaussian density on an inclusive grid; bandwidth 0.9 * min(std, IQR / 1.34) * n ** -0.2, at least 0.001.

    plain: on the middles of equal intervals, with bandwidth 1.06 * std * n ** -0.2.

    The grid is part of each row's own partial sums: one aggregate per grid point, no join.
    """
    x = df.select(finite(F.col(column)).alias("x")).where("x is not null")
    row, (a, b) = column_quantiles(df, F.col(column), [0.25, 0.75], [F.stddev_pop("x").alias("sd")])
    if row is None or not row["n"]:
        return df.sparkSession.createDataFrame([], "k int, x double, density double")
    n, lo, hi = row["n"], row["lo__"], row["hi__"]
    if plain:
        h = max(1.06 * row["sd"] * n**-0.2, 1e-3)
        grid = [lo + (hi - lo) * (k + 0.5) / points for k in range(points)]
    else:
        h = max(0.9 * min(row["sd"], (b - a) / 1.34) * n**-0.2, 1e-3)
        grid = [lo + (hi - lo) * k / (points - 1) for k in range(points)]
    sums = x.agg(*[F.sum(F.exp(-0.5 * F.pow((F.col("x") - g) / h, F.lit(2.0)))).alias(f"k{k}") for k, g in enumerate(grid)])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(g).alias("x"), (F.col(f"k{k}") / (n * h * 2.5066282746310002)).alias("density")) for k, g in enumerate(grid)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def density_grid(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """Counts of an equal-width grid over the data's extent: bx, by, n; empty cells are left out."""
    pts = df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y")).where("x is not null and y is not null")
    e = pts.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / F.lit((hi - lo) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    if e[0] is None:
        return df.sparkSession.createDataFrame([], "bx int, by int, n long")
    return pts.groupBy(cell("x", e[0], e[1]).alias("bx"), cell("y", e[2], e[3]).alias("by")).agg(F.count("*").alias("n"))


def pixel_grid(df: DataFrame, x: str, y: str, view: tuple[float, float, float, float], width: int, height: int, cell: int = 8) -> DataFrame:
    """bx, by, n of squares of `cell` pixels in a viewport (x from, x to, y from, y to); points outside it are left out."""
    x0, x1, y0, y1 = view
    pts = df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y")).where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    at = lambda c, lo, hi, pixels: F.least(F.floor((F.col(c) - lo) / F.lit((hi - lo) or 1.0) * pixels / cell), F.lit(-(-pixels // cell) - 1)).cast("int")
    return pts.groupBy(at("x", x0, x1, width).alias("bx"), at("y", y0, y1, height).alias("by")).agg(F.count("*").alias("n"))


def shade(counts: DataFrame, mode: str = "linear") -> DataFrame:
    """density_grid's counts with a level from 0 to 1: linear, sqrt or log."""
    most = counts.agg(F.max("n")).head()[0] or 1
    n = F.col("n")
    level = {"linear": n / most, "sqrt": F.sqrt(n / most), "log": F.log1p(n) / F.log1p(F.lit(most))}[mode]
    return counts.withColumn("level", level)


def padded_bounds(df: DataFrame, columns: list[str], pad: float = 0.02) -> DataFrame:
    """series, low, high: the extent and a margin on both sides; without spread the margin is pad of 1."""
    by = long_form(df, columns).groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    room = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * pad
    return by.select("series", (F.col("lo") - room).alias("low"), (F.col("hi") + room).alias("high"))


# --- labels -------------------------------------------------------------------------------------


def clean_label(column: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit("Missing"))


def grouped_histogram(df: DataFrame, column: str, label: str, bins: int = BINS, most_groups: int = 8) -> DataFrame | None:
    """label, bin, n over the common range, if there are 2 to most_groups labels; else None."""
    rows = df.select(clean_label(F.col(label)).alias("label"), finite(F.col(column)).alias("x")).where("x is not null")
    found = rows.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).limit(most_groups + 1).collect()
    if not 2 <= len(found) <= most_groups:
        return None
    lo, hi = min(r.lo for r in found), max(r.hi for r in found)
    number = F.least(F.floor((F.col("x") - lo) / F.lit((hi - lo) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy("label", number.alias("bin")).agg(F.count("*").alias("n"))


def label_order(df: DataFrame, label: str, *order: str) -> DataFrame:
    """label, place (from 0): labels by the first row that has them."""
    rows = df.select(clean_label(F.col(label)).alias("label"), F.struct(*order).alias("at")).groupBy("label").agg(F.min("at").alias("at"))
    return rows.withColumn("place", (F.row_number().over(Window.orderBy("at")) - 1).cast("int")).drop("at")  # a row for each label


def colour_analysis(df: DataFrame, column: str, *order: str, sample: int = 1000) -> DataFrame:
    """From the first `sample` values whether a column is numeric, its extent, and how many categories it has."""
    head = df.orderBy(*order).limit(sample).select(F.col(column).cast("string").alias("s")).where("s is not null")
    x = F.expr("try_cast(s as double)")
    return head.select("s", x.alias("x")).agg(
        F.coalesce(F.count("x") == F.count("s"), F.lit(False)).cast("int").alias("numeric"), F.min("x").alias("low"), F.max("x").alias("high"), F.countDistinct("s").alias("categories")
    )


# --- correlation --------------------------------------------------------------------------------


def pearson_of(x: Column, y: Column) -> Column:
    """Pearson's r of the pairs in which both are there, as an aggregate; null for fewer than 2 pairs or no spread."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    spread = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    r = F.covar_pop(x, y) / F.when(spread > EPSILON, spread)
    return F.when((F.count(x) >= 2) & (spread > EPSILON), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(pearson_of(as_number(df, x), as_number(df, y)).alias("pearson"))


def _distributed(spark: SparkSession, table: pa.Table) -> DataFrame:
    """A table of many rows as a DataFrame of partitions; Spark would make rows of the plan of it."""
    name = "spark.sql.execution.arrow.localRelationThreshold"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "0")
    try:
        return spark.createDataFrame(table)
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def average_ranks(long: DataFrame, columns: list[str]) -> dict[str, DataFrame]:
    """For each series of long (series, x) a table v, r: its different values and their mean ranks, from 1.

    Ranks come from the values' counts, so no row is sorted; up to RANKED values are added up on the driver, more by running
    sums over partitions.
    """
    counts = long.where("x is not null").groupBy("series", "x").agg(F.count("*").alias("c"))
    spark, some = long.sparkSession, counts.limit(RANKED + 1).toArrow()
    if some.num_rows <= RANKED:
        out, name, x, c = {}, some.column("series").to_numpy(), some.column("x").to_numpy(), some.column("c").to_numpy()
        for column in columns:
            mine = np.flatnonzero(name == column)
            mine = mine[np.argsort(x[mine])]
            ranks = np.cumsum(c[mine]) - (c[mine] - 1) / 2
            table = _distributed(spark, pa.table({"v": x[mine], "r": ranks}))
            out[column] = F.broadcast(table) if len(mine) <= BROADCAST_VALUES else table
        return out
    sums = {c: with_running_sums(counts.where(F.col("series") == c).select("x", "c"), "x", {"upto": "c"}) for c in columns}
    return {c: t.select(F.col("x").alias("v"), (F.col("upto") - (F.col("c") - 1) / 2).alias("r")) for c, t in sums.items()}


def ranked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The ranks of columns (finite doubles without gaps) in place of their values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("x")) for c in columns])
    tables = average_ranks(df.select(F.explode(pairs).alias("p")).select("p.*"), columns)
    for i, c in enumerate(columns):
        df = df.join(tables[c].toDF(f"__v{i}", f"__r{i}"), F.col(c) == F.col(f"__v{i}"))
    return df.select(*[F.col(f"__r{i}").alias(c) for i, c in enumerate(columns)])


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson's r of average ranks over the pairs in which both are there."""
    pairs = df.select(as_number(df, x).alias("x"), as_number(df, y).alias("y")).where("x is not null and y is not null")
    return ranked(pairs, ["x", "y"]).agg(pearson_of(F.col("x"), F.col("y")).alias("spearman"))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> list[tuple[float | None, float | None]]:
    """Pearson's and Spearman's r of pairs of columns.

    All Pearson values come from one aggregate. Columns without gaps are ranked once, together, and one more aggregate has
    their Spearman values; a pair with gaps is ranked by itself, since its rows are its own.
    """
    if not pairs:
        return []
    columns = sorted({c for pair in pairs for c in pair})
    rows = df.select(*[as_number(df, c).alias(c) for c in columns])
    one = rows.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)], *[pearson_of(F.col(a), F.col(b)).alias(f"p{k}") for k, (a, b) in enumerate(pairs)]).head()
    whole = {c for i, c in enumerate(columns) if one[f"n{i}"] == one["rows"]}
    apart = [k for k, (a, b) in enumerate(pairs) if not {a, b} <= whole]
    together = [k for k in range(len(pairs)) if k not in set(apart)]
    found: dict[int, float | None] = {k: spearman(df, *pairs[k]).head()[0] for k in apart}
    if together:
        used = sorted({c for k in together for c in pairs[k]})
        ranks = ranked(rows.select(*used), used)
        row = ranks.agg(*[pearson_of(F.col(pairs[k][0]), F.col(pairs[k][1])) for k in together]).head()
        found |= dict(zip(together, row, strict=True))
    return [(one[f"p{k}"], found[k]) for k in range(len(pairs))]


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """col_i, col_j, pearson, spearman for all ordered pairs; the diagonal is 1."""
    columns = sorted(columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = [(c, c, 1.0, 1.0) for c in columns]
    for (a, b), found in zip(pairs, correlations(df, pairs), strict=True):
        rows += [(a, b, *found), (b, a, *found)]
    return df.sparkSession.createDataFrame(rows, "col_i string, col_j string, pearson double, spearman double")


def correlation_suggestions(df: DataFrame, columns: list[str], base: str | None = None, threshold: float = 0.7, ts: str | None = None) -> DataFrame:
    """column, pearson, spearman, strength against a base column, the strongest first, and whether it is suggested."""
    columns = sorted(columns)
    schema = "base string, column string, pearson double, spearman double, strength double, value double, suggested boolean"
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], schema)
    base, threshold = base or next(c for c in columns if c != ts), min(max(threshold, 0.0), 1.0)
    others, rows = [c for c in columns if c != base], []
    for c, (p, s) in zip(others, correlations(df, [(base, c) for c in others]), strict=True):
        strength = max(abs(p or 0.0), abs(s or 0.0))
        rows.append((base, c, p, s, strength, p if p is not None else s, strength >= threshold))
    return df.sparkSession.createDataFrame(rows, schema).orderBy(F.desc("strength"), "column")


def matrix_cells(df: DataFrame, columns: list[str], active: tuple[str, str] | None = None, suggested: list[str] | None = None) -> DataFrame:
    """All pairs of columns in the order in which a scatter matrix draws them: the active pair, suggestions, the diagonal, the rest."""
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "name string, n int")
    a, b = names.toDF("x", "i"), names.toDF("y", "j")
    active, suggested = active or ("", ""), suggested or []
    first = F.when((F.col("x") == active[0]) & (F.col("y") == active[1]), 0).when(F.col("x").isin(suggested) | F.col("y").isin(suggested), 1).when(F.col("x") == F.col("y"), 2).otherwise(3)
    cells = a.crossJoin(b).withColumn("priority", first)  # at most 100 names on either side
    return cells.withColumn("place", F.row_number().over(Window.orderBy("priority", "i", "j"))).select("x", "y", "priority", "place")
