"""The library's operators as named queries over the driver's tables, and the SQL that each is compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import epoch_ms, epoch_us, floor_div
from .operators import drift, expr, filters, ordered, reduce, scatter, spectral, stats
from .operators.causal import discovery, independence, lagged
from .sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:  # DuckDB's epoch_ms rounds; milliseconds here are cut
            SQL[f.__name__] = re.sub(r"epoch_ms\((\w+)\)", r"(epoch_us(\1) // 1000)", sql)
        return f

    return register


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to 6 places, without negative zeros; times as milliseconds."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        out.append((F.round(c, 6) + 0.0 if kind == "double" and name not in keep else epoch_ms(c) if kind.startswith("timestamp") else c).alias(name))
    return df.select(*out)


START, END = "2024-01-05T00:00:00", "2024-01-20T12:00:00"
_BETWEEN = f"ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"

# --- filters and projections --------------------------------------------------------------------


@query(f"SELECT epoch_ms(ts) AS ts, value FROM events WHERE {_BETWEEN}")
def time_filter(spark, d):
    return rounded(filters.filter_time_range(events(spark, d), "ts", START, END, ["value"]), "value")


@query(f"SELECT event_id, value FROM events WHERE ts >= TIMESTAMP '{START}'")
def time_filter_open_end(spark, d):
    return events(spark, d).where(filters.time_between("ts", START)).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 50")
def range_filter(spark, d):
    return filters.apply_filters(events(spark, d), "ts", ranges=filters.parse_range_filters('[{"column":"value","from":10.0,"to":50.0}]')).select("event_id", "value")


@query(f"SELECT event_id, value FROM events WHERE value BETWEEN 5 AND 20 AND {_BETWEEN}")
def range_filter_swapped(spark, d):
    return filters.apply_filters(events(spark, d), "ts", END, START, [filters.RangeFilter("value", 20, 5)]).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE ts BETWEEN make_timestamp(1704412800000000) AND make_timestamp(1704499200001000)")
def temporal_range_filter(spark, d):
    return filters.apply_filters(events(spark, d), "ts", ranges=[filters.RangeFilter("ts", 1704412800000.5, 1704499200000.5)]).select("event_id", "value")


_LINE = "10.0 + (epoch_ms(ts)::DOUBLE - 1704412800000) * ((90.0 - 10.0) / (1705276800000 - 1704412800000))"
_LINE_FILTER = (1704412800000, 10.0, 1705276800000, 90.0)


@query(f"SELECT event_id, value FROM events WHERE NOT (epoch_ms(ts) BETWEEN 1704412800000 AND 1705276800000) OR value >= {_LINE}")
def line_filter_above(spark, d):
    return filters.apply_filters(events(spark, d), "ts", lines=[filters.LineFilter("value", *_LINE_FILTER)]).select("event_id", "value")


@query(f"SELECT event_id, value FROM events WHERE NOT (epoch_ms(ts) BETWEEN 1704412800000 AND 1705276800000) OR value <= {_LINE}")
def line_filter_below(spark, d):
    return filters.apply_filters(events(spark, d), "ts", lines=[filters.LineFilter("value", *_LINE_FILTER, keep_above=False)]).select("event_id", "value")


@query(f"SELECT event_id, value FROM events WHERE value > {_LINE}")
def line_filter_client(spark, d):
    return filters.client_line_filter(events(spark, d), "ts", filters.LineFilter("value", *_LINE_FILTER)).select("event_id", "value")


@query("SELECT event_id, value FROM events WHERE value BETWEEN 3 AND 30 AND user_id BETWEEN 10 AND 500")
def range_filter_client(spark, d):
    return filters.client_range_filter(events(spark, d), {"value": (3, 30), "user_id": (10, 500)}).select("event_id", "value")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase', 'view')")
def in_filter(spark, d):
    return events(spark, d).where(filters.one_of("event_type", ["click", "purchase", "view"])).select("event_id", "event_type")


@query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN value > 20 THEN value END AS v FROM events) WHERE v IS NOT NULL")
def not_null_filter(spark, d):
    return events(spark, d).select("event_id", F.when(F.col("value") > 20, F.col("value")).alias("v")).where(filters.not_null("v"))


@query(f"SELECT event_id FROM (SELECT *, CASE WHEN value > 20 THEN value END AS v FROM events) WHERE {_BETWEEN} AND value <= 40 AND v IS NULL")
def predicate_and_all(spark, d):
    rows = events(spark, d).withColumn("v", F.when(F.col("value") > 20, F.col("value")))
    return filters.Predicates().time_range("ts", START, END).numeric_range("value", None, 40).is_null("v").apply_to(rows).select("event_id")


@query("SELECT epoch_ms(ts) AS ts, event_id, user_id FROM events")
def project_subset(spark, d):
    return rounded(filters.project(readers.keep_columns(events(spark, d), ["user_id", "event_id", "nope"], "ts"), ["ts", "event_id", "user_id", "ts"]))


@query("SELECT event_id, value FROM events ORDER BY ts, event_id LIMIT 500 OFFSET 250")
def slice_rows(spark, d):
    return readers.slice_rows(events(spark, d).select("ts", "event_id", "value"), 250, 500, "ts", "event_id").select("event_id", "value")


@query("SELECT event_id, epoch_ms(ts) // 1000 * 1000 AS s, epoch_ms(ts) AS ms, epoch_us(ts) // 1000 AS us, epoch_us(ts) // 1000 AS ns FROM events")
def epoch_units(spark, d):
    us = epoch_us(F.col("ts"))
    out = events(spark, d).select("event_id", "value", floor_div(us, 1_000_000).alias("s"), floor_div(us, 1000).alias("ms"), us.alias("us"), (us * 1000).alias("ns"))
    for c in ("s", "ms", "us", "ns"):
        out = readers.normalise_time(out, c)
    return rounded(out.drop("value"))


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def sort_head(spark, d):
    return events(spark, d).orderBy(F.desc("value"), "event_id").limit(100).select("event_id", "value")


# --- reductions ---------------------------------------------------------------------------------


def _bucket_sql(agg: str) -> str:
    return f"""WITH r AS (SELECT min(epoch_ms(ts)) AS lo, max(epoch_ms(ts)) AS hi FROM events),
    b AS (SELECT least(greatest(floor((epoch_ms(ts) - lo) / (greatest(hi - lo, 1) / 50.0::DOUBLE)), 0), 49) AS b, value, lo, hi FROM events, r)
    SELECT floor(any_value(lo) + (b + 0.5) * (greatest(any_value(hi) - any_value(lo), 1) / 50.0::DOUBLE))::BIGINT AS ts, round({agg}, 6) AS value FROM b GROUP BY b"""


def _bucket(how: str, sql: str) -> None:
    def run(spark, d):
        return rounded(reduce.bucket_aggregate(events(spark, d), "ts", ["value"], 50, how))

    run.__name__ = f"bucket_{how}"
    query(_bucket_sql(sql))(run)


for _how, _agg in (("mean", "avg(value)"), ("sum", "sum(value)"), ("min", "min(value)"), ("max", "max(value)"), ("count", "count(value)::DOUBLE")):
    _bucket(_how, _agg)


@query("""WITH r AS (SELECT min(epoch_ms(ts)) AS lo FROM events)
    SELECT lo + k * 3600000 + 1800000 AS ts, round(avg(value), 6) AS value FROM (SELECT (epoch_ms(ts) - lo) // 3600000 AS k, value, lo FROM events, r) GROUP BY lo, k""")
def tumbling_hour(spark, d):
    return rounded(reduce.tumbling_aggregate(events(spark, d), "ts", ["value"], 3_600_000))


@query("""WITH r AS (SELECT min(epoch_ms(ts)) AS lo, max(epoch_ms(ts)) AS hi FROM events),
    w AS (SELECT unnest(range(0, (hi - lo) // 9000000 + 1)) AS k, lo FROM r)
    SELECT lo + k * 9000000 + 10800000 AS ts, round(sum(value), 6) AS value FROM w JOIN events ON epoch_ms(ts) >= lo + k * 9000000 AND epoch_ms(ts) < lo + k * 9000000 + 21600000 GROUP BY lo, k""")
def sliding_6h_2h30(spark, d):
    return rounded(reduce.sliding_aggregate(events(spark, d), "ts", ["value"], 21_600_000, 9_000_000, "sum"))


@query("""WITH r AS (SELECT min(epoch_ms(ts)) AS lo, max(epoch_ms(ts)) AS hi FROM events),
    w AS (SELECT unnest(range(0, (hi - lo) // 7200000 + 1)) AS k, lo FROM r)
    SELECT lo + k * 7200000 + 1800000 AS ts, round(max(value), 6) AS value FROM w JOIN events ON epoch_ms(ts) >= lo + k * 7200000 AND epoch_ms(ts) < lo + k * 7200000 + 3600000 GROUP BY lo, k""")
def sliding_with_gaps(spark, d):
    return rounded(reduce.sliding_aggregate(events(spark, d), "ts", ["value"], 3_600_000, 7_200_000, "max"))


@query("SELECT epoch_ms(o_orderdate) AS o_orderdate, round(sum(o_totalprice), 4) AS o_totalprice FROM orders GROUP BY o_orderdate")
def aggregate_by_time(spark, d):
    return reduce.aggregate_by_time(orders(spark, d), "o_orderdate", "o_totalprice", "sum").select(epoch_ms(F.col("o_orderdate")).alias("o_orderdate"), F.round("o_totalprice", 4).alias("o_totalprice"))


@query("""WITH r AS (SELECT min(epoch_ms(ts)) AS lo, max(epoch_ms(ts)) AS hi FROM events),
    b AS (SELECT least(floor((epoch_ms(ts) - lo) / (greatest(hi - lo, 1) / 40.0::DOUBLE)), 39)::BIGINT AS bucket, ts, value FROM events, r)
    SELECT bucket, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close FROM b GROUP BY bucket""")
def ohlc_40(spark, d):
    return reduce.ohlc(events(spark, d), "ts", "value", 40).select(F.col("bucket").cast("long").alias("bucket"), "open", "high", "low", "close")


def _sampled(mode: str, sql: str) -> None:
    def run(spark, d):
        return rounded(reduce.sampled(events(spark, d), "ts", "value", 40, mode).select(F.col("bucket").cast("long").alias("bucket"), "value"))

    run.__name__ = f"sample_{mode}"
    query(f"""WITH r AS (SELECT min(epoch_ms(ts)) AS lo, max(epoch_ms(ts)) AS hi FROM events),
    b AS (SELECT least(floor((epoch_ms(ts) - lo) / (greatest(hi - lo, 1) / 40.0::DOUBLE)), 39)::BIGINT AS bucket, value FROM events, r) SELECT bucket, round({sql}(value), 6) AS value FROM b GROUP BY bucket""")(run)


for _mode, _agg in (("average", "avg"), ("max", "max"), ("min", "min")):
    _sampled(_mode, _agg)


@query("""WITH n AS (SELECT greatest(count(*) // 700, 1) AS step FROM events), i AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, event_id, value FROM events)
    SELECT event_id, value FROM i, n WHERE i % step = 0 AND i // step < 700""")
def stride_downsample(spark, d):
    return reduce.stride_downsample(events(spark, d), 700, "ts", "event_id").select("event_id", "value")


@query()
def lttb_downsample(spark, d):
    return rounded(reduce.minmax_lttb(events(spark, d), "ts", ["value", "user_id"], 400, "ts", "event_id"))


# --- profiles and distributions -----------------------------------------------------------------


@query("""SELECT 'event_id' AS "column", count(event_id) AS non_null, count(*) - count(event_id) AS nulls, count(*) AS n_rows, min(event_id)::DOUBLE AS low, max(event_id)::DOUBLE AS high FROM events
    UNION ALL SELECT 'ts', count(ts), count(*) - count(ts), count(*), min(epoch_ms(ts))::DOUBLE, max(epoch_ms(ts))::DOUBLE FROM events
    UNION ALL SELECT 'user_id', count(user_id), count(*) - count(user_id), count(*), min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events
    UNION ALL SELECT 'event_type', count(event_type), count(*) - count(event_type), count(*), NULL, NULL FROM events
    UNION ALL SELECT 'value', count(value), count(*) - count(value), count(*), min(value), max(value) FROM events
    UNION ALL SELECT 'props', count(props), count(*) - count(props), count(*), NULL, NULL FROM events""")
def profile_columns(spark, d):
    return stats.profile(events(spark, d)).select("column", "non_null", "nulls", F.col("rows").alias("n_rows"), F.col("min").alias("low"), F.col("max").alias("high"))


@query("SELECT min(epoch_ms(ts)) AS start_ms, max(epoch_ms(ts)) AS end_ms FROM events")
def metadata_time_range(spark, d):
    return stats.time_range(events(spark, d), "ts")


def _histogram_sql(table: str, column: str, bins: int) -> str:
    return f"""WITH r AS (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi FROM {table}),
    c AS (SELECT least(floor(({column}::DOUBLE - lo) / (hi - lo) * {bins}), {bins - 1})::INT AS bin, count(*) AS n FROM {table}, r GROUP BY 1)
    SELECT '{column}' AS series, g.bin::INT AS bin, round(lo + (hi - lo) * g.bin / {bins}, 6) AS low, round(lo + (hi - lo) * (g.bin + 1) / {bins}, 6) AS high, coalesce(n, 0)::BIGINT AS n
    FROM (SELECT unnest(range(0, {bins})) AS bin) g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin"""


@query(f"SELECT * FROM ({_histogram_sql('events', 'value', 24)}) UNION ALL SELECT * FROM ({_histogram_sql('events', 'user_id', 24)})")
def histogram_24(spark, d):
    return rounded(stats.histogram(events(spark, d), ["value", "user_id"]))


@query("""WITH e AS (SELECT value AS v, (CASE WHEN value >= 0 THEN 1 ELSE 0 END + CASE WHEN value >= 5 THEN 1 ELSE 0 END + CASE WHEN value >= 10 THEN 1 ELSE 0 END + CASE WHEN value >= 50 THEN 1 ELSE 0 END) - 1 AS b FROM events WHERE value BETWEEN 0 AND 200),
    c AS (SELECT least(b, 3) AS bin, count(*) AS n FROM e GROUP BY 1)
    SELECT g.bin::INT AS bin, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range(0, 4)) AS bin) g LEFT JOIN c USING (bin)""")
def histogram_edges(spark, d):
    return stats.histogram_edges(events(spark, d), "value", [0.0, 5.0, 10.0, 50.0, 200.0])


_STATS = "count({0}) AS n, round(min({0})::DOUBLE, 6) AS min, round(max({0})::DOUBLE, 6) AS max, round(avg({0}), 6) AS mean, round(stddev_pop({0}), 6) AS std, round(quantile_cont({0}::DOUBLE, 0.25), 6) AS q1, round(quantile_cont({0}::DOUBLE, 0.5), 6) AS median, round(quantile_cont({0}::DOUBLE, 0.75), 6) AS q3"


@query(f"SELECT 'l_quantity' AS series, {_STATS.format('l_quantity')} FROM lineitem UNION ALL SELECT 'l_discount', {_STATS.format('l_discount')} FROM lineitem")
def column_stats(spark, d):
    return rounded(stats.column_stats(lineitem(spark, d), ["l_quantity", "l_discount"]))


@query("""WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT q, x FROM s JOIN (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.95)) v(q) ON i = floor(q * (n - 1) + 0.5)""")
def nearest_quantiles(spark, d):
    return stats.nearest_rank_quantiles(events(spark, d), "value")


@query("""WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT x, round((i + 1) / n::DOUBLE, 9) AS y FROM s WHERE i % greatest(n // 200, 1) = 0""")
def ecdf(spark, d):
    return stats.ecdf(events(spark, d), "value").select("x", F.round("y", 9).alias("y"))


@query("""SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr,
    round(avg(power((value - m) / s, 3)), 6) AS skewness, round(avg(power((value - m) / s, 4)) - 3, 6) AS kurtosis FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def moments(spark, d):
    return rounded(stats.moments(events(spark, d), "value"))


@query("SELECT min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events")
def box_stats(spark, d):
    return rounded(stats.box_stats(events(spark, d), "value"), "low", "high")


@query("""WITH s AS (SELECT value AS x, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events)
    SELECT min(x) AS low, max(CASE WHEN i = floor(n * 0.25) THEN x END) AS q1, max(CASE WHEN i = floor(n * 0.5) THEN x END) AS median, max(CASE WHEN i = floor(n * 0.75) THEN x END) AS q3, max(x) AS high FROM s""")
def box_stats_floor(spark, d):
    return stats.box_stats(events(spark, d), "value", floor_index=True)


@query("""WITH s AS (SELECT count(value) AS n, stddev_pop(value) AS sd, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, min(value) AS lo, max(value) AS hi FROM events),
    h AS (SELECT *, greatest(0.9 * least(sd, iqr / 1.34) * power(n, -0.2), 0.001) AS h FROM s), g AS (SELECT unnest(range(0, 64)) AS k)
    SELECT k::INT AS k, round(any_value(lo + (hi - lo) * k / 63), 6) AS x, round(sum(exp(-0.5 * power((value - (lo + (hi - lo) * k / 63)) / h, 2))) / any_value(n * h * 2.5066282746310002), 6) AS density FROM events, h, g GROUP BY k""")
def kde_64(spark, d):
    return rounded(stats.kde(events(spark, d), "value"))


@query("""WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
    SELECT least(floor((l_quantity - x0) / (x1 - x0) * 20), 19)::INT AS bx, least(floor((l_extendedprice - y0) / (y1 - y0) * 20), 19)::INT AS by, count(*) AS n FROM lineitem, e GROUP BY 1, 2""")
def density_20x20(spark, d):
    return stats.density_grid(lineitem(spark, d), "l_quantity", "l_extendedprice")


@query("""SELECT least(floor((user_id - 10) / 490.0::DOUBLE * 300 / 8), 37)::INT AS bx, least(floor((value - 2.0) / 38.0::DOUBLE * 200 / 8), 24)::INT AS by, count(*) AS n FROM events WHERE user_id BETWEEN 10 AND 500 AND value BETWEEN 2 AND 40 GROUP BY 1, 2""")
def pixel_grid(spark, d):
    return stats.pixel_grid(events(spark, d), "user_id", "value", (10, 500, 2.0, 40.0), 300, 200)


@query("SELECT event_type AS label, (row_number() OVER (ORDER BY t, i) - 1)::INT AS place FROM (SELECT event_type, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS i FROM events GROUP BY event_type)")
def label_order(spark, d):
    return stats.label_order(events(spark, d), "event_type", "ts", "event_id")


@query("""WITH l AS (SELECT coalesce(nullif(trim(CASE WHEN event_id % 7 = 0 THEN ' ' ELSE event_type END), ''), 'Missing') AS label, value AS x FROM events), r AS (SELECT min(x) AS lo, max(x) AS hi FROM l)
    SELECT label, least(floor((x - lo) / (hi - lo) * 24), 23)::INT AS bin, count(*) AS n FROM l, r GROUP BY 1, 2""")
def grouped_hist(spark, d):
    rows = events(spark, d).withColumn("label", F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("event_type")))
    return stats.grouped_histogram(rows, "value", "label")


@query("SELECT 'l_tax' AS series, round(min(l_tax) - 0.02 * (max(l_tax) - min(l_tax)), 6) AS low, round(max(l_tax) + 0.02 * (max(l_tax) - min(l_tax)), 6) AS high FROM lineitem UNION ALL SELECT 'l_quantity', round(min(l_quantity) - 0.02 * (max(l_quantity) - min(l_quantity)), 6), round(max(l_quantity) + 0.02 * (max(l_quantity) - min(l_quantity)), 6) FROM lineitem")
def padded_bounds(spark, d):
    return rounded(stats.padded_bounds(lineitem(spark, d), ["l_tax", "l_quantity"]))


@query("SELECT 0 AS numeric, NULL::DOUBLE AS low, NULL::DOUBLE AS high, count(DISTINCT event_type) AS categories FROM (SELECT event_type FROM events ORDER BY ts, event_id LIMIT 1000)")
def colour_analysis(spark, d):
    return stats.colour_analysis(events(spark, d), "event_type", "ts", "event_id")


# --- correlation --------------------------------------------------------------------------------

_PAIR = "(SELECT CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS x, l_extendedprice AS y FROM lineitem)"


def _pairs(spark, d):
    return lineitem(spark, d).select(F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("x"), F.col("l_extendedprice").alias("y"))


@query(f"SELECT round(corr(x, y), 6) AS pearson FROM {_PAIR}")
def pearson(spark, d):
    return rounded(stats.pearson(_pairs(spark, d), "x", "y"))


@query(f"""WITH r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM {_PAIR} WHERE x IS NOT NULL)
    SELECT round(corr(rx, ry), 6) AS spearman FROM r""")
def spearman_ties(spark, d):
    return rounded(stats.spearman(_pairs(spark, d), "x", "y"))


_MATRIX = ["l_discount", "l_extendedprice", "l_quantity"]


def _matrix_sql() -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in _MATRIX)
    cells = [f"SELECT '{a}' AS col_i, '{b}' AS col_j, " + ("1.0::DOUBLE AS pearson, 1.0::DOUBLE AS spearman" if a == b else f"round(corr({a}, {b}), 6) AS pearson, round(corr(r_{a}, r_{b}), 6) AS spearman FROM r") for a in _MATRIX for b in _MATRIX]
    return f"WITH r AS (SELECT *, {ranks} FROM lineitem) " + " UNION ALL ".join(cells)


@query(_matrix_sql())
def corr_matrix(spark, d):
    return rounded(stats.correlation_matrix(lineitem(spark, d).select(*_MATRIX), _MATRIX))


@query(f"""WITH r AS (SELECT *, {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}' for c in _MATRIX)} FROM lineitem),
    c AS (SELECT 'l_discount' AS "column", corr(l_extendedprice, l_discount) AS p, corr(r_l_extendedprice, r_l_discount) AS s FROM r UNION ALL SELECT 'l_quantity', corr(l_extendedprice, l_quantity), corr(r_l_extendedprice, r_l_quantity) FROM r)
    SELECT 'l_extendedprice' AS base, "column", round(p, 6) AS pearson, round(s, 6) AS spearman, (greatest(abs(p), abs(s)) >= 0.7)::INT AS suggested FROM c""")
def corr_suggest(spark, d):
    found = stats.correlation_suggestions(lineitem(spark, d).select(*_MATRIX), _MATRIX, "l_extendedprice")
    return rounded(found.select("base", "column", "pearson", "spearman", F.col("suggested").cast("int").alias("suggested")))


@query("""WITH c(name, i) AS (VALUES ('a', 0), ('b', 1), ('c', 2)), p AS (SELECT x.name AS x, y.name AS y, x.i AS i, y.i AS j,
    CASE WHEN x.name = 'b' AND y.name = 'a' THEN 0 WHEN x.name = 'c' OR y.name = 'c' THEN 1 WHEN x.name = y.name THEN 2 ELSE 3 END AS priority FROM c x, c y)
    SELECT x, y, priority::INT AS priority, (row_number() OVER (ORDER BY priority, i, j))::INT AS place FROM p""")
def scatter_matrix_cells(spark, d):
    return stats.matrix_cells(events(spark, d), ["a", "b", "c"], ("b", "a"), ["c"])


# --- along time ---------------------------------------------------------------------------------

_FRAME = "OVER (ORDER BY ts, event_id ROWS BETWEEN 24 PRECEDING AND 24 FOLLOWING)"


@query(f"""SELECT event_id, round(m, 6) AS mean, round(m + s, 6) AS upper1, round(m - s, 6) AS lower1, round(m + 2 * s, 6) AS upper2, round(m - 2 * s, 6) AS lower2
    FROM (SELECT event_id, CASE WHEN count(value) {_FRAME} >= 2 THEN avg(value) {_FRAME} END AS m, CASE WHEN count(value) {_FRAME} >= 2 THEN stddev_pop(value) {_FRAME} END AS s FROM events)""")
def rolling_bands_w50(spark, d):
    return rounded(ordered.rolling_bands(events(spark, d), "ts", "value", 50, "ts", "event_id").drop("ts"))


_BY_TYPE = _FRAME.replace("(ORDER", "(PARTITION BY event_type ORDER")


@query(f"""SELECT event_type, event_id, round(m, 6) AS mean, round(m + s, 6) AS upper1, round(m - s, 6) AS lower1, round(m + 2 * s, 6) AS upper2, round(m - 2 * s, 6) AS lower2
    FROM (SELECT event_type, event_id, CASE WHEN count(value) {_BY_TYPE} >= 2 THEN avg(value) {_BY_TYPE} END AS m, CASE WHEN count(value) {_BY_TYPE} >= 2 THEN stddev_pop(value) {_BY_TYPE} END AS s FROM events)""")
def rolling_bands_by_type(spark, d):
    return rounded(ordered.rolling_bands(events(spark, d), "ts", "value", 50, "ts", "event_id", by="event_type").drop("ts"))


def _anomaly_sql(score: str, extra: str) -> str:
    return f"""WITH i AS (SELECT ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, {score} AS score FROM events, {extra}),
    f AS (SELECT *, i - row_number() OVER (ORDER BY i) AS run FROM i WHERE score IS NOT NULL)
    SELECT min(epoch_ms(ts)) AS start, max(epoch_ms(ts)) AS "end", count(*) AS n, round(arg_min(score, i), 6) AS score, round(max(score), 6) AS max_score FROM f GROUP BY run"""


@query(_anomaly_sql("CASE WHEN abs((value - m) / s) > 1.0 THEN abs((value - m) / s) END", "(SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"))
def anomaly_zscore(spark, d):
    return rounded(ordered.anomalies_zscore(events(spark, d), "ts", "value", 1.0, "ts", "event_id"))


@query(_anomaly_sql("CASE WHEN value < a - 0.5 * (b - a) THEN (a - 0.5 * (b - a) - value) / (b - a) WHEN value > b + 0.5 * (b - a) THEN (value - b - 0.5 * (b - a)) / (b - a) END", "(SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)"))
def anomaly_iqr(spark, d):
    return rounded(ordered.anomalies_iqr(events(spark, d), "ts", "value", 0.5, "ts", "event_id"))


@query("SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs(value - m) <= 2 * s")
def outlier_global_z(spark, d):
    return ordered.remove_outliers(events(spark, d), ["value"], "zscore", 2.0).select("event_id", "value")


@query("SELECT event_id, value FROM events, (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)")
def outlier_global_iqr(spark, d):
    return ordered.remove_outliers(events(spark, d), ["value"], "iqr").select("event_id", "value")


_WIDE = "OVER (ORDER BY ts, event_id ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)"


@query(f"SELECT event_id, value FROM (SELECT event_id, value, avg(value) {_WIDE} AS m, stddev_pop(value) {_WIDE} AS s FROM events) WHERE NOT (s > 2.3e-16 AND abs(value - m) > 2.5 * s)")
def outlier_windowed_z(spark, d):
    return ordered.remove_outliers_windowed(events(spark, d), "value", 31, "zscore", 2.5, "ts", "event_id").select("event_id", "value")


@query(f"SELECT event_id, value FROM (SELECT event_id, value, quantile_cont(value, 0.25) {_WIDE} AS a, quantile_cont(value, 0.75) {_WIDE} AS b FROM events) WHERE NOT (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a))")
def outlier_windowed_iqr(spark, d):
    return ordered.remove_outliers_windowed(events(spark, d), "value", 31, "iqr", 1.5, "ts", "event_id").select("event_id", "value")


@query("""WITH g AS (SELECT epoch_ms(ts) - lag(epoch_ms(ts)) OVER (ORDER BY ts) AS g FROM events), s AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM g WHERE g > 0)
    SELECT round(1000.0 / g, 9) AS hz FROM s WHERE i = n // 2""")
def sample_rate(spark, d):
    return ordered.sample_rate(events(spark, d), "ts").select(F.round("hz", 9).alias("hz"))


# --- derived columns ----------------------------------------------------------------------------


@query("SELECT event_id, round(((value + user_id) * 2 - value / 4) % 7, 6) AS y FROM events")
def transform_arith(spark, d):
    return rounded(expr.transform(events(spark, d), "((value + user_id) * 2 - value / 4) % 7", "y").select("event_id", "y"))


@query("SELECT event_id, round(ln(value) + log2(value) * log10(value) - sqrt(abs(-value)), 6) AS y FROM events")
def transform_log(spark, d):
    return rounded(expr.transform(events(spark, d), "log(value) + log2(value) * log10(value) - sqrt(abs(-value))", "y").select("event_id", "y"))


@query("SELECT event_id, round(value)::DOUBLE + floor(value / 3) - ceil(value / 7) + 1e-3 AS y FROM events")
def transform_round(spark, d):
    return expr.transform(events(spark, d), "round(value) + floor(value / 3) - ceil(value / 7) + 1e-3", "y").select("event_id", "y")


# --- scatter ------------------------------------------------------------------------------------


@query("SELECT user_id::DOUBLE AS x, value AS y, event_id::DOUBLE AS colour FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 2000)")
def scatter_points_head(spark, d):
    return scatter.scatter_points(events(spark, d), "ts", "user_id", "value", "event_id", None, 2000, "ts", "event_id")


@query("SELECT epoch_ms(ts)::DOUBLE AS x, value AS y, event_type AS colour FROM (SELECT * FROM events WHERE value BETWEEN 5 AND 25 ORDER BY ts, event_id LIMIT 1500)")
def scatter_categorical(spark, d):
    return scatter.scatter_points(events(spark, d), "ts", "ts", "value", "event_type", None, 1500, "ts", "event_id", ranges=[filters.RangeFilter("value", 5, 25)])


# --- spectral -----------------------------------------------------------------------------------

def _strided(limit: int) -> str:
    return f"""WITH o AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, ts, value, user_id, greatest(count(*) OVER () // {limit}, 1) AS step FROM events),
    s AS (SELECT i // step AS i, ts, value AS x, user_id FROM o WHERE i % step = 0 AND i // step < {limit})"""


_DFT = (
    _strided(256)
    + """,
    w AS (SELECT i, (x - (SELECT avg(x) FROM s)) * 0.5 * (1 - cos(2 * pi() * i / 255)) AS x FROM s), k AS (SELECT unnest(range(0, 129)) AS k),
    m AS (SELECT k, sqrt(power(sum(x * cos(2 * pi() * (i * k % 256) / 256)), 2) + power(sum(x * sin(2 * pi() * (i * k % 256) / 256)), 2)) / 256 * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END AS magnitude FROM w, k GROUP BY k)"""
)


@query(_DFT + " SELECT k::INT AS bin, round(magnitude, 6) AS magnitude, round(magnitude * magnitude, 6) AS power FROM m")
def fft_dft(spark, d):
    return rounded(spectral.spectrum(events(spark, d), "ts", ["value"], 256, "ts", "event_id").select("bin", "magnitude", "power"))


@query(_DFT + " SELECT k::INT AS bin, round(magnitude, 6) AS magnitude, (row_number() OVER (ORDER BY magnitude DESC))::INT AS rank FROM m WHERE k >= 1 QUALIFY row_number() OVER (ORDER BY magnitude DESC) <= 5")
def fft_peaks(spark, d):
    return rounded(spectral.dominant_peaks(spectral.spectrum(events(spark, d), "ts", ["value"], 256, "ts", "event_id")).select("bin", "magnitude", "rank"))


@query(
    _strided(256)
    + """,
    f AS (SELECT unnest(range(0, 7)) AS frame), r AS (SELECT frame, i - frame * 32 AS j, x, ts FROM f JOIN s ON i >= frame * 32 AND i < frame * 32 + 64), a AS (SELECT frame, avg(x) AS m, max(CASE WHEN j = 32 THEN epoch_ms(ts) END) AS t_ms FROM r GROUP BY frame),
    w AS (SELECT r.frame, j, t_ms, (x - m) * 0.5 * (1 - cos(2 * pi() * j / 63)) AS x FROM r JOIN a USING (frame)), k AS (SELECT unnest(range(0, 33)) AS k)
    SELECT frame, t_ms, k::INT AS bin, round(sqrt(power(sum(x * cos(2 * pi() * (j * k % 64) / 64)), 2) + power(sum(x * sin(2 * pi() * (j * k % 64) / 64)), 2)) / 64 * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END, 6) AS magnitude FROM w, k GROUP BY frame, t_ms, k"""
)
def spectrogram(spark, d):
    return rounded(spectral.spectrogram(events(spark, d), "ts", "value", 64, 32, 256, "ts", "event_id").drop("frequency"))


@query()
def spectral_lowpass(spark, d):
    return rounded(spectral.spectral_filter(events(spark, d), "ts", "value", "lowpass", high_hz=1e-4, max_points=4096))


# --- drift --------------------------------------------------------------------------------------

_SIDES = "(SELECT value AS v, 0 AS side FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT value, 1 FROM events WHERE ts >= TIMESTAMP '2024-01-20')"
_CDF = f"""WITH s AS (SELECT * FROM {_SIDES}), n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM s),
    c AS (SELECT v, count(*) FILTER (side = 0) AS c0, count(*) FILTER (side = 1) AS c1 FROM s GROUP BY v),
    f AS (SELECT v, sum(c0) OVER (ORDER BY v) / n0::DOUBLE AS f0, sum(c1) OVER (ORDER BY v) / n1::DOUBLE AS f1, lead(v) OVER (ORDER BY v) AS nxt, n0, n1 FROM c, n)"""


def _sides(spark, d):
    e = events(spark, d)
    return drift.two_samples(e.where("ts < timestamp_ntz'2024-01-10'"), e.where("ts >= timestamp_ntz'2024-01-20'"), "value")


@query(_CDF + """, k AS (SELECT max(abs(f0 - f1)) AS d, any_value(n0) AS n0, any_value(n1) AS n1, sqrt(any_value(n0)::DOUBLE * any_value(n1) / (any_value(n0) + any_value(n1))) AS r FROM f), z AS (SELECT *, (d + 1 / (6 * r)) * (r + 0.12 + 0.11 / r) AS z FROM k)
    SELECT n0, n1, round(d, 6) AS d, round(CASE WHEN z < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, (SELECT sum(CASE WHEN i % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2 * i * i * z * z)) FROM (SELECT unnest(range(1, 101)) AS i)))) END, 6) AS p FROM z""")
def ks_two_sample(spark, d):
    return rounded(drift.ks(_sides(spark, d)))


@query(_CDF + " SELECT round(sum(abs(f0 - f1) * (nxt - v)), 6) AS w FROM f")
def wasserstein(spark, d):
    return rounded(drift.wasserstein(_sides(spark, d)))


@query(f"""WITH s AS (SELECT least((v >= 2)::INT + (v >= 5)::INT + (v >= 10)::INT + (v >= 30)::INT, 4) AS b, side FROM {_SIDES} WHERE v BETWEEN 0 AND 500),
    n AS (SELECT count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM s), g AS (SELECT unnest(range(0, 5)) AS b),
    p AS (SELECT greatest(count(s.b) FILTER (side = 0) / any_value(n0)::DOUBLE, 1e-10) AS r, greatest(count(s.b) FILTER (side = 1) / any_value(n1)::DOUBLE, 1e-10) AS c FROM g CROSS JOIN n LEFT JOIN s ON s.b = g.b GROUP BY g.b)
    SELECT round(greatest(sum((c - r) * ln(c / r)), 0), 6) AS psi FROM p""")
def psi(spark, d):
    return rounded(drift.psi(_sides(spark, d), [0.0, 2.0, 5.0, 10.0, 30.0, 500.0]))


@query(f"""WITH s AS (SELECT * FROM {_SIDES}), a AS (SELECT stddev_pop(v) AS sd, count(*) FILTER (side = 0) AS n, count(*) FILTER (side = 1) AS m FROM s), t AS (SELECT unnest(range(1, 65)) AS k),
    c AS (SELECT k, least(5 / any_value(sd), 50.0) * k / 64 AS t, avg(cos(v * least(5 / sd, 50.0) * k / 64)) FILTER (side = 0) - avg(cos(v * least(5 / sd, 50.0) * k / 64)) FILTER (side = 1) AS re,
    avg(sin(v * least(5 / sd, 50.0) * k / 64)) FILTER (side = 0) - avg(sin(v * least(5 / sd, 50.0) * k / 64)) FILTER (side = 1) AS im FROM s, a, t GROUP BY k)
    SELECT round(sum((re * re + im * im) * exp(-t * t / 2)) / 64 * any_value(n::DOUBLE * m / (n + m)), 6) AS es FROM c, a""")
def es_statistic(spark, d):
    return rounded(drift.es_statistic(_sides(spark, d)))


_REF = "ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-08'"


@query(f"""WITH ref AS (SELECT value AS v FROM events WHERE {_REF}), rn AS (SELECT count(*) AS n FROM ref), cur AS (SELECT epoch_ms(ts) // 86400000 AS w, value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events)),
    cn AS (SELECT w, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM cur GROUP BY w), x AS (SELECT w, v, 1 AS c, 0 AS r FROM cur UNION ALL SELECT w, v, 0, 1 FROM cn, ref), g AS (SELECT w, v, sum(c) AS c, sum(r) AS r FROM x GROUP BY w, v),
    f AS (SELECT g.w, v, sum(c) OVER (PARTITION BY g.w ORDER BY v) / cn.n::DOUBLE AS fc, sum(r) OVER (PARTITION BY g.w ORDER BY v) / rn.n::DOUBLE AS fr, lead(v) OVER (PARTITION BY g.w ORDER BY v) AS nxt FROM g JOIN cn ON g.w = cn.w, rn)
    SELECT cn.w * 86400000 AS window_ms, cn.n AS n, mean, std, round(max(abs(fc - fr)), 6) AS ks, round(sum(abs(fc - fr) * (nxt - v)), 6) AS wasserstein FROM f JOIN cn USING (w) GROUP BY cn.w, cn.n, mean, std""")
def drift_windows_daily(spark, d):
    found = drift.drift(events(spark, d), "ts", "value", "daily", "2024-01-01", "2024-01-08", permutations=False)
    return rounded(found.where("n > 0").select("window_ms", "n", "mean", "std", "ks", "wasserstein"))


_IN_WINDOWS = "cur AS (SELECT epoch_ms(ts) // 86400000 AS w, value AS v FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND epoch_ms(ts) < (SELECT max(epoch_ms(ts)) FROM events)), s AS (SELECT w, v, row_number() OVER (PARTITION BY w ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY w) AS n FROM cur)"


def _windows(spark, d):
    return drift.window_distributions(events(spark, d), "ts", "value", "daily", "2024-01-01", "2024-01-08", 10)


@query(f"WITH {_IN_WINDOWS} SELECT w, q, v AS x FROM s JOIN (VALUES (0.05::DOUBLE), (0.25), (0.5), (0.75), (0.95)) p(q) ON i = floor(q * (n - 1) + 0.5)")
def window_quantiles(spark, d):
    return _windows(spark, d)["quantiles"]


@query(f"WITH {_IN_WINDOWS} SELECT w, v AS x, round((i + 1) / n::DOUBLE, 9) AS y FROM s WHERE i % greatest(n // 200, 1) = 0")
def window_ecdf(spark, d):
    return _windows(spark, d)["ecdf"].select("w", "x", F.round("y", 9).alias("y"))


@query(f"""WITH {_IN_WINDOWS}, r AS (SELECT value AS v, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE {_REF}),
    e AS (SELECT v AS lo, lead(v) OVER (ORDER BY v) AS hi, (row_number() OVER (ORDER BY v) - 1)::INT AS bin FROM (SELECT DISTINCT r.v FROM r JOIN (SELECT unnest(range(0, 11)) AS k) g ON r.i = floor((r.n - 1) * g.k / 10.0::DOUBLE + 0.5)))
    SELECT w, bin, count(*) AS n FROM cur JOIN e ON v >= lo AND (v < hi OR v = hi AND hi = (SELECT max(hi) FROM e)) WHERE hi IS NOT NULL GROUP BY w, bin""")
def window_histogram(spark, d):
    return _windows(spark, d)["histogram"]


@query()
def drift_levels_daily(spark, d):
    return rounded(drift.order_windows(drift.drift(events(spark, d), "ts", "value", "daily", "2024-01-01", "2024-01-08"), "severity"))


# --- causal -------------------------------------------------------------------------------------


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value AS v0, user_id::DOUBLE AS v1 FROM events)
    SELECT i, v0_l1, v0_l4, v1_l0, v1_l2 FROM (SELECT i, lag(v0, 1) OVER (ORDER BY i) AS v0_l1, lag(v0, 4) OVER (ORDER BY i) AS v0_l4, v1 AS v1_l0, lag(v1, 2) OVER (ORDER BY i) AS v1_l2 FROM i) WHERE i >= 4""")
def lag_features(spark, d):
    return lagged.lag_frame(events(spark, d), ["value", "user_id"], 2, "ts", "event_id").select("i", "v0_l1", "v0_l4", "v1_l0", "v1_l2")


@query("""WITH i AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS i, value AS v0, user_id::DOUBLE AS v1 FROM events), l AS (SELECT i, v0, v1, lag(v0, 1) OVER (ORDER BY i) AS a, lag(v1, 2) OVER (ORDER BY i) AS b FROM i)
    SELECT round(corr(v0, a), 6) AS r00, round(corr(v0, b), 6) AS r01, round(corr(v1, a), 6) AS r10 FROM l WHERE i >= 4""")
def lagged_corr(spark, d):
    rows = lagged.lag_frame(events(spark, d), ["value", "user_id"], 2, "ts", "event_id")
    pair = lambda a, b: stats.pearson_of(F.col(a), F.col(b))
    return rounded(rows.agg(pair("v0_l0", "v0_l1").alias("r00"), pair("v0_l0", "v1_l2").alias("r01"), pair("v1_l0", "v0_l1").alias("r10")))


_BINS = (
    _strided(5000)
    + """, n AS (SELECT count(*) AS c FROM s), b AS (SELECT i, ((row_number() OVER (ORDER BY x, i) - 1) * 10) // c AS a, ((row_number() OVER (ORDER BY user_id, i) - 1) * 10) // c AS b, c FROM s, n),
    j AS (SELECT a, b, count(*) AS n, any_value(c)::DOUBLE AS c FROM b GROUP BY a, b), m AS (SELECT n, c, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb FROM j)"""
)


def _series(spark, d):
    return lagged.bounded_series(events(spark, d), ["value", "user_id"], 5000, "ts", "event_id").values


def _no_z():
    import numpy as np

    return np.zeros((0, 0))


@query(_BINS + " SELECT round(2 * sum(n * ln(n * c / (na * nb))), 6) AS g FROM m")
def gsquared(spark, d):
    x = _series(spark, d)
    return rounded(spark.createDataFrame([(float(independence.g_squared(x[:, 0], x[:, 1], _no_z())[0]),)], "g double"))


@query(_BINS + " SELECT round(sum(n / c * ln(n * c / (na * nb))), 6) AS cmi FROM m")
def cmi_symbolic(spark, d):
    x = _series(spark, d)
    return rounded(spark.createDataFrame([(float(independence.cmi_symbolic(x[:, 0], x[:, 1], _no_z())[0]),)], "cmi double"))


_P = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.9]


@query(f"""WITH p AS (SELECT i, p, row_number() OVER (ORDER BY p) AS k FROM (VALUES {', '.join(f'({i}, {p}::DOUBLE)' for i, p in enumerate(_P))}) v(i, p))
    SELECT i::INT AS i, round(least(1.0, min(p * 12 / k) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM p""")
def bh_fdr(spark, d):
    return rounded(spark.createDataFrame(list(enumerate(discovery.benjamini_hochberg(_P, 12))), "i int, q double"))


@query()
def pcmci_edges(spark, d):
    hourly = reduce.tumbling_aggregate(events(spark, d), "ts", ["value", "user_id", "event_id"], 3_600_000)
    return discovery.causal_links(hourly, ["value", "user_id", "event_id"], 2)


_RUNS = ([("a", "b", 1, 0.5), ("b", "c", 1, 0.3), ("c", "a", 2, 0.2)], [("a", "b", 1, 0.5), ("b", "c", 1, 0.4), ("a", "c", 2, 0.1)])


def _values(rows: list[tuple]) -> str:
    return ", ".join(f"('{a}', '{b}', {k}, {v}::DOUBLE)" for a, b, k, v in rows)


@query(f"""WITH a(source, target, lag, old) AS (VALUES {_values(_RUNS[0])}), b(source, target, lag, new) AS (VALUES {_values(_RUNS[1])}),
    j AS (SELECT source, target, lag::INT AS lag, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN abs(old - new) > 1e-6 THEN 'changed' END AS status FROM a FULL JOIN b USING (source, target, lag)) SELECT * FROM j WHERE status IS NOT NULL""")
def run_diff(spark, d):
    a, b = (spark.createDataFrame(r, "source string, target string, lag int, value double") for r in _RUNS)
    return discovery.compare_runs(a, b)


@query(f"WITH a(source, target, lag, value) AS (VALUES {_values(_RUNS[0])}) SELECT target, target || ' ~ ' || string_agg(source || '_lag' || lag, ' + ' ORDER BY source, lag) AS formula FROM a GROUP BY target")
def glm_formulas(spark, d):
    return discovery.formulas(spark.createDataFrame(_RUNS[0], "source string, target string, lag int, value double"))


# --- sinks --------------------------------------------------------------------------------------


@query("SELECT epoch_ms(ts) AS ts, 'value' AS series, value FROM events UNION ALL SELECT epoch_ms(ts), 'user_id', user_id::DOUBLE FROM events")
def export_long(spark, d):
    return rounded(sinks.long_rows(events(spark, d), "ts", ["value", "user_id"]), "value")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Hourly means of a filtered time window."""
    rows = filters.filter_time_range(events(spark, d), "ts", START, END, ["value"])
    return reduce.tumbling_aggregate(rows, "ts", ["value"], 3_600_000).orderBy("ts")
