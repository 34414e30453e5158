"""Invariants and known answers of what SQL does not cover."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.functions import special
from tidelens.operators import drift, expr, filters, ordered, reduce, rowindex, spectral, stats
from tidelens.operators.causal import discovery, independence
from tidelens.plans.dataset import Dataset, QueryLog, ResultCache
from tidelens.plans.pipeline import Pipeline, project, reduction, time_filter
from tidelens.plans.service import Explorer
from tidelens.sources import readers, sinks, synthetic
from tidelens.streaming import windows


@pytest.fixture(scope="module")
def hourly(spark):
    t = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).cast("timestamp_ntz")
    return spark.range(720).select(t.alias("ts"), (60 + 20 * F.sin(F.col("id") * 0.01)).alias("col_a"), (30 + 10 * F.cos(F.col("id") * 0.02)).alias("col_b"), (F.col("id") * 0.1).alias("col_c"))


def test_time_filter_reaches_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").where(filters.time_between("ts", "2024-01-05", "2024-01-06"))
    plan = rows.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan


def test_special_functions():
    assert special.digamma(1) == pytest.approx(-0.5772156649) and special.digamma(2) == pytest.approx(0.4227843351)
    assert special.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-7)
    assert special.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-7)


def test_dense_index_over_many_partitions(spark):
    df = rowindex.with_row_index(spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).repartition(7), "k")
    assert [r.i for r in df.orderBy("k").collect()] == list(range(5000))


def test_running_sums(spark):
    df = spark.range(100).select(F.col("id").alias("v"), F.lit(1).alias("c"))
    rows = rowindex.with_running_sums(df, "v", {"s": "c"}, following="next").orderBy("v").collect()
    assert [r.s for r in rows] == list(range(1, 101)) and [r.next for r in rows] == [*range(1, 100), None]


def test_rolling_in_chunks_equals_one_chunk(hourly, monkeypatch):
    one = ordered.rolling_bands(hourly, "ts", "col_a", 21).orderBy("ts").collect()
    real = rowindex.chunked
    monkeypatch.setattr(ordered, "chunked", lambda df, i, half, size=0: real(df, i, half, 50))
    assert ordered.rolling_bands(hourly, "ts", "col_a", 21).orderBy("ts").collect() == one


def test_lttb(hourly):
    out = reduce.minmax_lttb(hourly, "ts", ["col_a"], 50).collect()
    times = [r.ts for r in out]
    assert 3 <= len(out) <= 50 and times == sorted(set(times))
    assert times[0] == datetime.datetime(2024, 1, 1) and times[-1] == datetime.datetime(2024, 1, 30, 23)
    assert reduce.minmax_lttb(hourly, "ts", ["col_a"], 2).count() == 720


def test_sliding_count_without_finite_values_is_null(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01' ts, cast('NaN' as double) v union all select timestamp_ntz'2024-01-01 01:00:00', 1.0")
    rows = reduce.tumbling_aggregate(df, "ts", ["v"], 1_800_000, "count").orderBy("ts").collect()
    assert [r.v for r in rows] == [None, 1.0]


def test_expressions(spark):
    df = spark.createDataFrame([(0.0, 2.0), (-3.0, 4.0)], "a double, b double")
    value = lambda t: [r[0] for r in df.select(expr.parse(t, df.columns)).collect()]
    assert value("a * b / 2 + 1") == [1.0, -5.0]
    assert value("-(a - b) * 1e1") == [20.0, 70.0]
    assert value("b / a")[0] == math.inf and value("log(a)")[0] == -math.inf and math.isnan(value("log(a)")[1])
    for bad in ("a +", "nope(a)", "c", "a b", ""):
        with pytest.raises(ValueError):
            expr.parse(bad, df.columns)


def test_filters_parse():
    assert filters.parse_range_filters(" ") == [] and filters.parse_columns("") == ["value"]
    assert not filters.parse_line_filters('[{"column":"v","x1":0,"y1":1,"x2":2,"y2":3,"keepAbove":false}]')[0].keep_above
    with pytest.raises(ValueError):
        filters.parse_range_filters("{invalid")
    with pytest.raises(ValueError):
        filters.parse_range_filters('[{"column":"v","from":0,"to":1,"x":2}]')


def test_spectrum_finds_the_sinusoid(spark):
    df = spark.range(512).select(F.timestamp_seconds(F.col("id")).cast("timestamp_ntz").alias("ts"), F.sin(F.col("id") * (2 * math.pi * 32 / 512)).alias("v"))
    top = spectral.dominant_peaks(spectral.spectrum(df, "ts", ["v"])).where("rank = 1").head()
    assert top.bin == 32 and top.frequency == pytest.approx(1 / 16)
    same = spectral.spectral_filter(df, "ts", "v", "lowpass").collect()
    assert max(abs(r.original - r.filtered) for r in same) < 1e-9


def test_drift(hourly, spark):
    out = drift.drift(hourly, "ts", "col_c", "daily", "2024-01-01", "2024-01-08").collect()
    assert len(out) == 23 and {r.level for r in out} == {"red"}
    assert drift.drift(hourly, "ts", "col_c", "daily", "2024-01-01", "2024-01-08", threshold=123.456).head().threshold == 123.456
    with pytest.raises(ValueError):
        drift.drift(hourly, "ts", "col_c", "daily", "2024-01-01T00:00", "2024-01-01T01:00")
    both = spark.range(50).selectExpr("double(id) v").transform(lambda a: drift.two_samples(a, a.selectExpr("v + 100 as v"), "v"))
    assert drift.ks(both).head().d == 1.0


def test_chain_is_found(spark):
    rng, x = np.random.default_rng(1), np.zeros((500, 3))
    for t in range(1, 500):
        u = rng.uniform(-0.5, 0.5, 3)
        x[t] = [u[0], 0.7 * x[t - 1, 0] + 0.3 * u[1], 0.7 * x[t - 1, 1] + 0.3 * u[2]]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "ts int, X double, Y double, Z double")
    for method in ("pcmci", "pcmciplus", "fullci", "bivci", "lpcmci"):
        found = {(r.source, r.target, r.lag) for r in discovery.causal_links(df, ["X", "Y", "Z"], 2, method).collect()}
        assert {("X", "Y", 1), ("Y", "Z", 1)} <= found, method
    q = discovery.benjamini_hochberg([0.01, 0.02, 0.03])
    assert q == sorted(q) and max(q) <= 1


def test_independence_tests():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=400), rng.normal(size=400)
    for name, test in independence.TESTS.items():
        if name != "gsquared":  # its bins hold too few rows here
            assert test(x, y, np.zeros((0, 0)))[1] > 0.01, name
        assert test(x, 0.8 * x + 0.2 * y, np.zeros((0, 0)))[1] < 0.06, name


def test_load_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("timekey,value,other\n1700000000,1,10\n1700000001,2,20\n")
    data = readers.load(spark, str(path), readers.LoadOptions(time_column="timekey", columns=["value"]))
    assert data.ts == "timekey" and data.df.columns == ["timekey", "value"]
    assert data.df.agg(F.min("timekey")).head()[0] == datetime.datetime(2023, 11, 14, 22, 13, 20)
    with pytest.raises(ValueError):
        readers.load(spark, str(path))
    assert readers.preview_time_column(readers.preview_csv(spark, str(path))) == "timekey"
    assert [readers.epoch_unit(v) for v in (0, 99_999_999_999, 100_000_000_000, 100_000_000_000_000, 100_000_000_000_000_000)] == [None, "s", "ms", "us", "ns"]
    with pytest.raises(ValueError):
        readers.identifier("a;b")


def test_explorer(hourly, tmp_path):
    ex = Explorer(Dataset(hourly, "ts"))
    assert ex.data("2024-01-01", "2024-01-30", 50, "col_a").count() <= 100
    assert ex.aggregate("2024-01-01", "2024-01-30", "col_a,col_b", buckets=10).count() == 10
    assert ex.transform("col_a + 1", "d").revision == 1
    done = ex.remove_outliers(["col_c"], "zscore", 1.0)
    assert done["before"] - done["after"] == done["removed"] > 0
    assert len(ex.log.drain()) == 4
    with pytest.raises(ValueError):
        ex.data("2024-01-02", "2024-01-01", 50, "col_a")
    sinks.export_series(hourly, "ts", ["col_a"], str(tmp_path / "x.parquet"))
    assert len(sinks.to_arrow_stream(hourly.limit(5), "ts")) > 100


def test_pipeline(hourly):
    p = Pipeline().then(time_filter("ts", "2024-01-02", "2024-01-03")).then(project(["ts", "col_a"])).then(reduction("ts", ["col_a"], "bucket", buckets=4))
    assert p.apply(hourly).count() == 4 and p.explain() == "time_filter -> project -> bucket"


def test_cache_and_log():
    now = [0.0]
    cache = ResultCache(seconds=1, entries=2, clock=lambda: now[0])
    for k in "abc":
        cache.put(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 2.0
    assert cache.get("c") is None
    log = QueryLog()
    assert [log.add("x"), log.add("y")] == [1, 2]


def test_correlation_of_a_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert stats.pearson(df, "a", "b").head()[0] is None


def test_stream_equals_batch(spark, tmp_path):
    synthetic.sinusoids(spark).write.parquet(str(tmp_path / "in"))
    rows = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    windows.to_parquet(windows.windowed(stream, "timestamp", ["temperature"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    made, whole = spark.read.parquet(str(tmp_path / "out")), windows.windowed(rows, "timestamp", ["temperature"], "1 hour")
    assert made.count() > 160 and made.subtract(whole).count() == 0


def test_epoch_units_are_exact(spark):
    """Nanoseconds beyond 2**53 and times before 1970: whole microseconds, rounded down."""
    import random

    from tidelens.functions.columns import floor_div

    draw = random.Random(4)
    us = [draw.randrange(-(2**50), 2**52) for _ in range(10_000)]
    rows = spark.createDataFrame([(u, u * 1000 + draw.randrange(1000)) for u in us], "us long, ns long")
    out = readers.normalise_time(rows, "ns", "ns").select("us", F.unix_micros(F.col("ns").cast("timestamp")).alias("got"))
    assert out.where("us <> got").count() == 0
    assert rows.select("us", floor_div(F.col("us"), 7).alias("q")).where("q <> floor(cast(us as decimal(38,0)) / 7)").count() == 0


@pytest.mark.parametrize(("held", "look"), [(200_000, 10_000), (900, 100), (0, 100)])
def test_order_statistics(spark, monkeypatch, held, look):
    """All values in one bracket, brackets of a first look, and running sums: the same places."""
    monkeypatch.setattr(stats, "HELD", held)
    monkeypatch.setattr(stats, "LOOK", look)
    draw = np.random.default_rng(1)
    x = {"a": np.round(draw.normal(size=3000), 2), "b": draw.exponential(size=3000), "c": np.array([7.0])}
    rows = [(name, float(v)) for name, values in x.items() for v in values] + [("a", None), ("d", None)]
    long = spark.createDataFrame(rows, "series string, x double").repartition(5)
    found = stats.quantiles(long, [0.0, 0.25, 0.5, 0.75, 1.0], [F.max("x").alias("top")])
    for name, values in x.items():
        row, got = found[name]
        assert row["n"] == len(values) and row["top"] == values.max()
        assert got == pytest.approx(np.quantile(values, [0.0, 0.25, 0.5, 0.75, 1.0]).tolist(), abs=1e-12)
    assert found["d"][1] == [None] * 5


@pytest.mark.parametrize("held", [200_000, 0])
def test_ranks(spark, monkeypatch, held):
    import pandas as pd

    monkeypatch.setattr(stats, "RANKED", held)
    draw = np.random.default_rng(2)
    frame = pd.DataFrame({"a": draw.integers(0, 9, 400), "b": draw.normal(size=400), "c": np.where(draw.random(400) < 0.2, np.nan, draw.normal(size=400))})
    frame["c"] += frame["a"]
    df = spark.createDataFrame(frame.astype(float)).replace(float("nan"), None)
    got = {(r.col_i, r.col_j): (r.pearson, r.spearman) for r in stats.correlation_matrix(df, ["a", "b", "c"]).collect()}
    for i in "abc":
        for j in "abc":
            both = frame[[i, j]].dropna() if i != j else frame[[i]].dropna().assign(k=1)
            if i != j:
                ranks = both.rank()
                assert got[i, j] == pytest.approx((np.corrcoef(both[i], both[j])[0, 1], np.corrcoef(ranks[i], ranks[j])[0, 1]), abs=1e-9)
            else:
                assert got[i, j] == (1.0, 1.0)


def test_windows_against_a_reference(spark):
    """KS and Wasserstein of several windows with ties, against both empirical functions."""
    draw = np.random.default_rng(3)
    ref = np.round(draw.normal(size=200), 1)
    windows = {0: np.round(draw.normal(0.5, 2, 60), 1), 1: np.round(draw.normal(size=5), 1), 2: np.array([9.0] * 6), 3: np.array([-9.0, 9.0, 0.0, 0.05, 0.1])}
    counts = spark.createDataFrame([(w, float(v), int(c)) for w, x in windows.items() for v, c in zip(*np.unique(x, return_counts=True), strict=True)], "w long, v double, c long")
    sizes = spark.createDataFrame([(w, len(x)) for w, x in windows.items()], "w long, nw long")
    placed = rowindex.with_row_index(spark.createDataFrame([(float(v),) for v in ref], "v double"), "v")
    got = {r.w: (r.ks, r.wasserstein) for r in drift.against_reference(counts, sizes, placed.groupBy("v").agg(F.count("*").alias("r")), placed, len(ref)).collect()}
    for w, x in windows.items():
        axis = np.unique(np.concatenate((ref, x)))
        f, g = ((s[:, None] <= axis).mean(axis=0) for s in (ref, x))
        assert got[w] == pytest.approx((np.abs(f - g).max(), float((np.abs(f - g)[:-1] * np.diff(axis)).sum())), abs=1e-9)


def test_latent_causes():
    """A chain keeps its lagged links; a hidden common cause leaves an open link at lag 0; a collider is pointed at."""
    from tidelens.operators.causal.lagged import Series

    draw = np.random.default_rng(4)
    n = 1500
    x, y, z = (np.zeros(n) for _ in range(3))
    e = draw.normal(size=(3, n))
    for t in range(1, n):
        x[t] = e[0, t]
        y[t] = 0.8 * x[t - 1] + e[1, t]
        z[t] = 0.8 * y[t - 1] + e[2, t]
    run = discovery.Runner(Series(np.stack([x, y, z], axis=1), ["x", "y", "z"]), 2)
    links = discovery.discover(run, "lpcmci", alpha=0.001)
    assert {(link["source"], link["target"], link["lag"], link["type"]) for link in links} >= {(0, 1, 1, "-->"), (1, 2, 1, "-->")}
    assert not any(link["lag"] == 1 and (link["source"], link["target"]) == (2, 0) for link in links)
    hidden = draw.normal(size=n)
    a, b = hidden + draw.normal(size=n), hidden + draw.normal(size=n)
    links = discovery.discover(discovery.Runner(Series(np.stack([a, b], axis=1), ["a", "b"]), 1), "lpcmci", alpha=0.001)
    assert [(link["source"], link["target"], link["lag"], link["type"]) for link in links] == [(0, 1, 0, "o-o")]


def test_colliders_of_open_links():
    """Two causes of one variable, apart from each other whatever is given: both links point at it."""

    class Told:
        series, tau_max = type("S", (), {"names": ["a", "b", "c"]}), 1

        def many(self, asked):
            return [(0.5, 0.0) if {i, j} in ({0, 2}, {1, 2}) and not lag else (0.0, 1.0) for (i, lag), j, _ in asked]

    links = discovery.discover(Told(), "lpcmci")
    assert [(link["source"], link["target"], link["lag"], link["type"]) for link in links] == [(0, 2, 0, "-->"), (1, 2, 0, "-->")]


def test_range_filter_of_whole_numbers_reaches_the_scan(spark, sf):
    rows = filters.apply_filters(spark.read.parquet(f"{sf}/events.parquet"), "ts", ranges=[filters.RangeFilter("user_id", 9.5, 20.2)])
    plan = rows.select("value")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,10)" in plan and "LessThanOrEqual(user_id,20)" in plan


def test_results_for_one_reader_are_bounded(hourly):
    with pytest.raises(ValueError, match="more than 10 rows"):
        sinks.to_arrow_stream(hourly, most=10)
    assert sinks.to_json_columns(hourly.limit(2), "ts", ["col_a"]).startswith('{"ts": [1704067200000')


def test_cached_results_count_their_bytes(hourly):
    explorer = Explorer(Dataset(hourly, "ts"))
    first = explorer.data("2024-01-01", "2024-01-20", 50, "col_a")
    assert explorer.data("2024-01-01", "2024-01-20", 50, "col_a") is first and first.count() > 0
    assert sum(size for _, size, _ in explorer.cache.held.values()) > 0


def test_rolling_bands_by_group(spark):
    rows = spark.createDataFrame([(i, i % 3, float(i * i % 17)) for i in range(300)], "t long, k long, v double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    together = ordered.rolling_bands(rows, "ts", "v", 7, "ts", by="k")
    for k in range(3):
        alone = ordered.rolling_bands(rows.where(F.col("k") == k), "ts", "v", 7, "ts")
        got = sorted(tuple(r)[1:] for r in together.where(F.col("k") == k).collect())
        assert [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in sorted(map(tuple, alone.collect()))]


def test_minmax_lttb_against_plain_loops(spark):
    """Which rows are kept, by the paper's two steps written out."""
    draw = np.random.default_rng(6)
    y = np.cumsum(draw.normal(size=1200)).round(3)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, v double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    target = 40
    n, bins, found = len(y), target * reduce.MINMAX_RATIO // 2, {}
    for i in range(1, n - 1):
        found.setdefault((i - 1) * bins // (n - 2), []).append(i)
    few = sorted({0, n - 1, *(min(b, key=lambda i: (y[i], i)) for b in found.values()), *(max(b, key=lambda i: (y[i], -i)) for b in found.values())})
    edges = [int(1 + k * (len(few) - 2) / (target - 2)) for k in range(target - 1)]
    kept = [0]
    for b in range(target - 2):
        ahead = few[edges[b + 1] : edges[b + 2]] if b + 1 < target - 2 else few[-1:]
        cx, cy = sum(ahead) / len(ahead), sum(y[i] for i in ahead) / len(ahead)
        a = kept[-1]
        kept.append(max(few[edges[b] : edges[b + 1]], key=lambda i: abs((a - cx) * (y[i] - y[a]) - (a - i) * (cy - y[a]))))
    kept.append(few[-1])
    got = [r.v for r in reduce.minmax_lttb(rows, "ts", ["v"], target, "ts").collect()]
    assert got == [float(y[i]) for i in kept]
    pairs = reduce.downsample_pairs(rows.withColumn("colour", F.col("t") * 2), "v", target, "t").collect()
    assert sorted((r.v, r.colour) for r in pairs) == sorted((float(y[i]), 2 * i) for i in kept)


@pytest.mark.parametrize(("kind", "low", "high"), [("lowpass", None, 0.1), ("highpass", 0.2, None), ("bandpass", 0.1, 0.3), ("bandstop", 0.1, 0.3)])
def test_spectral_filter_against_sums(spark, kind, low, high):
    draw = np.random.default_rng(7)
    x = draw.normal(size=64)
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "t long, v double").withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))
    n, mean = len(x), x.mean()
    k = np.arange(n)
    f = np.minimum(k, n - k) / n
    keep = {"lowpass": f <= (high or 0), "highpass": f >= (low or 0), "bandpass": (f >= 0.1) & (f <= 0.3), "bandstop": (f < 0.1) | (f > 0.3)}[kind]
    wave = np.exp(-2j * np.pi * np.outer(k, k) / n)
    want = (np.conj(wave) @ (keep * (wave @ (x - mean)))).real / n + mean
    out = spectral.spectral_filter(rows, "ts", "v", kind, low, high).orderBy("ts").collect()
    assert [r.filtered for r in out] == pytest.approx(want.tolist(), abs=1e-9)


def test_scatter_samples_keep_their_colours(hourly):
    from tidelens.operators import scatter

    got = scatter.scatter_points(hourly, "ts", "col_c", "col_a", "col_b", sample=50).collect()
    assert len(got) == 50
    rows = {(r.col_c, r.col_a): r.col_b for r in hourly.collect()}
    assert all(rows[r.x, r.y] == r.colour for r in got)


def test_database_catalogue(spark):
    """Tables of both kinds, types, and the time column found by itself; a stand-in answers the statements."""

    class Told(readers.Database):
        def query(self, spark, text):
            if "pg_extension" in text:
                return spark.createDataFrame([(1,)], "one int")
            if "hypertable" in text:
                return spark.createDataFrame([("public", "metrics", 7)], "table_schema string, table_name string, row_estimate long")
            if "information_schema.tables" in text:
                return spark.createDataFrame([("public", "metrics"), ("public", "users")], "table_schema string, table_name string")
            if "information_schema.columns" in text:
                rows = [("id", "integer", "NO", 1), ("at", "timestamp with time zone", "YES", 2), ("load", "numeric", "YES", 3), ("tag", "jsonb", "YES", 4)]
                return spark.createDataFrame(rows, "column_name string, data_type string, is_nullable string, ordinal_position int")
            assert 'order by "at"' in text and 'from "public"."metrics"' in text
            return spark.createDataFrame([("2024-01-01 00:00:00", "1.5", 3), ("no time", "x", 4)], "at string, load string, id int")

    db = Told("jdbc:postgresql://host/db")
    assert {(r.table_name, r.kind, r.row_estimate) for r in db.tables(spark).collect()} == {("metrics", "hypertable", 7), ("users", "table", None)}
    assert [r["dtype"] for r in db.columns(spark, "public", "metrics").orderBy("ordinal_position").collect()] == ["int", "timestamp", "double", "string"]
    data = readers.load_table(spark, db, "public", "metrics")
    assert data.ts == "at" and [(r.load, r.id) for r in data.df.orderBy("id").collect()] == [(1.5, 3), (None, 4)]
    with pytest.raises(ValueError, match="none of the columns"):
        readers.load_table(spark, db, "public", "metrics", ["nope"])


def test_samples_rates_and_errors():
    from tidelens.plans import limits

    assert readers.sample_path("ETTm2.csv", "/data/") == "/data/ETTm2.csv"
    with pytest.raises(ValueError, match="no sample"):
        readers.sample_path("../etc/passwd", "/data")
    now = [0.0]
    limiter = limits.RateLimiter(2, 60, clock=lambda: now[0])
    assert [limiter.check("a") for _ in range(3)] == [(True, 1, None), (True, 0, None), (False, 0, 60)]
    assert limiter.check("b")[0]
    now[0] = 61
    assert limiter.check("a") == (True, 1, None)
    counters = limits.Counters()
    for name in ("hit", "hit", "miss"):
        counters.add(name)
    assert counters.ratio("hit", "miss") == pytest.approx(2 / 3) and counters.ratio("x", "y") == 0
    assert [limits.status_of(e) for e in (ValueError(), FileNotFoundError(), RuntimeError())] == [400, 404, 500]


def test_causal_exports(spark):
    import json

    links = spark.createDataFrame([("a", "b", 1, 0.5, 0.01, "-->"), ("a", "b", 2, 0.3, 0.02, "-->"), ("b", "c", 0, 0.2, 0.03, "o-o")], discovery.EDGES)
    out = json.loads(discovery.links_json(links, ["a", "b", "c"], 2, "pcmci"))
    assert out["nodes"] == ["a", "b", "c"] and len(out["links"]) == 3 and out["metadata"] == {"tau_max": 2, "method": "pcmci"}
    graph = discovery.graph_arrays(links, ["a", "b", "c"])
    assert graph["edge_index"] == [[0, 1], [1, 2]] and graph["edge_attr"][0] == [2, 1, 2, pytest.approx(0.4), 0.01]


def test_drift_metadata(hourly):
    windows = drift.drift(hourly, "ts", "col_c", "daily", "2024-01-01", "2024-01-03", permutations=False)
    row = drift.drift_metadata(windows, 49).head()
    assert row.windows == windows.count() and row.effective_bins == 20 and not row.bin_warning and row.mean_n == pytest.approx(24, abs=1)


def test_plain_kde(spark):
    x = np.random.default_rng(9).normal(size=300)
    got = stats.kde(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 50, plain=True).orderBy("k").collect()
    h = 1.06 * x.std() * len(x) ** -0.2
    at = x.min() + (x.max() - x.min()) * (np.arange(50) + 0.5) / 50
    assert [r.x for r in got] == pytest.approx(at.tolist())
    assert [r.density for r in got] == pytest.approx((np.exp(-0.5 * ((x[:, None] - at) / h) ** 2).sum(axis=0) / (len(x) * h * math.sqrt(2 * math.pi))).tolist())


def test_exports_are_filtered(hourly, tmp_path):
    sinks.export_series(hourly, "ts", ["col_a"], str(tmp_path / "series.parquet"), ranges=[filters.RangeFilter("col_c", 10, 20)])
    out = hourly.sparkSession.read.parquet(str(tmp_path / "series.parquet"))
    assert out.columns == ["ts", "col_a"] and out.count() == 101
    sinks.export_scatter(hourly, "ts", ["col_a", "col_b", None], str(tmp_path / "scatter.parquet"), start="2024-01-02", end="2024-01-03")
    out = hourly.sparkSession.read.parquet(str(tmp_path / "scatter.parquet"))
    assert out.columns == ["col_a", "col_b"] and out.count() == 25
