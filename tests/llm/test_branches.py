"""Plans that depend on sizes give one result on both sides of the bound; odd rows have the results that the docstrings state."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import common, language, neardup, registry, urls, vectors, warc


def rows(df):
    return Counter(map(str, df.collect()))


@pytest.fixture(scope="module")
def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


@pytest.fixture(scope="module")
def points(spark):
    draw = np.random.default_rng(8)
    centres = draw.normal(size=(6, 12))
    x = [(centres[i % 6] + 0.1 * draw.normal(size=12)).tolist() for i in range(300)]
    return spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>")


def test_join_uneven(spark):
    left = spark.createDataFrame([(k, i) for k, n in ((1, 2000), (2, 3), (4, 1)) for i in range(n)] + [(None, 0)], "k long, i long")
    right = spark.createDataFrame([(1, 2000, "a"), (2, 3, "b"), (3, 1, "c")], "k long, n long, name string")
    for how in ("inner", "left"):
        assert rows(common.join_uneven(left, right, "k", "n", how).select("k", "i", "name")) == rows(left.join(right.drop("n"), "k", how).select("k", "i", "name"))


def test_originals_beyond_the_broadcast(spark, pages, monkeypatch):
    pages = pages.union(pages.withColumn("page_id", F.col("page_id") + 10**6)).union(pages.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 10**7))
    want = rows(warc.resolve_revisits(pages, 1))
    assert any("refers_to=None" not in r for r in want)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert rows(warc.resolve_revisits(pages, 1).select(*warc.resolve_revisits(pages, 1).columns)) == want


def test_texts_beyond_the_broadcast(docs, monkeypatch):
    want = rows(neardup.near_duplicates(docs))
    monkeypatch.setattr(neardup, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(neardup, "TILE", 2)
    assert rows(neardup.near_duplicates(docs)) == want


def test_priors_beyond_the_broadcast(spark, sf, pages, monkeypatch):
    labelled = spark.read.parquet(f"{sf}/documents.parquet")
    want = rows(language.identify_pages(pages, labelled).drop("url", "html"))
    monkeypatch.setattr(language, "BROADCAST_HOSTS", 0)
    monkeypatch.setattr(language, "BROADCAST_SAMPLE", 0)
    assert rows(language.identify_pages(pages, labelled).drop("url", "html")) == want


def rounded(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 12)) for r in df.collect())


def test_large_buckets_are_split(points, monkeypatch):
    want = rounded(vectors.nearest(points, every=10))
    for most in (10**6, 20):
        monkeypatch.setattr(vectors, "BUCKET_ROWS", 7)
        monkeypatch.setattr(vectors, "BROADCAST_BUCKETS", most)
        assert rounded(vectors.nearest(points, every=10)) == want


def test_small_tiles_give_the_same_links(points, monkeypatch):
    want = rows(vectors.near_links(points))
    monkeypatch.setattr(vectors, "TILE", 16)
    assert rows(vectors.near_links(points)) == want and any("n_links=0" not in r for r in want)
    monkeypatch.setattr(vectors, "TILES", 3)
    assert rows(vectors.near_links(points)) == want


def test_every_row_of_vectors_comes_back(spark):
    """A key with a usable and an unusable vector, null keys, repeated rows, clashing names."""
    v, w = [1.0, 0.0], [0.0, 1.0]
    data = [(1, v), (1, None), (2, v), (2, v), (3, w), (None, v), (4, [0.0, 0.0]), (5, [float("nan"), 1.0])]
    table = spark.createDataFrame([(i, x, 9, 9) for i, x in data], "vec_id long, embedding array<double>, cls int, n_links int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_links(table).collect())
    assert got == Counter({(1, 2, 1, True): 1, (1, 0, 1, True): 1, (2, 2, 1, False): 2, (3, 0, 3, True): 1, (None, 0, None, True): 1, (4, 0, 4, True): 1, (5, 0, 5, True): 1})


def test_a_repeated_query_key_has_one_query(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.5, 2.0]), (0, None), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.1, 1.0])], "vec_id long, embedding array<double>")
    for _ in range(2):
        got = [(r.query_id, r["rank"], r.vec_id) for r in vectors.nearest(table.repartition(3), every=50, size=(2, 50.0, 2, 9)).orderBy("rank").collect()]
        assert got == [(0, 1, 2), (0, 2, 3), (0, 3, 1)]


def test_recall_on_more_vectors(spark):
    """Recall of the 5 nearest on 2,000 vectors of the given tables, against brute force."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    keep = [(r.vec_id, np.array(r.embedding, float)) for r in table.collect() if r.embedding and None not in r.embedding]
    size = Counter(len(v) for _, v in keep).most_common(1)[0][0]
    keep = [(i, v) for i, v in keep if len(v) == size and np.isfinite(v).all() and v.any()]
    ids, u = np.array([i for i, _ in keep]), np.stack([v / np.linalg.norm(v) for _, v in keep])
    found: dict[int, set] = {}
    for r in vectors.nearest(table).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = asked = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        hits, asked = hits + len(found[int(ids[q])] & set(ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist())), asked + 5
    assert hits >= 0.9 * asked


def test_odd_pages(spark):
    """Null, empty and very long values, repeated rows, an empty table, and columns named like the operators' own."""
    long = "http://x.example.org/" + "p/" * 40_000
    data = [(1, None, None), (2, "", ""), (3, long, "y" * 300_000), (3, long, "y" * 300_000), (None, "http://a.com/en/", "z" * 2000), (4, "http://a.com/en/", "z" * 2000)]
    table = spark.createDataFrame([(i, u, h, "own", "own") for i, u, h in data], "page_id long, url string, html string, verdict string, payload string")
    out = warc.round_trip(table).collect()
    assert Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == Counter([
        (1, 0, "response", None), (2, 0, "response", None), (3, 300_000, "response", None), (3, 300_000, "response", None), (None, 2000, "revisit", 4), (4, 2000, "response", None),
    ])
    judged = urls.judge(table, registry.URL_RULES)
    assert judged.columns == [*table.columns, "host", "path", "rule", "verdict_", "score"]
    got = judged.collect()
    assert len(got) == 6 and {r.verdict for r in got} == {"own"} and [r["verdict_"] for r in got if r.url and "a.com" in r.url] == ["block"] * 2
    assert {len(r.path) for r in got if r.page_id == 3} == {len(long) - len("http://x.example.org")}
    named = table.select("page_id", "url", "html", F.lit("own").alias("language"), F.lit(1).alias("text__"))
    found = language.identify_pages(named, spark.createDataFrame([("some english text here", "en")], "text string, lang string")).collect()
    assert len(found) == 6 and all(r.language == "own" and r["text__"] == 1 for r in found)
    assert urls.judge(table.limit(0), registry.URL_RULES).count() == language.identify_pages(named.limit(0), spark.createDataFrame([], "text string, lang string")).count() == 0


def test_scratch_tables_can_be_removed(spark):
    from pathlib import Path

    path = common.scratch(spark, "test")
    spark.range(3).write.parquet(path)
    assert Path(path.removeprefix("file://")).exists()
    kept = list(common._MADE)
    common._MADE[:] = [path]
    common.remove_scratch(spark)
    assert not Path(path.removeprefix("file://")).exists()
    common._MADE[:] = kept[:-1]
