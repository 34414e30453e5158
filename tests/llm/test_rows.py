"""Vectors, near duplicates, languages, archives, URLs and the pipeline: against brute force and round trips."""

import hashlib
import os
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tidelens.llm import language, neardup, registry, urls, vectors, warc
from tidelens.llm.common import utf8
from tidelens.llm.graph import components


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.a: r.b for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_components_by_rounds(spark, monkeypatch):
    """More links than one task takes: the rewrites give what one task gives."""
    edges = [(i, i + 1) for i in range(40) if i % 7] + [(100, 3), (50, 100), (9, 9), (None, 1)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    one = sorted(tuple(r) for r in components(frame).collect())
    monkeypatch.setattr("tidelens.llm.graph.TASK_LINKS", 0)
    assert sorted(tuple(r) for r in components(frame).collect()) == one
    assert components(frame.where("a < 0")).count() == 0


def test_one_of_each_keys(spark):
    """Rows without a key stay, rows with the same key and text leave one, and hashes that collide change nothing."""
    same = " ".join(f"w{i}" for i in range(20))
    rows = [(1, same), (2, same), (3, "quite another text of six words"), (3, "quite another text of six words"), (None, same), (4, None), (5, "")]
    left = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id for r in left.collect()), key=lambda x: x or 0) == [None, 1, 3, 4, 5]
    few = pytest.MonkeyPatch()
    few.setattr(neardup, "SLOTS", 1)
    try:
        left = neardup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted((r.doc_id for r in left.collect()), key=lambda x: x or 0) == [None, 1, 3, 4, 5]
    finally:
        few.undo()


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    x = [(c + 0.15 * rng.normal(size=16)).tolist() for c in centres for _ in range(15)]
    x += [x[0], x[0], None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 3, []]
    return spark.createDataFrame([(i, v, 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, n_links int")


def test_near_links(spark, clouds):
    rows = [(r.vec_id, r.embedding) for r in clouds.collect()]
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = u @ u.T >= 0.9
    root = roots(len(good), zip(*np.nonzero(hit), strict=True))
    want = {i: (0, i) for i, _ in rows} | {i: (int(hit[k].sum()) - 1, good[root[k]][0]) for k, (i, _) in enumerate(good)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_links(clouds).collect()}
    assert got == want and max(n for n, _ in got.values()) >= 10
    assert vectors.near_links(clouds.limit(0)).count() == 0


def test_search_recall(spark, clouds, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    for rows, every in ((clouds, 10), (table, 50)):
        keep = [(r.vec_id, np.array(r.embedding, float)) for r in rows.collect() if r.embedding and len(r.embedding) > 3 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
        ids, u = np.array([i for i, _ in keep]), np.stack([v / np.linalg.norm(v) for _, v in keep])
        found, hits, asked = {}, 0, 0
        for r in vectors.nearest(rows, every=every).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        for q in np.flatnonzero(ids % every == 0):
            s = u @ u[q]
            s[q] = -9
            best = ids[np.lexsort((ids, -np.round(s, 12)))[:5]].tolist()
            got = sorted(found[int(ids[q])])
            assert [r for r, _, _ in got] == [1, 2, 3, 4, 5]
            assert all(abs(s[np.flatnonzero(ids == v)[0]] - x) < 1e-9 for _, v, x in got)
            hits, asked = hits + len(set(best) & {v for _, v, _ in got}), asked + 5
        assert hits >= 0.9 * asked
    assert vectors.nearest(clouds.limit(0)).count() == 0


def brute_neardup(rows):
    raw, off = utf8(pa.array([t for _, t in rows], pa.string()))
    e, c, at = neardup.shingles(raw, off)
    own = lambda i: (e[at[i] : at[i + 1]], c[at[i] : at[i + 1]])
    links = [(i, j) for i in range(len(rows)) for j in range(i) if neardup.probability_jaccard(*own(i), *own(j)) >= 0.8 - 1e-12]
    return roots(len(rows), links)


def test_neardup(spark, docs, odd):
    rows = [tuple(r) for r in docs.collect()]
    root = brute_neardup(rows)
    least = {}
    for (i, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, i), i)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == {i: least[r] for (i, _), r in zip(rows, root, strict=True)}
    got = Counter((r.doc_id, r.component_id, r.n_rows, r.kept) for r in neardup.near_duplicates(odd).collect())
    assert got[5, 4, 3, False] == 2 and got[6, 6, 2, True] == 1 and got[7, 6, 2, False] == 1 and got[1, 1, 1, True] == 1
    left = neardup.one_of_each(odd)
    assert left.columns == odd.columns and [r.doc_id for r in left.where("text = 'a b'").collect()] == [4]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_registers_estimate_the_similarity():
    a = [f"w{i}" for i in range(400)]
    texts = [" ".join(a), " ".join(a[:340] + [f"x{i}" for i in range(60)]), " ".join(a * 2)]
    e, c, at = neardup.shingles(*utf8(pa.array(texts)))
    s = np.mean([[(x[0] == x[k]).mean() for k in (1, 2)] for x in [neardup.signatures(e, c, at, 2000)]], axis=0)
    true = [neardup.probability_jaccard(e[at[0] : at[1]], c[at[0] : at[1]], e[at[k] : at[k + 1]], c[at[k] : at[k + 1]]) for k in (1, 2)]
    assert np.abs(s - true).max() < 0.05


def test_language_accuracy(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = language.identify_documents(docs)
    both = out.where("n_chars > 200")
    assert both.where("language = lang").count() >= 0.9 * both.count() and out.where("accepted").count() >= 0.9 * out.count()
    strange = language.identify_documents(odd.withColumnRenamed("kept", "lang").withColumnRenamed("rank", "source")).collect()
    assert all(r.language == "und" and not r.accepted for r in strange if not (r.text or "").strip())
    assert language.identify_documents(empty).count() == 0
    pages = language.identify_pages(spark.read.parquet(f"{sf}/pages.parquet"), docs)
    assert pages.where("accepted").count() >= 0.9 * pages.count()


def test_archives(spark, sf):
    big = "x" * 1200
    extra = spark.createDataFrame([(9001, "http://a/", big), (9002, None, big), (9003, "http://b/\n", "short"), (9004, "", "short"), (9005, "u", None), (9006, "é", "\r\n\r\nWARC/1.1\r\n" + "é" * 800), (None, "n", big)], "page_id long, url string, html string")
    pages = spark.read.parquet(f"{sf}/pages.parquet").unionByName(extra)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    top = {}
    for i, p in rows:
        if i is not None and len(p) >= 1000:
            top[p] = max(top.get(p, i), i)
    want = Counter((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if top.get(p, i) != i else "response", top[p] if top.get(p, i) != i else None) for i, p in rows)
    out = warc.round_trip(pages).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    payloads = dict(rows)
    assert all(bytes(r.payload) == payloads[r.page_id] for r in out if r.record_type == "response" and r.page_id is not None)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_urls(spark, sf):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "no scheme/en/"), (4, "http://A.Example.COM/en/71?x#y"), (5, "http://x.com/en/"), (6, "https://com/en/q"), (7, "http://xcom/en/"), (8, "a://b.net?p/de/"), (9, "h://e.example.net/de/8"), (10, "h://q.net/de/9")], "page_id long, url string")
    out = {r.page_id: r for r in urls.judge(odd, registry.URL_RULES).collect()}
    assert [(out[i].host, out[i].path) for i in (1, 3, 4, 8)] == [("", ""), ("", ""), ("a.example.com", "/en/71"), ("b.net", "")]
    assert [out[i].rule for i in range(1, 11)] == [None, None, None, "example.com/en/7", "com/en/", "com/en/", None, None, "example.net/de/8", "net/de/"]
    assert [out[i].verdict for i in (4, 5, 9, 10)] == ["allow", "block", "block", "allow"] and {r.verdict for r in out.values()} <= {"allow", "block"}
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    judged = urls.judge(pages, registry.URL_RULES)
    assert judged.count() == pages.count() and judged.where("verdict is null or (rule is null) = (score is null)").count() == 0
    assert urls.judge(odd.limit(0), registry.URL_RULES).count() == 0


def test_models_separate_held_out_urls():
    good, bad = [f"https://a.example.com/en/7{i}" for i in range(200)], [f"https://b.example.org/es/{i}" for i in range(200)]
    ratio = urls.Ratio(good[:150], bad[:150])
    at = urls.calibrate([(ratio.score(u), True) for u in good[:150]] + [(ratio.score(u), False) for u in bad[:150]])
    assert all(ratio.score(u) >= at for u in good[150:]) and all(ratio.score(u) < at for u in bad[150:])


def test_pipeline(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    rows = out.collect()
    whole = spark.read.parquet(f"{sf}/documents.parquet")
    docs = whole
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == whole.columns, name
        assert after.select("doc_id").distinct().count() == after.count() <= docs.count()
        docs = spark.createDataFrame(after.collect(), whole.schema)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()}


def test_the_rest_does_not_need_this_package(tmp_path):
    """A copy of the repository without the folders and the pipeline imports, and has all other queries."""
    top = Path(corpus_pipeline.__file__).parent
    shutil.copytree(top / "tidelens", tmp_path / "tidelens", ignore=shutil.ignore_patterns("llm"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    (tmp_path / "tidelens/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e, sys; names = set(e.queries()); assert len(names) > 60 and not any(n.startswith('op') for n in names) and 'pipeline' not in names; e.oracle_sql(); assert 'corpus_pipeline' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)})
