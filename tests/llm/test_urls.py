"""The URL models' counts and threshold come from all that rules judge."""

import zlib

import numpy as np
import pytest

from tidelens.llm import registry, urls


def test_models_and_threshold_come_from_all_judged_urls(spark, monkeypatch):
    """More URLs of a class than 4,000, some of any length, some of other alphabets, repeated and unusable ones."""
    draw = np.random.default_rng(5)
    name = lambda n: "".join(draw.choice(list("abcdefgh-/é中😀"), n))
    made = [f"http://{name(3).replace('/', '')}.com/en/{name(8)}" for _ in range(5200)]
    made += [f"http://q.net/de/{name(6)}^\n{name(3)}" for _ in range(4300)]
    made += [f"http://{name(4)}.org/fr/{name(5)}" for _ in range(300)] + ["http://a.org/" + name(3) * 500, None, "", "x"] + made[:50]
    table = spark.createDataFrame([(i, u) for i, u in enumerate(made)], "page_id long, url string").repartition(3)
    monkeypatch.setattr(urls, "BLOCK_BYTES", 20_000)
    got = urls.judge(table, registry.URL_RULES).collect()
    assert sorted(r.page_id for r in got) == list(range(len(made)))
    known = sorted({(r.url, r.verdict) for r in got if r.rule})
    assert min(sum(v == x for _, v in known) for x in ("allow", "block")) > 4000
    kept, held = ([(u, v) for u, v in known if (zlib.crc32(u.encode()) % 5 == 0) == h] for h in (False, True))
    ratio = urls.Ratio(*([u for u, v in kept if v == x] for x in ("allow", "block")))
    least = urls.calibrate([(ratio.score(u), v == "allow") for u, v in held])
    for r in got:
        if not r.rule:
            want = ratio.score(r.url)
            assert r.score == pytest.approx(want, abs=1e-9) and r.verdict == ("allow" if not r.url or want >= least else "block")
    assert {r.verdict for r in got if not r.rule and r.url} == {"allow", "block"}


@pytest.mark.parametrize("one_class", [False, True])
def test_threshold_over_partitions(spark, one_class):
    draw = np.random.default_rng(6)
    rows = [(float(round(s, 2)), not one_class and bool(y)) for s, y in zip(draw.normal(size=3000), draw.random(3000) < 0.5, strict=True)]
    rows = [(s + y, y) for s, y in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = urls.threshold(spark.createDataFrame([(s, int(y), int(not y)) for s, y in rows], "s double, good long, bad long"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == urls.calibrate(rows)
