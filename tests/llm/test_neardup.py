"""The chance that registers hide a link at the threshold, and what pairs below it cost."""

from math import ceil, comb

import numpy as np

from tidelens.llm import neardup


def below(n: int, least: float, p: float = neardup.SIMILARITY) -> float:
    """P(fewer than n * least of n registers agree)."""
    return sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(ceil(n * least - 1e-9)))


def test_registers_lose_no_more_links_than_the_bands():
    s, m = neardup.SIMILARITY, neardup.MARGIN
    bands = (1 - s**neardup.ROWS) ** neardup.BANDS
    lost = below(neardup.FINE // 4, s - 2 * m) + below(neardup.FINE, s - m)
    assert lost < bands


def test_pairs_below_the_threshold_make_no_rows(spark, monkeypatch):
    """Many copies of one text, each pair just below the threshold but for a few links: what is left of a bucket gives links, fewer than classes."""
    draw = np.random.default_rng(4)
    base, texts = [f"w{i}" for i in range(200)], []
    for i in range(120):
        words = list(base)
        for at in draw.choice(200, 3, replace=False):
            words[at] = f"n{i}-{at}"
        texts.append(" ".join(words))
    texts += [f"{t} more" for t in texts[:5]]
    rows, kept = {}, neardup.written

    def counted(df, name):
        rows[name] = (out := kept(df, name)).count()
        return out

    monkeypatch.setattr(neardup, "written", counted)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    want = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    for limit in (neardup.TILE_BYTES, 10_000):
        monkeypatch.setattr(neardup, "TILE_BYTES", limit)
        got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table).collect()}
        assert got == dict(enumerate(want)) and rows["across"] < len(texts)
    assert len(set(want)) > 20
