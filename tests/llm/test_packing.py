"""Bin completion on histograms of many lengths."""

from collections import Counter

import numpy as np

from tidelens.llm import packing


def test_descent_over_many_lengths_ends():
    sizes = np.random.default_rng(3).integers(100, 1100, 20_000).tolist()
    counts = Counter(sizes)
    assert len(counts) == 1000
    found = packing.complete_bins(counts, 2048)
    held = Counter()
    for p, n in found:
        assert sum(p) <= 2048
        for s in p:
            held[s] += n
    assert held == counts
    assert sum(n for _, n in found) == packing.lower_bound(counts, 2048) < sum(packing.best_fit(counts, 2048).values())


def held(found, capacity):
    out = Counter()
    for p, n in found:
        assert sum(p) <= capacity
        for s in p:
            out[s] += n
    return out


def test_completion_beats_best_fit():
    """Histograms on which best fit is not the fewest: the search decides, not the incumbent that it starts from."""
    draw = np.random.default_rng(1)
    for sizes, most_over in ((np.clip(np.rint(draw.lognormal(5.3, 0.8, 20_000)), 1, 1024), 0.0002), (draw.integers(200, 701, 20_000), 0.008)):
        counts = Counter(sizes.astype(int).tolist())
        found = packing.complete_bins(counts)
        assert held(found, 1024) == counts
        n, bound = sum(n for _, n in found), packing.lower_bound(counts, 1024)
        assert bound <= n <= bound * (1 + most_over) and n < sum(packing.best_fit(counts, 1024).values())


def test_exact_bins():
    """Against all ways to put items into bins."""

    def least(left, rooms):
        if not left:
            return len(rooms)
        best = least(left[1:], [*rooms, 20 - left[0]])
        for i, r in enumerate(rooms):
            if r >= left[0] and r not in rooms[:i]:
                best = min(best, least(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]]))
        return best

    draw = np.random.default_rng(2)
    for _ in range(60):
        sizes = draw.integers(1, 21, draw.integers(1, 8)).tolist()
        found = packing.exact_bins(Counter(sizes), 20)
        assert held(found.items(), 20) == Counter(sizes) and sum(found.values()) == least(sorted(sizes, reverse=True), [])
    assert packing.exact_bins(Counter({20: 2}), 20, below=2) is None


def test_new_names_do_not_clash(spark):
    rows = [(i, 400 + i, 7, 8, 9, 1, 2) for i in range(9)] + [(None, None, None, None, None, None, None), (3, 5000, 0, 0, 0, 0, 0)]
    items = spark.createDataFrame(rows, "id int, length int, salt int, l_ int, s_ int, first_ int, sequence_id int")
    out = packing.pack(items)
    assert out.columns == [*items.columns, "sequence_id_", "offset"]
    assert sorted(tuple(r)[:7] for r in out.where("length < 1024").collect()) == sorted(r for r in rows if r[1] and r[1] < 1024)
    assert out.where("length is null or length > 1024").where("sequence_id_ is null").count() == 2
