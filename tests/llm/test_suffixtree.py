"""The sharded suffix tree against a plain one."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.llm import suffixtree

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def own(n):
    """What is left of a count after its discount."""
    return n - 0.75 if n > 1 else 0


def left(f):
    """The part of a context's probability that its discounts free."""
    return sum(n - own(n) for n in f.values()) / sum(f.values())


class Plain:
    """The same model in dictionaries: training counts, tests of contexts from short to long, and probabilities."""

    def __init__(self, rows, depth=suffixtree.DEPTH):
        self.depth, self.n = depth, Counter(w for ws in rows for w in ws)
        self.total, self.kinds = sum(self.n.values()), len(self.n)
        once, twice = (sum(v == k for v in self.n.values()) for k in (1, 2))
        self.d0 = (once + 1) / (once + 2 * twice + 2)
        self.unknown = self.d0 * self.kinds / self.total if self.total else 1.0
        self.follow = defaultdict(Counter)
        for ws in rows:
            seq = [None, *ws]
            for i in range(1, len(seq)):
                for k in range(1, min(depth, i) + 1):
                    self.follow[tuple(seq[i - k : i])][seq[i]] += 1
        self.kept = {}
        for k in range(1, depth + 1):
            self.kept |= {c: left(f) for c, f in self.follow.items() if len(c) == k and self.saves(c, f)}

    def saves(self, c, f):
        size, gain = sum(f.values()), 0.0
        if size < 2:
            return False
        for w, n in f.items():
            p = 2 ** (-round(-math.log2(self.p(c[1:], w)) * 16) / 16)
            gain += n * math.log(own(n) / size / p + left(f))
        return gain >= suffixtree.GAIN

    def p(self, c, w):
        """Of a word, or of all unknown ones together."""
        p = (self.n[w] - self.d0) / self.total if self.n[w] else self.unknown
        for k in range(1, len(c) + 1):
            if (s := c[len(c) - k :]) in self.kept:
                p = own(self.follow[s][w]) / sum(self.follow[s].values()) + self.kept[s] * p
        return p

    def event_score(self, ws):
        seq = [None, *ws]
        return sum(math.log10(self.p(tuple(seq[max(0, i - self.depth) : i]), seq[i])) for i in range(1, len(seq)))


def plain_speller(found):
    """Probabilities of a word by the same rules, from strings."""
    follow, root = defaultdict(Counter), Counter()
    for w in found:
        s = b"\n" + w + b"\n"
        for i in range(1, len(s)):
            root[s[i]] += 1
            for k in range(1, min(suffixtree.SPELL, i) + 1):
                follow[s[i - k : i]][s[i]] += 1
    total, kept = sum(root.values()), {}

    def p(c, x):
        out = (root[x] + 1 / 256) / (total + 1)
        for k in range(1, len(c) + 1):
            if (s := c[len(c) - k :]) in kept:
                out = own(follow[s][x]) / sum(follow[s].values()) + kept[s] * out
        return out

    for k in range(1, suffixtree.SPELL + 1):
        fresh = {}
        for c, f in follow.items():
            size = sum(f.values())
            if len(c) == k and size > 1:
                gain = sum(n * math.log(own(n) / size / p(c[1:], x) + left(f)) for x, n in f.items())
                if gain >= suffixtree.GAIN:
                    fresh[c] = left(f)
        kept |= fresh

    def spelt(w):
        s = b"\n" + w + b"\n"
        return sum(math.log10(p(s[max(0, i - suffixtree.SPELL) : i], s[i])) for i in range(1, len(s)))

    return spelt, p


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


@pytest.mark.parametrize("block_bytes", [1 << 14, 1 << 22])
def test_scores_equal_the_plain_model(spark, docs, odd, brute_words, block_bytes):
    long = odd.where("doc_id is null or doc_id not in (6, 7)")
    for table in (docs, long, odd.where("false"), odd.where("doc_id = 1")):
        rows = [(r.doc_id, [*brute_words((r.text or "").translate(LOWER)), None]) for r in table.collect()]
        model = Plain([ws for i, ws in rows if not held(i)])
        spelt, _ = plain_speller({w.encode() for w in model.n if w is not None})
        want = Counter()
        for i, ws in rows:
            event = model.event_score(ws)
            base = sum(math.log10((model.n[w] + 0.5) / (model.total + 0.5 * (model.kinds + 1))) for w in ws)
            score = event + sum(spelt((w or "").encode()) for w in ws if not model.n[w])
            want[i, held(i), len(ws), sum(model.n[w] > 0 for w in ws), model.total, round(base, 6), round(score, 6), round(event, 6)] += 1
        got = suffixtree.score(table, suffixtree.fold(F.col("doc_id")), block_bytes=block_bytes).collect()
        assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6), round(r.event_score, 6)) for r in got) == want


def test_all_columns_come_through(spark, odd):
    got = suffixtree.score(odd.withColumn("score", F.lit("own")).withColumn("block", F.array(F.lit(1))), F.lit(False))
    assert got.columns == ["doc_id", "kept", "rank", "piece", "score", "block", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score_", "event_score"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(r.score == "own" and r.block == [1] and r.kept == "en" for r in rows)
    assert sum(r.n_tokens == 60_001 for r in rows) == 2


def test_contexts_of_many_tokens_are_dealt_out(spark, docs, monkeypatch):
    """With contexts on several shards the scores stay what they are."""
    one = {r.doc_id: r.score for r in suffixtree.score(docs, suffixtree.fold(F.col("doc_id"))).collect()}
    monkeypatch.setattr(suffixtree.Model, "share", property(lambda self: 40))
    other = {r.doc_id: r.score for r in suffixtree.score(docs, suffixtree.fold(F.col("doc_id"))).collect()}
    assert one.keys() == other.keys() and all(abs(one[i] - other[i]) < 1e-9 * (1 + abs(one[i])) for i in one)


def test_probabilities_sum_to_one(docs, brute_words):
    rows = [[*brute_words((r.text or "").translate(LOWER)), None] for r in docs.limit(60).collect()]
    model = Plain(rows)
    contexts = sorted(model.kept, key=str)[:40] + [("of", "no-such-word"), ("the",)]
    for c in contexts:
        assert abs(sum(model.p(c, w) for w in model.n) + model.p(c, "no-such-word") - 1) < 1e-9
    _, p = plain_speller({w.encode() for w in model.n if w})
    for c in (b"\n", b"\nt", b"th", b"the"):
        assert abs(sum(p(c, x) for x in range(256)) - 1) < 1e-9


def test_repeated_documents_score_apart(spark):
    """The tree grows with the corpus: a text that is there twice is predicted by its own contexts, however many others there are."""
    draw = np.random.default_rng(3)
    word = lambda: "".join(draw.choice(list("abcdefgh"), 6))
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    for more in (0, 2):
        table = spark.createDataFrame(rows + [(2000 + i, " ".join(word() for _ in range(60))) for i in range(300 * more)], "doc_id long, text string")
        got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in suffixtree.score(table, F.lit(False)).collect()}
        assert min(got[1000 + i] for i in range(20)) > max(got[i] for i in range(20, 300)) + 1


def test_spelling_counts_all_runs(spark, monkeypatch):
    """No run is left out, however many there are: a tree of 2.1 million runs that are seen once, and some that are seen often."""
    low = np.arange(2_100_000, dtype=np.int64)
    rare = (low % 256) | (128 + low // 256 % 100) << 48 | (1 + low // 25_600) << 40 | 7 << 32
    often = np.array([97 | 98 << 48 | 99 << 40 | 100 << 32, 101 | 98 << 48 | 99 << 40 | 100 << 32])
    run, n = np.concatenate((rare, often)), np.concatenate((np.ones(len(rare), np.int64), [900, 100]))
    order = np.argsort(run)
    payload = suffixtree.packed(np.zeros(4, np.int64), run[order], n[order])
    answers = spark.createDataFrame([(suffixtree.SUMS, None, 0, payload)], suffixtree.ANSWERS)
    symbols = np.bincount(run & 255, n, minlength=256)
    trees = []
    for most in (suffixtree.SPELL_RUNS, 100_000):
        monkeypatch.setattr(suffixtree, "SPELL_RUNS", most)
        trees.append(suffixtree.speller(answers))
        assert np.allclose(trees[-1].root, (symbols + 1 / 256) / (n.sum() + 1), rtol=1e-12, atol=0)
    assert trees[0].log10([b"dcba", b"xyz"]).tolist() == trees[1].log10([b"dcba", b"xyz"]).tolist()
    assert trees[0].size() > 0
