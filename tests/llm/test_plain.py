"""Language ID, near-dedup, URL verdicts and the pipeline against plain Python that shares no code with them."""

import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tidelens.llm import language, neardup, registry, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- language -----------------------------------------------------------------------------------


def letters(text):
    raw = [b | 32 if 65 <= b <= 90 else b for b in text.encode()]
    raw = [b if 97 <= b <= 122 or b > 127 else 32 for b in raw]
    return [((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> 16 for a, b, c in zip(raw, raw[1:], raw[2:]) if b != 32]


class PlainLanguages:
    def __init__(self, labelled):
        counts, texts = defaultdict(Counter), set()
        for text, label in labelled:
            if label and len(text or "") > 2 and (text, label) not in texts:
                texts.add((text, label))
                counts[label].update(letters(text))
        self.names = [*sorted(counts), "und"]
        self.logs = []
        for name in self.names[:-1]:
            total = sum(counts[name].values())
            self.logs.append(lambda b, c=counts[name], t=total: float(np.float32(math.log((c[b] + 0.02) / (t + 0.02 * 65536)))))
        self.logs.append(lambda b: float(np.float32(-math.log(65536))))

    def scores(self, text):
        found = letters(text or "")
        seen = Counter(found)
        return [sum(n * log(b) for b, n in seen.items()) * min(60, len(found)) / max(len(found), 1) for log in self.logs], len(found)

    def identify(self, rows):
        """rows: (text, declared, levels); returns (language, posterior, text_language, accepted)."""
        scored = [self.scores(t) for t, _, _ in rows]
        alone = [max(range(len(self.names)), key=lambda i: s[i]) if n else len(self.names) - 1 for s, n in scored]
        size = len(self.names)
        said = np.ones((size, size))
        level = defaultdict(lambda: np.zeros(size))
        for (_, declared, levels), best in zip(rows, alone, strict=True):
            if declared in self.names:
                said[self.names.index(declared), best] += 1
            for k in range(len(levels) + 1):
                level[tuple(x or "" for x in levels[:k])][best] += 1
        said /= said.sum(axis=0)

        def prior(key):
            own = level[key]
            if not key:
                return (own + 1) / (own.sum() + size)
            return (own + 20 * prior(key[:-1])) / (own.sum() + 20)

        for (s, n), (_, declared, levels), best in zip(scored, rows, alone, strict=True):
            log = np.array(s) + np.log(prior(tuple(x or "" for x in levels)))
            if declared in self.names:
                log += np.log(said[self.names.index(declared)])
            p = np.exp(log - log.max())
            p /= p.sum()
            top = int(p.argmax()) if n else size - 1
            sure = float(p[top]) if n else 1.0
            yield self.names[top], sure, self.names[best], bool(n and top != size - 1 and sure >= 0.5)


def test_documents_get_the_plain_posterior(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    want = list(PlainLanguages([(r.text, r.lang) for r in rows]).identify([(r.text, (r.lang or "").lower() or None, [r.source]) for r in rows]))
    got = {r.doc_id: r for r in language.identify_documents(docs).collect()}
    for r, (name, sure, alone, accepted) in zip(rows, want, strict=True):
        g = got[r.doc_id]
        assert (g.language, g.text_language, g.accepted) == (name, alone, accepted) and g.posterior == pytest.approx(sure, abs=1e-4)


def test_pages_get_the_plain_posterior(spark, sf):
    docs, pages = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "pages"))
    rows, plain = pages.collect(), []
    for r in rows:
        html = r.html or ""
        text = re.sub(r"<[^>]*>|&\w+;", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ", html), flags=re.ASCII)
        host = (re.search(r"://([^/?#:]*)", r.url or "") or [""] * 2)[1].lower()
        said = re.search(r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", html)
        plain.append((text, said[1].lower() if said else None, [host.split(".")[-1], ".".join(host.split(".")[-2:]) if "." in host else "", host]))
    want = PlainLanguages([(r.text, r.lang) for r in docs.collect()]).identify(plain)
    got = {r.page_id: r for r in language.identify_pages(pages, docs).collect()}
    same = [(got[r.page_id].language, got[r.page_id].accepted) == (name, accepted) and abs(got[r.page_id].posterior - sure) < 1e-3 for r, (name, sure, _, accepted) in zip(rows, want, strict=True)]
    assert all(same)


# --- near-duplicates ----------------------------------------------------------------------------


def shingle_counts(text):
    w = WORD.findall(text or "")
    return Counter([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [" ".join(w)] if w else [])


def similarity(a, b):
    """J_P by its definition: sum over common elements of 1 / sum of max(a(e) / a(x), b(e) / b(x))."""
    names = sorted({*a, *b})
    x, y = (np.array([s[n] for n in names], float) for s in (a, b))
    both = np.flatnonzero((x > 0) & (y > 0))
    return sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in both.tolist())


def groups(rows):
    """The smallest key that links of at least 0.8 lead to, for each row of (key, text)."""
    sets = [shingle_counts(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        common = sum(min(sets[i][s], sets[j][s]) for s in sets[i].keys() & sets[j].keys()) if sets[i] and sets[j] else 0
        if common and (sets[i] == sets[j] or similarity(sets[i], sets[j]) >= 0.8 - 1e-12):
            root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return [least[find(i)] for i in range(len(rows))]


@pytest.mark.parametrize("exact", [False, True])
def test_components_equal_the_plain_ones(spark, docs, exact):
    rows = [tuple(r) for r in docs.collect()]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, exact=exact).collect()} == dict(zip([i for i, _ in rows], groups(rows), strict=True))


def test_rows_of_one_key_are_judged_by_their_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(30)) for c in "ab")
    rows = spark.createDataFrame([(1, a), (3, a), (3, b), (3, b), (4, b + " end"), (None, a)], "doc_id long, text string")
    left = neardup.one_of_each(rows).collect()
    assert sorted(((r.doc_id, r.text) for r in left), key=str) == sorted([(1, a), (3, b), (None, a)], key=str)


# --- urls ---------------------------------------------------------------------------------------


def test_verdicts_equal_the_plain_models(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    judged = urls.judge(pages, registry.URL_RULES).collect()
    labelled = {(r.url, r.verdict) for r in judged if r.rule}
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}
    for url, v in labelled:
        if zlib.crc32(url.encode()) % 5:
            text = "^" * 5 + url + "\n"
            for i in range(5, len(text)):
                for k in range(6):
                    counts[v][text[i - k : i]][text[i]] += 1

    def chance(v, context, symbol):
        if context is None:
            return 1 / 65536
        seen = counts[v].get(context)
        below = chance(v, context[1:] if context else None, symbol)
        return (seen[symbol] + len(seen) * below) / (sum(seen.values()) + len(seen)) if seen else below

    def score(url):
        text = "^" * 5 + url + "\n"
        return sum(math.log10(chance("allow", text[i - 5 : i], text[i]) / chance("block", text[i - 5 : i], text[i])) for i in range(5, len(text))) / (len(text) - 5)

    held = sorted((score(u), v == "allow") for u, v in labelled if zlib.crc32(u.encode()) % 5 == 0)
    good, bad = sum(y for _, y in held), sum(not y for _, y in held)
    best, threshold = 0.5, held[0][0] - 1e-9
    for (s, _), (after, _) in zip(held, [*held[1:], (held[-1][0] + 2e-9, None)], strict=True):
        value = (sum(y for x, y in held if x > s) / good + sum(not y for x, y in held if x <= s) / bad) / 2
        if after > s and value > best + 1e-12:
            best, threshold = value, (s + after) / 2
    for r in judged:
        if not r.rule:
            own = score(r.url) if r.url else 0.0
            assert r.score == pytest.approx(own, abs=1e-9) and r.verdict == ("allow" if not r.url or own >= threshold else "block")


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline_equals_the_plain_one(spark, sf):
    """run()'s rows by plain code for each stage: languages, groups, recurring windows, and the tokenizer's ids."""
    rows = [r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = PlainLanguages([(r.text, r.lang) for r in rows]).identify([(r.text, (r.lang or "").lower() or None, [r.source]) for r in rows])
    kept = [(r.doc_id, r.text) for r, (_, _, _, accepted) in zip(rows, found, strict=True) if accepted]
    kept = [(i, t) for (i, t), least in zip(kept, groups(kept), strict=True) if i == least]
    seen = Counter()
    for _, t in kept:
        w = WORD.findall(t)
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    left = {}
    for i, t in kept:
        w, gone = WORD.findall(t), set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        if len(gone) < len(w):
            left[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    tok, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for i, t in left.items():
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        lead = len(ids) % 1024 or 1024
        cuts = [0, *range(lead, len(ids) + 1, 1024)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[i, piece, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))] += 1
    out = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= 1024


def test_stages_keep_the_users_columns(spark, sf):
    """Columns of documents' own that are named like the operators' decide nothing and come through."""
    plain = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    docs = plain.selectExpr("*", "false as accepted", "'xx' as language", "0L as n_words", "0L as n_removed", "'keep' as text__", "1 as block__", "2 as k_", "3 as stays_", "4 as slot", "5 as prior__")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, docs, sf), stage(spark, plain, sf)
        assert out.columns == docs.columns
        rows = out.collect()
        assert {(r.doc_id, r.text, r.lang) for r in rows} == {(r.doc_id, r.text, r.lang) for r in want.collect()}, name
        assert {(r.accepted, r.language, r.n_words, r["text__"], r["block__"], r["k_"], r["prior__"]) for r in rows} <= {(False, "xx", 0, "keep", 1, 2, 5)}
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs, sf).count() == packed(spark, plain, sf).count()
    empty = docs.limit(0)
    assert all(stage(spark, empty, sf).count() == 0 for _, stage in corpus_pipeline.STAGES)
