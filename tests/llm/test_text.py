"""Tokenisers, packing, substrings, language model: against libraries and brute force."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelens.llm import bpe, packing, substrings
from tidelens.llm.common import utf8, word_hashes, words

from .conftest import batch

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words(brute_words):
    texts = ["a  b", "", " x", "x ", "\u00a0y\u2003z \x0b\x1cq", "é"]
    raw, at = utf8(batch(*texts))
    starts, ends, first = words(raw, at)
    found = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert found == [w for t in texts for w in brute_words(t)]
    assert len(set(word_hashes(raw, starts, ends).tolist())) == len(set(found))
    assert first.tolist() == [0, 2, 2, 3, 4, 6, 7]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("aab bc'stvelmdr \n\té1²٣.!?中😀͸\u00a0")), max_size=40), min_size=1, max_size=6))
def test_encoder_equals_the_library(library, texts):
    raw, at = utf8(batch(*texts))
    ids, o = bpe.Encoder(bpe.Merges.from_tiktoken(RANKS).replay, PATTERN).encode(raw, at)
    assert [ids[o[i] : o[i + 1]].tolist() for i in range(len(texts))] == [library.encode_ordinary(t) for t in texts]


def test_bpe_query(spark, docs, odd, library):
    for table in (docs, odd.select("doc_id", "text")):
        want = Counter()
        for r in table.collect():
            ids = library.encode_ordinary(r.text or "")
            want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.digests(table, RANKS, PATTERN).collect())) == want


def test_packing_query(spark, docs, odd, empty):
    tok = Tokenizer.from_file(JSON)
    for table in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        out = packing.packed_documents(table, JSON, PATTERN).collect()
        texts, got, bins = {r.doc_id: r.text or "" for r in table.collect()}, defaultdict(list), defaultdict(list)
        for r in out:
            got[r.doc_id].append(r)
            bins[r.sequence_id].append((r.offset, r.length))
        assert set(got) == set(texts)
        for i, pieces in got.items():
            ids = [*tok.encode(texts[i], add_special_tokens=False).ids, 2]
            pieces.sort(key=lambda r: r.piece)
            assert [p.piece for p in pieces] == list(range(len(pieces))) and sum(p.length for p in pieces) == len(ids)
            assert all(p.length == 1024 for p in pieces[1:]) and (len(ids) > 1024 or len(pieces) == 1)
            for p in pieces:
                part = ids[p.start : p.start + p.length]
                assert p.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        for places in bins.values():
            at = 0
            for o, n in sorted(places):
                assert o == at
                at += n
            assert at <= 1024
        assert len(bins) <= 1.02 * -(-sum(r.length for r in out) // 1024) + 1
    assert packing.packed_documents(empty, JSON, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bins_are_few(sizes):
    found = packing.complete_bins(Counter(sizes), 20)
    assert Counter(x for p, n in found for x in list(p) * n) == Counter(sizes) and all(sum(p) <= 20 for p, _ in found)

    def least(left, rooms):
        if not left:
            return len(rooms)
        best = least(left[1:], [*rooms, 20 - left[0]])
        for i, r in enumerate(rooms):
            if r >= left[0] and r not in rooms[:i]:
                best = min(best, least(left[1:], [*rooms[:i], r - left[0], *rooms[i + 1 :]]))
        return best

    if len(sizes) <= 7:
        assert sum(n for _, n in found) == least(sorted(sizes, reverse=True), [])


def brute_repeats(rows, split, width):
    seen = Counter()
    for _, t in rows:
        w = split(t or "")
        for i in range(len(w) - width + 1):
            seen[tuple(w[i : i + width])] += 1
    for i, t in rows:
        w = split(t or "")
        gone = set()
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone.update(range(k, k + width))
        yield i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def test_substrings(spark, sf, odd, empty, brute_words):
    whole = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    periodic = spark.createDataFrame([(1, "a " * 36), (2, "a b " * 40), (3, " ".join(map(str, range(34)))), (4, " ".join(map(str, range(80)))), (5, " ".join(map(str, range(20, 70))))], "doc_id long, text string")
    for table in (whole, periodic, odd.where("doc_id is null or doc_id not in (6, 7)").select("doc_id", "text")):
        want = Counter(brute_repeats([tuple(r) for r in table.collect()], brute_words, 35))
        got = substrings.remove_repeats(table, block_bytes=1 << 16).select("doc_id", "n_words", "n_removed", "text").collect()
        assert Counter(map(tuple, got)) == want
    assert substrings.remove_repeats(empty).count() == 0
    alone = substrings.remove_repeats(whole.select("text"))
    assert alone.columns == ["text", "n_words", "n_removed"] and alone.count() == whole.count()
    long = substrings.remove_repeats(odd.where("doc_id in (6, 7)")).collect()  # one text twice: all of it recurs
    assert [(r.n_words, r.n_removed, r.text) for r in long] == [(60_000, 60_000, "")] * 2
    assert {"kept", "rank", "n_removed"} <= set(substrings.remove_repeats(odd).columns)
