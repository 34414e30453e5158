"""Language-model scoring with a probabilistic suffix tree over words.

A text is its words in lower case and then an end; the first word's context is the end of some text before. Contexts are up
to DEPTH tokens long. A context is retained if it is seen LEAST times and its next tokens diverge from those of its longest
retained suffix by GAIN nats in all. Both bounds are absolute, so the tree grows with the corpus. A retained context's
distribution discounts its counts, those of 1 wholly, and gives what that frees to the suffix's; below all contexts lie the discounted counts of single words, and what those free is spelled by a
suffix tree over the bytes of the training words. A token is scored by its longest retained context. After a context the
known words and the event of an unknown one sum to 1, and the spellings of all words do.

The tree is never in one place. Texts are cut into blocks, each stored as numbers of its words. For contexts of each length
in turn every block sends its counts of (context, next word), once for each that is different, to the context's shard;
shards add them up, test the contexts and answer the blocks with what these need to score: the retained contexts that they
hold. Numbers of words and contexts are given out by the shards, so nothing rests on hashes. A context with more than its
share of all tokens is dealt to several shards, which test it together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_of, free_name, joined, mix, packed, run_starts, squeezed, tasks, text_blocks, unpacked, unsqueezed, word_hashes, words, written

#: Longest context in words; least count of a context; nats that a retained context saves at least; discount of a count
#: above 1 (1 is discounted to 0, so that what follows once needs no exchange).
DEPTH, LEAST, GAIN, DISCOUNT = 2, 2, 5.0, 0.75
#: Longest context in bytes for spelling; runs of bytes that a task tests at a time.
SPELL, SPELL_RUNS = 3, 1 << 18
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
END = 0x0A
#: Parents' probabilities are tested in steps of 1/16 bit.
STEP = 16

# --- the divergence test ------------------------------------------------------------------------


def tested(context: np.ndarray, n: np.ndarray, p: np.ndarray, singles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each context the sum of n, what its discounts free in quarters, and the nats that it saves.

    context, n, p: of each pair of context and symbol, its number, count, and probability after the suffix. singles: of
    each context the number of further symbols that follow it once.
    """
    singles = singles + np.bincount(context[n == 1], minlength=len(singles))
    context, n, p = context[n > 1], n[n > 1].astype(np.float64), p[n > 1]
    size = np.bincount(context, n, minlength=len(singles)) + singles
    freed = 4 * singles + 3 * np.bincount(context, minlength=len(singles))
    return size.astype(np.int64), freed, saved(context, n, p, singles, size, freed)


def discounted(n: np.ndarray) -> np.ndarray:
    return np.where(n > 1, n - DISCOUNT, 0.0)


def saved(context: np.ndarray, n: np.ndarray, p: np.ndarray, singles: np.ndarray, size: np.ndarray, freed: np.ndarray) -> np.ndarray:
    """Nats by which a context's own distribution is better for what follows it than its suffix's.

    A symbol that follows once has no more than its part of what is freed, so p cancels out.
    """
    left = freed / 4 / np.maximum(size, 1)
    own = n * np.log((n - DISCOUNT) / size[context] / p + left[context])
    return np.bincount(context, own, minlength=len(size)) + singles * np.log(np.where(singles > 0, left, 1.0))


# --- spelling -----------------------------------------------------------------------------------


def grams(s: np.ndarray, depth: int = SPELL) -> np.ndarray:
    """For each byte 7 bytes: its context from the nearest on, highest first, then itself lowest; 0 before the row's start.

    Rows end in END, which is the context of the next row's first byte.
    """
    key = s.astype(np.uint64)
    ended = np.concatenate((np.array([END], np.uint8), s[:-1]))  # the byte before
    since = np.arange(len(s)) - np.maximum.accumulate(np.where(ended == END, np.arange(len(s)), -1)) if len(s) else s
    for k in range(1, depth + 1):
        before = np.full(len(s), END, np.uint8)
        before[k:] = s[:-k] if len(s) > k else s[:0]
        key |= np.where(since >= k - 1, before, 0).astype(np.uint64) << np.uint64(56 - 8 * k)
    return key


class Speller:
    """A suffix tree over bytes: the probability of a word's bytes and its end."""

    def __init__(self, count: np.ndarray, depth: int = SPELL):
        """count: how often each of the 256 bytes is seen. Levels follow by add()."""
        self.depth, self.levels = depth, []
        self.root = (count + 1 / 256) / (count.sum() + 1)

    def tested(self, k: int, key: np.ndarray, c: np.ndarray, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the retained ones of some whole contexts of k bytes: the runs seen twice or more, their shares, and the part
        that the context frees. key: sorted, the context and then a byte; c: how often each is seen."""
        of = np.cumsum(np.concatenate(([0], np.diff(key >> np.uint64(8)) != 0)))[: len(key)]
        contexts = int(of[-1]) + 1 if len(of) else 0
        full = (key >> np.uint64(8)) << np.uint64(56 - 8 * k) | key & np.uint64(255)
        size, freed, gained = tested(of, c, self._after(full), np.zeros(contexts, np.int64))
        # A retained context has such a run: without one it saves nothing. What is seen once has no share.
        mine = ((size >= LEAST) & (gained >= gain))[of] & (c > 1)
        return key[mine], discounted(c[mine]) / size[of][mine], (freed / 4 / np.maximum(size, 1))[of][mine]

    def add(self, key: np.ndarray, share: np.ndarray, freed: np.ndarray) -> None:
        """The next level, from tested() of all its contexts, sorted by key."""
        first = run_starts(key >> np.uint64(8))
        self.levels.append(((key >> np.uint64(8))[first], freed[first], key, share))

    def _after(self, run: np.ndarray) -> np.ndarray:
        p = self.root[(run & np.uint64(255)).astype(np.int64)]
        for k, (names, freed, keys, share) in enumerate(self.levels, 1):
            if not len(names):
                continue
            context = run >> np.uint64(56 - 8 * k)
            at = np.minimum(np.searchsorted(names, context), len(names) - 1)
            hit = (names[at] == context) & (context & np.uint64(255) != 0)
            key = context << np.uint64(8) | run & np.uint64(255)
            own = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            p = np.where(hit, np.where(keys[own] == key, share[own], 0.0) + freed[at] * p, p)
        return p

    def log10(self, found: list[bytes]) -> np.ndarray:
        if not found:
            return np.zeros(0)
        s = np.frombuffer(b"\n".join(found) + b"\n", np.uint8)
        at = np.concatenate(([0], np.cumsum([len(w) + 1 for w in found])[:-1]))
        return np.add.reduceat(np.log10(self._after(grams(s, self.depth))), at)

    def size(self) -> int:
        return sum(x.nbytes for level in self.levels for x in level)


# --- blocks -------------------------------------------------------------------------------------


ANSWERS = "kind int, block long, shard int, payload binary"
#: Kinds of rows that shards give: an answer to a block, sums over the shard's words, a frequent word or context, a shard's
#: part of a context that is dealt to several.
ANSWER, SUMS, FREQUENT, PART = range(4)


@dataclass
class Level:
    """The different pairs of a context of one length and a next word that a block holds."""

    entry: np.ndarray  # of each token, or -1
    context: np.ndarray  # of each pair, its context's place
    word: np.ndarray
    first: np.ndarray  # the first token of each pair
    node: np.ndarray  # of each context, its number, or 0
    order: np.ndarray  # the pairs that are sent, in that order
    run: np.ndarray  # what is sent, by shard and context: the context of each run
    shard: np.ndarray  # of each run
    size: np.ndarray  # of each run, the pairs that are sent
    home: np.ndarray  # whether the run is in the shard that also gets the number of the context's pairs that are not sent


@dataclass
class Model:
    """What all tasks know: sums over all words, frequent contexts by length, and the spelling."""

    shards: int
    tokens: int = 0
    kinds: int = 0
    discount: float = DISCOUNT
    frequent: tuple = ()  # by length - 1: sorted numbers, shards each is dealt to
    decided: tuple = ()  # by length - 1: number, size and what is freed of those retained

    @property
    def share(self) -> int:
        return max(1, self.tokens // (4 * self.shards))

    def unknown(self) -> float:
        return self.discount * self.kinds / self.tokens if self.tokens else 1.0

    def shard_of(self, length: int, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        home, (names, times) = mix(node), self.frequent[length - 1]
        if len(names):
            at = np.minimum(np.searchsorted(names, node), len(names) - 1)
            hit = names[at] == node
            home[hit] += mix(word[hit]) % times[at[hit]].astype(np.uint64)
        return (home % np.uint64(self.shards)).astype(np.int64)


class Block:
    """A block and, from the answers that it has got, the probabilities of its tokens."""

    def __init__(self, rows: pa.Table, answers: pa.Table, model: Model, depth: int):
        self.model = model
        self.tokens, self.sizes, learn = unpacked(rows.column("tokens")[0].as_py())
        self.kinds = int(self.tokens.max()) + 1
        self.words = [b""]  # the end is the empty word
        if "words" in rows.column_names:
            blob = unsqueezed(rows.column("words")[0].as_py())
            self.words += blob.split(b"\n") if blob else []
        self.learn = np.repeat(learn > 0, self.sizes)
        self.start = np.zeros(len(self.tokens), bool)  # first tokens of their rows
        self.start[np.cumsum(self.sizes) - self.sizes] = True
        self.levels: list[Level] = []
        answers = answers.sort_by([("level", "ascending"), ("shard", "ascending")])
        level, shard, payload = (answers.column(c).to_pylist() for c in ("level", "shard", "payload"))
        if depth < 0:
            return
        got = [(i, *unpacked(x)) for at_, i, x in zip(level, shard, payload, strict=True) if at_ == 0]
        count, number, place = joined([[n, np.where(rank > 0, (rank - 1) * model.shards + i + 1, 0), np.cumsum(step)] for i, n, rank, step in got], 3)
        self.count, self.number = np.zeros(self.kinds, np.int64), np.zeros(self.kinds, np.int64)
        self.count[place], self.number[place] = count, number
        self.known = self.count[self.tokens] > 0
        self.p = np.maximum(self.count - model.discount, 0)[self.tokens] / max(model.tokens, 1)
        self.freed = np.ones(len(self.tokens))  # what is left to the words that no training text has
        self.longer = self.number  # the numbers of the contexts one word longer
        for k in range(1, depth + 1):
            own = self.level(k)
            got = [self.numbers(i, *unpacked(x)) for at_, i, x in zip(level, shard, payload, strict=True) if at_ == k]
            freed, size, n, number = joined(got, 4)
            self.longer = np.zeros(len(own.word), np.int64)
            self.longer[own.order] = number
            self.mix_in(k, own, freed, size, n)

    def numbers(self, shard: int, freed: np.ndarray, size: np.ndarray, n: np.ndarray, longer: np.ndarray, step: np.ndarray) -> list[np.ndarray]:
        """A shard's answer with the numbers of the longer contexts, which come as the places and steps of ascending ranks."""
        number = np.zeros(len(n), np.int64)
        number[longer > 0] = (np.cumsum(step) - 1) * self.model.shards + shard + 1
        return [freed, size, n, number]

    def word_shards(self) -> tuple[np.ndarray, np.ndarray]:
        """The words in the order of their shards, and these."""
        raw = np.frombuffer(b"\n".join(self.words[1:]), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]))
        shard = np.concatenate((np.zeros(1, np.int64), (word_hashes(raw, starts, ends) % np.uint64(self.model.shards)).astype(np.int64)))
        order = np.argsort(shard, kind="stable")
        return order, shard[order]

    def contexts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each token the place of its context of that length, and of each place the context's number."""
        before = self.tokens if length == 1 else self.levels[-1].entry
        place = np.full(len(before), -1, np.int64)
        place[1:] = before[:-1]
        place[self.start] = 0 if length == 1 else -1  # before the first token stands an end, and nothing before that
        return place, np.where(self.count >= LEAST, self.longer, 0) if length == 1 else self.longer

    def level(self, length: int) -> Level:
        place, node = self.contexts(length)
        use = np.flatnonzero((place >= 0) & (node[np.maximum(place, 0)] > 0)) if len(node) else np.zeros(0, np.int64)
        code, values = pd.factorize(place[use] * self.kinds + self.tokens[use])
        entry = np.full(len(place), -1, np.int64)
        entry[use] = code
        first = np.empty(len(values), np.int64)
        first[code[::-1]] = use[::-1]
        context, word = values // self.kinds, values % self.kinds
        # A symbol that follows the suffix once at most follows this context once at most: how many do is enough.
        often = self.count[word] >= LEAST if length == 1 else self.longer[self.levels[-1].entry[first]] > 0
        if length > 1:
            often &= self.levels[-1].entry[first] >= 0
        sent, many = np.flatnonzero(often), len(node)
        mark = np.zeros(many, bool)
        mark[context] = True
        there = np.flatnonzero(mark)
        home = (mix(node[there]) % np.uint64(self.model.shards)).astype(np.int64)
        # What is sent is ordered by shard, number of the context, and number of the word.
        place_of = np.zeros(many, np.int64)
        place_of[there] = np.arange(len(there))
        rank = np.empty(len(there), np.int64)
        rank[np.argsort(node[there])] = np.arange(len(there))
        spelt = np.argsort(np.argsort(self.number, kind="stable"), kind="stable")
        own_rank = rank[place_of[context[sent]]]
        shard = home[place_of[context[sent]]]
        dealt = np.flatnonzero(np.isin(node[there], self.model.frequent[length - 1][0]))
        if len(dealt):
            some = np.flatnonzero(np.isin(context[sent], there[dealt]))
            shard[some] = self.model.shard_of(length, node[context[sent[some]]], self.number[word[sent[some]]])
        key = shard * len(there) + own_rank
        order = np.argsort(key * self.kinds + spelt[word[sent]])
        key, main = key[order], np.sort(home * len(there) + rank)
        runs = np.union1d(key, main) if len(dealt) else main
        size = np.searchsorted(key, runs, side="right") - np.searchsorted(key, runs)
        by_rank = np.empty(len(there), np.int64)
        by_rank[rank] = there
        width = max(len(there), 1)
        own = Level(entry, context, word, first, node, sent[order], by_rank[runs % width], runs // width, size, np.isin(runs, main) if len(dealt) else np.ones(len(runs), bool))
        self.levels.append(own)
        return own

    def seen(self, own: Level) -> np.ndarray:
        """How often the block's training rows hold each pair."""
        return np.bincount(own.entry[self.learn & (own.entry >= 0)], minlength=len(own.word))

    def mix_in(self, length: int, own: Level, freed: np.ndarray, size: np.ndarray, n: np.ndarray) -> None:
        """Moves tokens whose context is retained from the suffix's distribution to the context's."""
        left, s_of = np.zeros(len(own.node), np.int64), np.ones(len(own.node), np.int64)
        got = freed > 0
        left[own.run[got]], s_of[own.run[got]] = freed[got], size[got]
        names, sizes, frees = self.model.decided[length - 1]
        if len(names):
            at = np.minimum(np.searchsorted(names, own.node), len(names) - 1)
            hit = names[at] == own.node
            left[hit], s_of[hit] = frees[at[hit]], sizes[at[hit]]
        count = np.zeros(len(own.word), np.int64)
        count[own.order] = n
        rows = np.flatnonzero(own.entry >= 0)
        entry = own.entry[rows]
        context = own.context[entry]
        on = left[context] > 0
        rows, entry, context = rows[on], entry[on], context[on]
        passed = left[context] / 4 / s_of[context]
        self.p[rows] = discounted(count[entry]) / s_of[context] + passed * self.p[rows]
        self.freed[rows] *= passed

    # What a block sends.

    def word_requests(self, block: int) -> dict[str, list]:
        n = np.bincount(self.tokens[self.learn], minlength=len(self.words))
        order, shard = self.word_shards()
        cut = run_starts(shard)
        parts = np.split(order, cut[1:])
        return {"shard": shard[cut].tolist(), "block": [block] * len(cut), "payload": [packed(n[part], np.diff(part, prepend=0)) for part in parts], "words": [squeezed(b"\n".join([self.words[i] for i in part.tolist()])) for part in parts]}

    def requests(self, block: int, length: int) -> dict[str, list]:
        own = self.level(length)
        n = self.seen(own)
        alone = np.ones(len(n), bool)
        alone[own.order] = False
        singles = np.bincount(own.context[alone], n[alone], minlength=len(own.node)).astype(np.int64)[own.run] * own.home
        with np.errstate(divide="ignore"):
            q = np.minimum(np.rint(-np.log2(self.p[own.first[own.order]]) * STEP), 65535).astype(np.int64)
        cut = run_starts(own.shard)
        pair = np.concatenate(([0], np.cumsum(own.size)))
        out: dict[str, list] = {"shard": own.shard[cut].tolist(), "block": [block] * len(cut), "payload": [], "words": [None] * len(cut)}
        for a, b in zip(cut.tolist(), np.append(cut, len(own.run))[1:].tolist(), strict=True):
            part = own.order[pair[a] : pair[b]]
            out["payload"].append(packed(np.diff(own.node[own.run[a:b]], prepend=0), own.size[a:b], singles[a:b], self.number[own.word[part]], n[part], q[pair[a] : pair[b]]))
        return out


REQUESTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("words", pa.binary())])
_ANSWERS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])


def word_shard(shards: int, share: int):
    """A shard's sums over its words, and its answers: of each word asked for the count and the rank (0: no training text has it)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = key[0].as_py()
        every = [unsqueezed(x.as_py()).split(b"\n") for x in rows.column("words")]
        parts = [unpacked(x.as_py()) for x in rows.column("payload")]
        n, place = joined(parts, 2)
        coded = pa.array([w for ws in every for w in ws], pa.binary()).dictionary_encode()
        at = np.asarray(coded.indices)
        count = np.bincount(at, n, minlength=len(coded.dictionary)).astype(np.int64)
        order = pc.sort_indices(pa.table({"n": count, "w": coded.dictionary}), sort_keys=[("n", "descending"), ("w", "ascending")]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(1, len(order) + 1)
        rank[count == 0] = 0
        cuts, out = np.cumsum([0, *map(len, every)]).tolist(), {"kind": [], "block": [], "shard": [], "payload": []}

        def give(kind: int, block: int | None, payload: bytes) -> None:
            for c, v in zip(out, (kind, block, own, payload), strict=True):
                out[c].append(v)

        for block, a, b in zip(rows.column("block").to_pylist(), cuts[:-1], cuts[1:], strict=True):
            give(ANSWER, block, packed(count[at[a:b]], rank[at[a:b]], place[a:b]))
        spelt = [w for w in coded.dictionary.filter(pa.array(count > 0)).to_pylist() if w]
        s = np.frombuffer(b"".join(w + b"\n" for w in spelt), np.uint8)
        run_, seen = np.unique(grams(s), return_counts=True) if len(s) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        sums = np.array([count.sum(), (count > 0).sum(), (count == 1).sum(), (count == 2).sum()])
        give(SUMS, None, packed(sums, run_.astype(np.int64), seen))
        common = count >= share
        if common.any():
            give(FREQUENT, None, packed((rank[common] - 1) * shards + own + 1, count[common]))
        return pa.table(out, schema=_ANSWERS)

    return run


def context_shard(model: Model, length: int, last: bool):
    """A shard's tests of its contexts, and its answers: of each context asked for what it frees and its size (0: not retained), of
    each pair the count and, for longer contexts, the number (0: too rare)."""
    dealt = model.frequent[length - 1][0]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        own = key[0].as_py()
        parts = [unpacked(x.as_py()) for x in rows.column("payload")]
        node = np.concatenate([np.cumsum(p[0]) for p in parts])
        size_of_run, singles, word, n, q = joined([p[1:] for p in parts], 5)
        runs, pairs = np.cumsum([0, *(len(p[0]) for p in parts)]).tolist(), np.cumsum([0, *(len(p[3]) for p in parts)]).tolist()
        del parts
        of, nodes = pd.factorize(node)
        word_code, words_ = pd.factorize(word)
        pair, values = pd.factorize(np.repeat(of, size_of_run) * len(words_) + word_code)
        count = np.bincount(pair, n, minlength=len(values)).astype(np.int64)
        context, chance = values // max(len(words_), 1), np.zeros(len(values))
        chance[pair] = 2.0 ** (-q / STEP)
        alone = np.bincount(of, singles, minlength=len(nodes)).astype(np.int64)
        size, freed, gained = tested(context, count, chance, alone)
        split = np.isin(nodes, dealt)
        keep = (size >= LEAST) & (gained >= GAIN) & ~split
        rank = np.zeros(len(values), np.int64)  # from 1 on, ascending as blocks send the pairs
        if not last:
            some = np.flatnonzero(count >= LEAST)
            order = np.lexsort((words_[values[some] % len(words_)], nodes[context[some]]))
            rank[some[order]] = np.arange(1, len(some) + 1)
        shown = np.where((keep | split)[context] & (count > 1), count, 0)
        freed_out, size_out = np.where(keep, freed, 0)[of], np.where(keep, size, 0)[of]
        out = {"kind": [], "block": [], "shard": [], "payload": []}

        def give(kind: int, block: int | None, payload: bytes) -> None:
            for c, v in zip(out, (kind, block, own, payload), strict=True):
                out[c].append(v)

        for i, block in enumerate(rows.column("block").to_pylist()):
            a, b, mine = runs[i], runs[i + 1], pair[pairs[i] : pairs[i + 1]]
            longer = rank[mine]
            give(ANSWER, block, packed(freed_out[a:b], size_out[a:b], shown[mine], longer > 0, np.diff(longer[longer > 0], prepend=0)))
        for c in np.flatnonzero(split).tolist():
            mine = np.flatnonzero((context == c) & (count > 1))
            once = alone[c] + ((context == c) & (count == 1)).sum()
            give(PART, int(nodes[c]), packed(count[mine], np.rint(-np.log2(chance[mine]) * STEP).astype(np.int64), np.array([once])))
        common = (count >= model.share) & (rank > 0)
        if common.any():
            give(FREQUENT, None, packed((rank[common] - 1) * model.shards + own + 1, count[common]))
        return pa.table(out, schema=_ANSWERS)

    return run


def frequent(answers: DataFrame, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words or contexts of more than a share of all tokens, of which there are few, and shards for each."""
    number, count = joined([unpacked(r.payload) for r in answers.where(F.col("kind") == FREQUENT).toLocalIterator()], 2)
    order = np.argsort(number)
    return number[order], -(-count[order] // share)


def decide(answers: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tests the contexts that are dealt to several shards: number, size and freed of those retained. They are few."""
    parts = answers.where(F.col("kind") == PART).select(F.col("block").alias("node"), "payload")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [unpacked(x.as_py()) for x in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([int(c.sum() + a[0]) for c, _, a in got], pa.int64()), pa.array([int(3 * len(c) + 4 * a[0]) for c, _, a in got], pa.int64())], names=["node", "size", "freed"])

    found = {r.node: (r["size"], r.freed) for r in parts.mapInArrow(sums, "node long, size long, freed long").groupBy("node").agg(F.sum("size").alias("size"), F.sum("freed").alias("freed")).collect()}

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for node, payload in zip(batch.column("node").to_pylist(), batch.column("payload"), strict=True):
                count, q, alone = unpacked(payload.as_py())
                size, freed = (np.array([x]) for x in found[node])
                made.append(float(saved(np.zeros(len(count), np.int64), count.astype(np.float64), 2.0 ** (-q / STEP), alone, size, freed)[0]))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.float64())], names=["node", "gain"])

    keep = sorted(r.node for r in parts.mapInArrow(gains, "node long, gain double").groupBy("node").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= GAIN).collect() if found[r.node][0] >= LEAST) if found else []
    return np.array(keep, np.int64), np.array([found[k][0] for k in keep], np.int64), np.array([found[k][1] for k in keep], np.int64)


def speller(answers: DataFrame, depth: int = SPELL) -> Speller:
    """The spelling tree of all training words, each counted once. Tasks test the contexts, level by level; what the retained
    ones have seen twice or more reaches the driver (24 bytes for each such run)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column("payload"):
                _, key, n = unpacked(payload.as_py())
                for a in range(0, len(key), 1 << 16):
                    yield pa.RecordBatch.from_arrays([pa.array(key[a : a + (1 << 16)]), pa.array(n[a : a + (1 << 16)])], names=["gram", "n"])

    runs = answers.where(F.col("kind") == SUMS).select("payload").mapInArrow(run, "gram long, n long")
    runs = written(runs.groupBy("gram").agg(F.sum("n").alias("n")), "spelling")
    parts, symbol, count = -(-max(runs.count(), 1) // SPELL_RUNS), F.col("gram").bitwiseAND(255), np.zeros(256)
    for r in runs.groupBy(symbol.alias("x")).agg(F.sum("n").alias("n")).collect():
        count[r.x] = r.n
    tree = Speller(count, depth)

    def testing(k: int):
        def run(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("key")
            key, n = (np.asarray(rows.column(c).combine_chunks(), np.int64) for c in ("key", "n"))
            found = tree.tested(k, key.view(np.uint64), n)
            return pa.table({"key": found[0].view(np.int64), "share": found[1], "freed": found[2]})

        return run

    for k in range(1, depth + 1):
        context = F.shiftright("gram", 56 - 8 * k)
        level = runs.where(context.bitwiseAND(255) != 0).groupBy(F.shiftleft(context, 8).bitwiseOR(symbol).alias("key")).agg(F.sum("n").alias("n"))

        found = level.groupBy(block_of(parts, F.shiftright("key", 8))).applyInArrow(testing(k), "key long, share double, freed double").toArrow().sort_by("key")
        key, share, freed = (np.asarray(found.column(c).combine_chunks()) for c in ("key", "share", "freed"))
        tree.add(key.astype(np.int64).view(np.uint64), share, freed)
    return tree


# --- scoring ------------------------------------------------------------------------------------


def score(docs: DataFrame, held_out: Column, text: str = "text", depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without text, with held_out, n_tokens, n_known, train_tokens, base_score, score and event_score.

    The models learn from the rows where held_out is not true and score all rows. Null text is empty: its only token is the
    end. base_score is the log10 probability by the add-0.5 word model, score that of the text by the suffix tree, in which
    words that no training text has are spelled; event_score is the same with each such word as one event, as base_score
    has it. Repeated rows count each time, ties need no rule, texts may be of any length. Without training rows all words
    are spelled, by uniform bytes. An empty table stays empty. New columns take underscores on a clash.
    """
    spark, shards = docs.sparkSession, tasks(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    made = [free_name(docs, c) for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "event_score")]
    flagged = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(held_out, F.lit(False)).alias(made[0]))
    blocks = written(text_blocks(flagged, text, block_bytes, lower=True, held_out=made[0]), "blocks")
    model = Model(shards, blocks.agg(F.sum("learnt")).head()[0] or 0)

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = pa.table({"level": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        for batch in batches:
            for i in range(batch.num_rows):
                asked = Block(pa.Table.from_batches([batch.slice(i, 1)]), none, model, -1).word_requests(batch.column("block")[i].as_py())
                yield from pa.table(asked, schema=REQUESTS).to_batches()

    request = "shard int, block long, payload binary, words binary"
    asked = blocks.mapInArrow(ask_words, request)
    own = written(asked.groupBy("shard").applyInArrow(word_shard(shards, model.share), ANSWERS), "answers")
    sums = [unpacked(r.payload)[0] for r in own.where(F.col("kind") == SUMS).select("payload").toLocalIterator()]
    tokens, kinds, once, twice = np.sum(sums, axis=0).tolist() if sums else [0] * 4
    model = Model(shards, tokens, kinds, (once + 1) / (once + 2 * twice + 2), (frequent(own, model.share),))
    spelling = spark.sparkContext.broadcast(speller(own))
    answers = own.where(F.col("kind") == ANSWER).select(F.lit(0).alias("level"), "block", "shard", "payload")

    def asking(model: Model, length: int):
        def run(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
            return pa.table(Block(rows, got, model, length - 1).requests(key[0].as_py(), length), schema=REQUESTS)

        return run

    for length in range(1, depth + 1):
        asked = blocks.select("block", "tokens").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(asking(model, length), request)
        own = written(asked.groupBy("shard").applyInArrow(context_shard(model, length, length == depth), ANSWERS), "answers")
        model = Model(shards, tokens, kinds, model.discount, (*model.frequent, frequent(own, model.share)), (*model.decided, decide(own)))
        answers = answers.unionAll(own.where(F.col("kind") == ANSWER).select(F.lit(length).alias("level"), "block", "shard", "payload"))

    types = [T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([*[flagged.schema[c] for c in [*others, made[0]]], *(T.StructField(c, k) for c, k in zip(made[1:], types, strict=True))])

    def rate(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        block = Block(rows, got, model, depth)
        row, n = np.repeat(np.arange(len(block.sizes)), block.sizes), len(block.sizes)
        per = lambda x: np.bincount(row, x, minlength=n)
        base = per(np.log10((block.count + 0.5) / (model.tokens + 0.5 * (model.kinds + 1)))[block.tokens])
        logs = np.log10(np.where(block.known, block.p, model.unknown() * block.freed))
        strange = np.flatnonzero(block.count == 0)
        spelt = np.zeros(len(block.words))
        spelt[strange] = spelling.value.log10([block.words[i] for i in strange.tolist()])
        events = per(logs)
        result = [block.sizes, per(block.known.astype(np.float64)).astype(np.int64), np.full(n, model.tokens), base, events + per(np.where(block.known, 0.0, spelt[block.tokens])), events]
        keep = pa.ipc.open_stream(rows.column("rows")[0].as_py()).read_all()
        return pa.table([*keep.columns, *map(pa.array, result)], names=schema.names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(rate, schema)


def fold(key: Column, of: int = 5, which: int = 1) -> Column:
    """Whether the CRC-32 of key's text leaves the remainder `which`; a null key does not."""
    return F.crc32(key.cast("string").cast("binary")) % of == which
