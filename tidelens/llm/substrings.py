"""Substring dedup by repeated-phrase automata.

A window is `width` consecutive words of one text; windows whose words recur anywhere go. Every window holds a phrase that
its own content chooses: the run of PHRASE words with the least hash. Equal windows hold equal phrases, so only windows
around a phrase that recurs can recur.

1. Texts are cut into blocks, stored as numbers of their words. Each block sends the phrases that its windows choose, as
   text, to shards, which confirm those that are chosen at two places or more: the table of repeated phrases.
2. Each block is sent the phrases of that table which it may hold, compiles them into an Aho-Corasick automaton, and streams
   all its texts through it; the automaton locates every occurrence.
3. The windows whose phrase is located are counted, by fingerprints of 64 bits, on shards again, and the words that a
   recurring window covers are taken out.

A block sends a phrase or a window once, however often it holds it, so that a very common passage costs a shard a row for
each block at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, give_back, gram_hashes, packed, run_starts, spread, squeezed, tasks, text_blocks, unpacked, unsqueezed, word_hashes, words, written

#: Words of a window and of a phrase, bytes of text in a block.
WIDTH, PHRASE, BLOCK_BYTES = 35, 8, 4 << 20
#: Letters of the automata: a word is written with one letter of each place's own alphabet, so that matches begin at words.
LETTERS = 64


class Block:
    """A block's words, tokens and windows."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, width: int):
        self.tokens, self.sizes, _ = unpacked(rows.column("tokens")[0].as_py())
        self.blob = unsqueezed(rows.column("words")[0].as_py())
        self.raw = np.frombuffer(self.blob, np.uint8)
        self.starts, self.ends, _ = words(self.raw, np.array([0, len(self.raw)]))
        self.phrase = max(1, min(PHRASE, width // 4))
        self.width = width
        hashes = np.concatenate((np.zeros(1, np.uint64), word_hashes(self.raw, self.starts, self.ends)))
        self.hashes = hashes[self.tokens]
        first = np.cumsum(self.sizes) - self.sizes
        self.at = spread(first, np.maximum(self.sizes - width, 0))  # first words of the windows; a text's last token is its end
        self.grams = grams = gram_hashes(self.hashes, self.phrase)
        if not len(self.at):
            self.place = self.at
            return
        low = (grams >> np.uint64(32)) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
        span, reach = width - self.phrase + 1, 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        self.place = (low[self.at] & np.uint64(0xFFFFFFFF)).astype(np.int64)  # where each window's phrase begins

    def phrases(self, shards: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Shards, texts and whether it is chosen at several places, for each different phrase that windows choose."""
        place = self.place[run_starts(self.place)]
        key = self.grams[place]
        order = np.argsort(key, kind="stable")
        cut = run_starts(key[order])
        place, several = place[order][cut], np.diff(cut, append=len(order)) > 1
        shard = (key[order][cut] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place, several = place[order], several[order]
        names = self.blob.split(b"\n")
        rows = (self.tokens[place[:, None] + np.arange(self.phrase)] - 1).tolist()
        return shard[order], [b" ".join([names[i] for i in row]) for row in rows], several

    def _written(self, tokens: np.ndarray) -> str:
        letters = 1
        while LETTERS**letters <= len(self.starts):
            letters += 1
        digits = tokens[:, None] // LETTERS ** np.arange(letters) % LETTERS + LETTERS * np.arange(letters)
        return digits.astype("<u4").tobytes().decode("utf-32-le")

    def located(self, phrases: list[bytes]) -> np.ndarray:
        """The windows whose phrase is one of these, as the automaton finds them."""
        begins = np.zeros(len(self.tokens), bool)
        if phrases and len(self.at):
            number = {w: i for i, w in enumerate(self.blob.split(b"\n"), 1)}
            own = [[number.get(w, 0) for w in p.split(b" ")] for p in phrases]
            table = np.array([p for p in own if 0 not in p], np.int64).reshape(-1, self.phrase)
            letters = len(self._written(np.ones(1, np.int64)))
            text, size = self._written(table.ravel()), letters * self.phrase
            automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for i in range(0, len(text), size):
                automaton.add_word(text[i : i + size], None)
            if len(table):
                automaton.make_automaton()
                ends = np.fromiter((end for end, _ in automaton.iter(self._written(self.tokens))), np.int64)
                begins[(ends + 1) // letters - self.phrase] = True
        return np.flatnonzero(begins[self.place])

    def prints(self, windows: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For windows: their different fingerprints by shard and value, their shards, whether each is there several times,
        and of each window the place among them."""
        key = gram_hashes(self.hashes, self.width, 0x9FB21C651E98DF25)[self.at[windows]]
        values, where, n = np.unique(key, return_inverse=True, return_counts=True)
        shard = self.shard_of(values, shards)  # ascending, as the values are
        return values, shard, n > 1, where

    @staticmethod
    def shard_of(values: np.ndarray, shards: int) -> np.ndarray:
        return ((values >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)

    def covered(self, windows: np.ndarray) -> np.ndarray:
        """Whether each token is covered by one of the windows."""
        change = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(change, self.at[windows], 1)
        np.add.at(change, self.at[windows] + self.width, -1)
        return np.cumsum(change[:-1]) > 0

    def texts(self, gone: np.ndarray) -> pa.Array:
        """The texts of all rows without the words that are gone."""
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        keep = np.flatnonzero((self.tokens > 0) & ~gone)
        row, word = row[keep], self.tokens[keep] - 1
        size = self.ends[word] - self.starts[word]
        more = np.ones(len(keep), np.int64)  # the blank or line feed that follows a word is taken with it
        more[np.flatnonzero(np.diff(row, append=-1))] = 0
        raw = np.append(self.raw, np.uint8(10))[spread(self.starts[word], size + more)]
        raw[raw == 10] = 32
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, size + more, minlength=len(self.sizes))))).astype(np.int64)
        return pa.Array.from_buffers(pa.large_string(), len(self.sizes), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.string())


REQUESTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("payload", pa.binary()), ("several", pa.binary())])
ANSWERS = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("shard", pa.int32()), ("payload", pa.binary())])
#: Kinds of answers: phrases that recur; the windows that a block has located; which of the fingerprints asked recur.
PHRASES, LOCATED, RECURRING = range(3)


def phrase_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """The phrases of a shard that are chosen at several places, for each block that has sent them."""
    every = [unsqueezed(x.as_py()).split(b"\n") for x in rows.column("payload")]
    several = np.concatenate([unpacked(x.as_py())[0] for x in rows.column("several")])
    coded = pa.array([p for ps in every for p in ps], pa.binary()).dictionary_encode()
    at = np.asarray(coded.indices)
    recurs = (np.bincount(at, 1 + several, minlength=len(coded.dictionary)) > 1)[at]
    cuts, out = np.cumsum([0, *map(len, every)]).tolist(), []
    for block, ps, a, b in zip(rows.column("block").to_pylist(), every, cuts[:-1], cuts[1:], strict=True):
        own = [p for p, r in zip(ps, recurs[a:b].tolist(), strict=True) if r]
        if own:
            out.append((PHRASES, block, key[0].as_py(), squeezed(b"\n".join(own))))
    return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(ANSWERS)], schema=ANSWERS)


def window_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """Of the fingerprints that each block has sent, whether they recur; what blocks say of themselves passes through."""
    own = key[0].as_py()
    if own < 0:
        return pa.table([pa.array([LOCATED] * rows.num_rows, pa.int32()), rows.column("block"), rows.column("shard"), rows.column("payload")], schema=ANSWERS)
    parts = [unpacked(x.as_py()) for x in rows.column("payload")]
    value = np.concatenate([np.cumsum(p[0].view(np.uint64)) for p in parts])
    several = np.concatenate([p[1] for p in parts])
    order = np.argsort(value, kind="stable")
    cut = run_starts(value[order])
    recurs = np.empty(len(value), bool)
    recurs[order] = np.repeat(np.add.reduceat(1 + several[order], cut) > 1, np.diff(cut, append=len(value)))
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return pa.table([pa.array([RECURRING] * len(parts), pa.int32()), rows.column("block"), rows.column("shard"), pa.array([packed(x.astype(np.int64)) for x in np.split(recurs, cuts)], pa.binary())], schema=ANSWERS)


def remove_repeats(docs: DataFrame, text: str = "text", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with text replaced by the words that stay, joined by one space, and with n_words and n_removed.

    Words are runs of anything but the six ASCII white space characters. A word goes if a window of `width` words that
    covers it has the same words as a window elsewhere, in the same document or another; also repeated rows count as
    elsewhere. Null text has no words and becomes empty. Other columns pass unchanged; the new ones take underscores on a
    clash. An empty table stays empty. A block holds whole documents, so a longer document makes a larger block.
    """
    spark, shards = docs.sparkSession, tasks(docs.sparkSession)
    given = docs.columns
    names = [free_name(docs, c) for c in ("n_words", "n_removed")]
    blocks = written(text_blocks(docs, text, block_bytes), "blocks")
    request, answer = "shard int, block long, payload binary, several binary", "kind int, block long, shard int, payload binary"

    def ask_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, found, several = Block(batch.slice(i, 1), width).phrases(shards)
                cut = run_starts(shard)
                ends = np.append(cut, len(shard))[1:]
                sent = [squeezed(b"\n".join(found[a:b])) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
                flags = [packed(several[a:b].astype(np.int64)) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard[cut].astype(np.int32)), pa.array([batch.column("block")[i].as_py()] * len(cut), pa.int64()), pa.array(sent, pa.binary()), pa.array(flags, pa.binary())], schema=REQUESTS)
        give_back()

    asked = blocks.select("block", "words", "tokens").mapInArrow(ask_phrases, request)
    table = written(asked.groupBy("shard").applyInArrow(phrase_shard, answer), "phrases")

    def ask_windows(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        if not got.num_rows:
            return REQUESTS.empty_table()
        block = Block(rows, width)
        windows = block.located([p for x in got.column("payload") for p in unsqueezed(x.as_py()).split(b"\n")])
        values, shard, several, _ = block.prints(windows, shards)
        cut = run_starts(shard)
        out = [(-1, None, packed(np.diff(windows, prepend=0)), None)]
        for a, b in zip(cut.tolist(), np.append(cut, len(shard))[1:].tolist(), strict=True):
            out.append((int(shard[a]), None, packed(np.diff(values[a:b], prepend=np.uint64(0)), several[a:b].astype(np.int64)), None))
        return pa.table([pa.array([r[0] for r in out], pa.int32()), pa.array([key[0].as_py()] * len(out), pa.int64()), pa.array([r[2] for r in out], pa.binary()), pa.nulls(len(out), pa.binary())], schema=REQUESTS)

    # What a block has located goes to a group of its own, so that the automaton need not run again.
    asked = blocks.select("block", "words", "tokens").groupBy("block").cogroup(table.groupBy("block")).applyInArrow(ask_windows, request)
    group = F.when(F.col("shard") < 0, -1 - F.col("block")).otherwise(F.col("shard").cast("long"))
    found = written(asked.withColumn("g", group).groupBy("g").applyInArrow(window_shard, answer), "windows")
    fields = [f if f.name != text else T.StructField(text, T.StringType()) for f in docs.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in names)])

    def drop(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        block = Block(rows, width)
        gone = np.zeros(len(block.tokens), bool)
        if got.num_rows:
            kind = got.column("kind").to_pylist()
            windows = np.cumsum(unpacked(got.column("payload")[kind.index(LOCATED)].as_py())[0])
            answers = sorted((s, x) for k, s, x in zip(kind, got.column("shard").to_pylist(), got.column("payload").to_pylist(), strict=True) if k == RECURRING)
            if answers:
                recurs = np.concatenate([unpacked(x)[0] for _, x in answers]) > 0
                gone = block.covered(windows[recurs[block.prints(windows, shards)[3]]])
        row = np.repeat(np.arange(len(block.sizes)), block.sizes)
        removed = np.bincount(row[gone], minlength=len(block.sizes)).astype(np.int64)
        keep = pa.ipc.open_stream(rows.column("rows")[0].as_py()).read_all().columns if len(given) > 1 else []
        columns = dict(zip([c for c in given if c != text], keep, strict=True)) | {text: block.texts(gone)}
        return pa.table([*[columns[c] for c in given], pa.array(block.sizes - 1), pa.array(removed)], names=[*given, *names])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(drop, schema)
