"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Every task treats its documents as a corpus: it splits them into pieces, keeps each distinct piece once, and replays the
merges over all new pieces together. An inverted index leads from a merge's rank to the positions of its pair in those
pieces; ranks are taken in ascending order, each is applied at all its positions at once, and only the pairs that touch
a merged position are looked up anew. Pieces do not depend on each other, so a task's own corpus gives the same ids as
the whole corpus would, and nothing is shuffled or broadcast.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_numbers, chunks, free_name, give_back, numbers_of, run_starts, same_bytes, spread, utf8, word_hashes

#: Distinct pieces that a task remembers; beyond it the table starts anew (results do not change).
KNOWN_PIECES = 200_000

# --- splitting ----------------------------------------------------------------------------------

OTHER, LETTER, NUMBER, SPACE, BLANK, UNKNOWN = range(6)

# The code points with the Unicode property White_Space, as ranges.
WHITE_SPACE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
# What may follow an apostrophe to form a piece with it.
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]


def _kind(code: int) -> int:
    if code == 0x20:
        return BLANK
    if any(a <= code <= b for a, b in WHITE_SPACE):
        return SPACE
    name = unicodedata.category(chr(code))
    return {"L": LETTER, "N": NUMBER}.get(name[0], UNKNOWN if name == "Cn" else OTHER)


@lru_cache(1)
def _kinds() -> np.ndarray:
    return np.array([_kind(c) for c in range(0x10000)], np.uint8)


def kinds_of(codes: np.ndarray) -> np.ndarray:
    if codes.dtype == np.uint8:
        return _kinds()[codes]
    out = _kinds()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        out[i] = _kind(int(codes[i]))
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the pieces of all rows (one more than pieces), and each row's first piece.

    Follows the public pattern of byte-level BPE vocabularies by classes of characters. Rows with code points that this
    Python's Unicode tables do not assign are split by the pattern itself.
    """
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    data = raw.tobytes()
    if raw.max() < 128:
        codes, place, rows = raw, None, offsets
    else:
        codes = np.frombuffer(data.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))
        rows = np.searchsorted(place, offsets)
    kind = kinds_of(codes)
    n = len(kind)
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    space = (kind == SPACE) | (kind == BLANK)
    group = np.where(space, SPACE, kind)
    change = row_start[:n].copy()
    change[0] = True
    change[1:] |= group[1:] != group[:-1]
    first = change.copy()
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (kind[:-1] == BLANK) & ~row_start[1:n]
    first &= space | ~after_blank  # a blank opens the piece that follows it
    tail = np.zeros(n, bool)  # the last space before something else of the same row
    tail[:-1] = space[:-1] & ~space[1:] & ~row_start[1:n]
    first |= tail
    quotes = np.flatnonzero((codes == 0x27) & change & ~after_blank)
    for i in quotes.tolist():
        if i + 1 < n and kind[i + 1] == LETTER and not row_start[i + 1]:
            at = int(place[i]) if place is not None else i
            end = data[at + 1 : at + 3]
            got = next((c for c in CONTRACTIONS if end.startswith(c)), None)
            if got and not (len(got) == 2 and row_start[i + 2]):
                first[i + 1] = False
                if i + 1 + len(got) < n:
                    first[i + 1 + len(got)] = True
    starts = np.flatnonzero(first)
    if (kind == UNKNOWN).any():
        starts = _by_pattern(data, codes, kind, rows, starts, pattern)
    at = np.append(starts if place is None else place[starts], len(raw)).astype(np.int64)
    return at, np.searchsorted(at[:-1], offsets)


def _by_pattern(data: bytes, codes: np.ndarray, kind: np.ndarray, rows: np.ndarray, starts: np.ndarray, pattern: str) -> np.ndarray:
    import regex

    find, text, out = regex.compile(pattern).finditer, data.decode("utf-8", "replace"), []
    odd = np.searchsorted(rows, np.flatnonzero(kind == UNKNOWN), side="right") - 1
    for r in run_starts(odd):
        a, b = int(rows[odd[r]]), int(rows[odd[r] + 1])
        starts = starts[(starts < a) | (starts >= b)]
        out += [a + m.start() for m in find(text[a:b])]
    return np.sort(np.concatenate((starts, np.array(out, np.int64))))


# --- merging ------------------------------------------------------------------------------------

_NONE = np.iinfo(np.int32).max


class Merges:
    """A vocabulary's merges: for a pair of ids its rank and the id that it becomes."""

    def __init__(self, pairs: Iterable[tuple[int, int, int, int]], bytes_of: dict[int, bytes], whole: bool):
        """pairs: (left, right, rank, id); whole: a piece that is itself in the vocabulary is not split."""
        table = np.array(sorted((a << 32 | b, rank, made) for a, b, rank, made in pairs), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.made = np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        self.bytes_of, self.ids, self.whole = bytes_of, {b: i for i, b in bytes_of.items()}, whole
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        order = np.argsort(self.ranks, kind="stable")
        self._by_rank = self.ranks[order], order

    @classmethod
    @lru_cache(4)
    def from_tiktoken(cls, path: str) -> Merges:
        """A rank file; any two adjacent tokens that join to a token may merge, in the order of its rank."""
        with open(path, "rb") as f:
            ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = ((ids[t[:k]], ids[t[k:]], i, i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids)
        return cls(pairs, {i: t for t, i in ids.items()}, whole=True)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (a huge number: none) and places in the table."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE), at

    def rows_of(self, rank: int) -> np.ndarray:
        """Places in the table of the pairs with a rank; a rank file may have several."""
        ranks, order = self._by_rank
        return order[np.searchsorted(ranks, rank) : np.searchsorted(ranks, rank, side="right")]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        counts = np.ones(len(words), np.int64)
        given = [self.ids.get(w, -1) for w in words] if self.whole else [-1] * len(words)
        known = np.array(given, np.int64)
        rest = [w for w, i in zip(words, given, strict=True) if i < 0]
        ids, n = self._merge(rest)
        counts[known < 0] = n
        out = np.zeros(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        out[at[known >= 0]] = known[known >= 0]
        out[spread(at[known < 0], n)] = ids
        return out, counts

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(w) for w in words], np.int64)
        symbol = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbol)
        if not n:
            return symbol, size
        ends = np.cumsum(size)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[(ends - 1)[size > 0]] = -1
        before[(ends - size)[size > 0]] = -1
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []
        low = np.zeros(len(words), bool)  # words in which a merge made a pair of lower rank than its own

        def add(at: np.ndarray, done: int) -> None:
            rank, _ = self.look_up(symbol[at], symbol[after[at]])
            some = rank != _NONE
            at, rank = at[some], rank[some]
            low[word[at[rank < done]]] = True
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = run_starts(rank)
            for r, part in zip(rank[cut].tolist(), np.split(at, cut[1:]), strict=True) if len(cut) else ():
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(heap, r)

        add(np.flatnonzero(after >= 0).astype(np.int32), -1)
        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank)
            at = np.sort(np.concatenate(found)) if len(found) > 1 else found[0]
            follow = after[at]
            ok = (symbol[at] >= 0) & (follow >= 0)
            at, follow = at[ok], follow[ok]
            left, right, made, ok = symbol[at], symbol[follow], -1, np.zeros(len(at), bool)
            for row in self.rows_of(rank).tolist():
                made = int(self.made[row])
                ok |= (left == int(self.keys[row]) >> 32) & (right == int(self.keys[row]) & 0xFFFFFFFF)
            at = at[ok]
            at = at[run_starts(at)]
            if len(at) > 1 and (overlap := np.isin(after[at], at, assume_unique=True)).any():
                at = self._leftmost(at, after, overlap)
            if not len(at):
                continue
            gone = after[at]
            then = after[gone]
            symbol[at], symbol[gone] = made, -1
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            touched = np.concatenate((before[at], at[then >= 0]))
            touched = np.sort(touched[touched >= 0])
            add(touched[run_starts(touched)], rank)
        left = symbol >= 0
        counts = np.bincount(word[left], minlength=len(words)).astype(np.int64)
        ids = symbol[left]
        for w in np.flatnonzero(low).tolist():
            own = self.one_by_one(words[w])
            a = int(counts[:w].sum())
            ids = np.concatenate((ids[:a], np.array(own, np.int32), ids[a + counts[w] :]))
            counts[w] = len(own)
        return ids, counts

    @staticmethod
    def _leftmost(at: np.ndarray, after: np.ndarray, overlap: np.ndarray) -> np.ndarray:
        """Of overlapping pairs such as both in aaa, those that a scan from the left takes."""
        taken, blocked = [], -1
        for i, follow in zip(at.tolist(), after[at].tolist(), strict=True):
            if i != blocked:
                taken.append(i)
                blocked = follow
        return np.array(taken, np.int32)

    def one_by_one(self, word: bytes) -> list[int]:
        """The lowest-ranked, leftmost pair first, one merge at a time."""
        ids = [int(self.byte_ids[b]) for b in word]
        while len(ids) > 1:
            rank, at = self.look_up(np.array(ids[:-1]), np.array(ids[1:]))
            i = int(rank.argmin())
            if rank[i] == _NONE:
                break
            ids[i : i + 2] = [int(self.made[at[i]])]
        return ids


#: Numbers of the bytes for hashing pieces, which may hold spaces.
PIECE_BYTES = byte_numbers(13)


class Encoder:
    """Encodes chunks of rows; remembers the pieces that it has met."""

    def __init__(self, replay, pattern: str, known: int = KNOWN_PIECES):
        """replay: from a list of distinct pieces to their ids and counts."""
        self.replay, self.pattern, self.known = replay, pattern, known
        self._reset()

    def _reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.at, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and the len+1 offsets of the rows among them."""
        cuts, firsts, n = [], [], 0
        for a, b in chunks(offsets, 1 << 18):
            at, first = pieces(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], self.pattern)
            cuts.append(at[:-1] + offsets[a])
            firsts.append(first[:-1] + n)
            n += len(at) - 1
        at, first = np.concatenate((*cuts, [len(raw)])).astype(np.int64), np.concatenate((*firsts, [n])).astype(np.int64)
        which, own = self._number(raw, at[:-1], at[1:])
        del at, cuts
        n = self.counts[own][which]
        total = np.concatenate(([0], np.cumsum(n)))
        return self.flat[spread(self.at[own][which], n)], total[first]

    def _number(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A number for each piece, equal for equal bytes, and for each such number the place in self's tables."""
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which, one = numbers_of(word_hashes(raw, starts, ends, PIECE_BYTES))
        if not same_bytes(raw, starts, ends, one[which]):  # two different pieces share a hash
            which = np.arange(len(starts))
            one = which
        data = raw.tobytes()
        distinct = [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        del data
        if len(self.index) > self.known:
            self._reset()
        index = self.index
        fresh = [w for w in dict.fromkeys(distinct) if w not in index]
        if fresh:
            ids, counts = self.replay(fresh)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(counts) - counts))
            self.flat, self.counts = np.concatenate((self.flat, ids)), np.concatenate((self.counts, counts))
        return which, np.fromiter(map(index.__getitem__, distinct), np.int64, len(distinct))


# --- operators ----------------------------------------------------------------------------------


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", chunk_bytes: int = 1 << 22) -> DataFrame:
    """docs with a column of token ids (array of int), as the vocabulary's own library would encode the text.

    ranks: path of a rank file that every executor has. Null text encodes as empty: an empty array. Other columns, also
    null ones, pass unchanged; the new column takes underscores if docs has one of its name. Rows are independent, so
    repeated rows, ties and an empty table need no rule. chunk_bytes: text whose new pieces are replayed together.
    """
    ids = free_name(docs, ids)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])
    kind = pa.list_(pa.field("element", pa.int32(), nullable=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Merges.from_tiktoken(ranks).replay, pattern)
        for batch in batches:
            raw, offsets = utf8(batch.column(text))
            for a, b in chunks(offsets, chunk_bytes):
                got, at = encoder.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for c, d in chunks(at, 1 << 20):
                    column = pa.ListArray.from_arrays(pa.array((at[c : d + 1] - at[c]).astype(np.int32)), pa.array(got[at[c] : at[d]]), type=kind)
                    part = batch.slice(a + c, d - c)
                    yield pa.RecordBatch.from_arrays([*part.columns, column], names=[*part.schema.names, ids])
        del encoder
        give_back()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, ranks: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the bytes that a column of ids stands for; a null or empty array gives no bytes."""
    decoded = free_name(docs, decoded)
    schema = T.StructType([*docs.schema.fields, T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Merges.from_tiktoken(ranks).bytes_of
        top = max(table) + 1
        size = np.array([len(table.get(i, b"")) for i in range(top)], np.int64)
        at, flat = np.cumsum(size) - size, np.frombuffer(b"".join(table.get(i, b"") for i in range(top)), np.uint8)
        for batch in batches:
            column = batch.column(ids)
            values = np.asarray(column.flatten())
            cuts = np.concatenate(([0], np.cumsum(np.asarray(column.value_lengths().fill_null(0), np.int64))))
            for a, b in chunks(cuts):
                own = values[cuts[a] : cuts[b]]
                n = size[own]
                text = flat[spread(at[own], n)]
                ends = np.concatenate(([0], np.cumsum(n)))[cuts[a : b + 1] - cuts[a]]
                made = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(text)])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, decoded])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Per document: number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded bytes."""
    coded = decode(encode(docs.select("doc_id", "text"), ranks, pattern).drop("text"), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
