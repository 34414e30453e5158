"""Best-fit packing of token sequences by bin completion.

Lengths are whole numbers up to the capacity, so the search runs on their histogram: however many documents there are, it
sees at most `capacity` numbers. Around the largest remaining length it enumerates fillings that no other filling
dominates, applies a filling as often as the counts allow, prunes branches whose waste cannot beat the incumbent (at first
the best-fit decreasing solution), and stops when the number of bins meets the lower bound. Documents then take the slots
of their length by rank, which needs one exchange.
"""

from __future__ import annotations

import os
import random
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder
from .common import block_of, chunks, free_name, give_back, spread, tasks, utf8, written

#: Tokens of a sequence, the id that ends a document, search nodes, fillings tried at a node, items completed exactly.
CAPACITY, END_ID, NODES, FILLINGS, EXACT = 1024, 2, 1000, 6, 14

# --- the search, on a histogram of lengths ------------------------------------------------------

Pattern = tuple[int, ...]


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Best-fit decreasing over a histogram: patterns of lengths, and how many bins have each."""
    open_bins: dict[int, Counter[Pattern]] = {}  # by what is left
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = min(capacity // size, left)
                bins = {(size,) * each: left // each}
                left -= each * (left // each)
                room_then = capacity - size * each
            else:
                pattern, n = next(iter(open_bins[room].items()))
                k = min(n, left)
                bins = {(*pattern, size): k}
                left -= k
                open_bins[room][pattern] -= k
                if not open_bins[room][pattern]:
                    del open_bins[room][pattern]
                    if not open_bins[room]:
                        del open_bins[room]
                room_then = room - size
            open_bins.setdefault(room_then, Counter()).update(bins)
    return sum(open_bins.values(), Counter())


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and the bound by lengths of which two never share a bin (Martello and Toth's L2)."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts)
    for k in {0, *(s for s in sizes if s <= capacity // 2)}:
        big = sum(n for s, n in counts.items() if s > capacity - k)
        mid = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - k}
        low = sum(s * n for s, n in counts.items() if k <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in mid.items())
        best = max(best, big + sum(mid.values()) + max(0, -(-(low - room) // capacity)))
    return best


def fits_into(small: Pattern, large: Pattern) -> bool:
    """Whether the items of small can be put into those of large as bins: then large dominates small."""
    if not small:
        return True
    if sum(small) > sum(large):
        return False
    head, rest = small[0], small[1:]
    for i, room in enumerate(large):
        if head <= room and (i == 0 or room != large[i - 1]):
            if fits_into(rest, tuple(sorted((*large[:i], *large[i + 1 :], room - head), reverse=True))):
                return True
    return False


def dominated(f: Pattern, g: Pattern) -> bool:
    """Whether g is known to dominate f. Long fillings are tested by first fit alone: one that is kept needlessly costs time."""
    if len(f) <= 8 and len(g) <= 4:
        return fits_into(f, g)
    rooms = list(g)
    for x in f:
        i = next((i for i, r in enumerate(rooms) if r >= x), None)
        if i is None:
            return False
        rooms[i] -= x
    return True


def fillings(counts: dict[int, int], room: int, most: int | None, waste: int, steps: int | None = 3000) -> list[Pattern]:
    """Undominated ways to fill room with at most `waste` left, the fullest first.

    most and steps bound how many are returned and how long they are looked for; None: all of them.
    """
    if counts.get(room):
        return [(room,)]  # an exact single length dominates everything else
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    found: list[Pattern] = []
    full = 0
    stack: list[tuple[int, int, Pattern]] = [(0, room, ())]
    while stack and (most is None or full < most):
        if steps is not None:
            if not steps:
                break
            steps -= 1
        at, left, chosen = stack.pop()
        if left and counts.get(left, 0) > chosen.count(left) and (not chosen or left <= chosen[-1]):
            found.append((*chosen, left))
            full += 1
            continue
        while at < len(sizes) and sizes[at] > left:
            at += 1
        if at == len(sizes) or not left:
            if left <= waste:
                found.append(chosen)
                full += not left
            continue
        stack.append((at + 1, left, chosen))  # without this length
        if chosen.count(sizes[at]) < counts[sizes[at]]:
            stack.append((at, left - sizes[at], (*chosen, sizes[at])))
    kept: list[Pattern] = []
    for f in sorted(set(found), key=lambda f: (-sum(f), len(f), [-s for s in f]))[: None if most is None else 4 * most]:
        if not any(dominated(f, g) for g in kept):
            kept.append(f)
            if len(kept) == most:
                break
    return kept


def exact_bins(counts: dict[int, int], capacity: int, nodes: int | None = None, below: int | None = None) -> Counter[Pattern] | None:
    """The fewest bins, by bin completion over all undominated fillings, one bin at a time; exponential in the items.

    below: only a solution of fewer bins is of interest. None if there is none, or if `nodes` nodes do not suffice to tell.
    """
    best: list[Pattern] | None = None
    fewest = below if below is not None else sum(counts.values()) + 1
    spent = 0

    def go(left: dict[int, int], path: list[Pattern]) -> bool:
        nonlocal best, fewest, spent
        if not left:
            best, fewest = list(path), len(path)
            return True
        spent += 1
        if nodes is not None and spent > nodes:
            return False
        slack = (fewest - 1 - len(path)) * capacity - sum(s * n for s, n in left.items())
        if slack < 0 or len(path) + lower_bound(left, capacity) >= fewest:
            return True
        top = max(left)
        rest = {s: n - (s == top) for s, n in left.items() if n > (s == top)}
        for f in fillings(rest, capacity - top, None, slack, None):
            need = Counter(f)
            if not go({s: n - need[s] for s, n in rest.items() if n > need[s]}, [*path, (top, *f)]):
                return False
        return True

    ended = go(dict(counts), [])
    return Counter(best) if best is not None and (ended or below is not None) else None


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """Patterns and their numbers of bins that hold every length as often as counts says, in as few bins as found.

    Bin completion over the histogram with limited discrepancies. The first descent takes the best filling at every node and
    is not counted. After it, the search leaves the best path found at one node at a time, nearest the leaves first and
    then at doubled distances, takes another filling there and descends again; a better solution becomes the path, and its
    waste the new bound. Every descent ends in a solution: the last EXACT items, or what no filling within the waste bound
    is left for, are completed by the exact search or by best fit. `nodes`, and four for each different length, bound what
    comes after the first descent; the search stops at the lower bound, or when no node has another filling.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    assert all(1 <= s <= capacity for s in counts), "lengths beyond the capacity must be cut first"
    incumbent = best_fit(counts, capacity)
    fewest, bound = sum(incumbent.values()), lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    if fewest == bound:
        return sorted(incumbent.items())
    budget = nodes + 4 * len(counts)

    def choices(left: dict[int, int], waste: int) -> list[Pattern]:
        top = max(left)
        slack = (fewest - 1) * capacity - total - waste  # more waste than this cannot beat the incumbent
        rest = {s: n - (s == top) for s, n in left.items() if n > (s == top)}
        return [(top, *f) for f in fillings(rest, capacity - top, FILLINGS, slack)] if slack >= 0 else []

    def taken(left: dict[int, int], pattern: Pattern) -> tuple[int, dict[int, int]]:
        need = Counter(pattern)
        times = min(left[s] // n for s, n in need.items())
        return times, {s: n - times * need.get(s, 0) for s, n in left.items() if n > times * need.get(s, 0)}

    def descend(path: list[tuple], left: dict[int, int], bins: int, waste: int, counted: bool, astray: float = 0.0) -> None:
        """Follows first fillings, or with the chance astray others, from a node to a solution.

        path: (left, bins, waste, choices, pattern, times) of each node.
        """
        nonlocal incumbent, fewest, best_path, budget
        path, end = list(path), Counter()
        while left:
            budget -= counted
            few = sum(left.values()) <= EXACT
            found = [] if few else choices(left, waste)
            if not found:
                own = exact_bins(left, capacity, 2000, fewest - bins) if few else None
                end = best_fit(left, capacity) if own is None else own
                bins += sum(end.values())
                break
            pattern = found[0] if len(found) == 1 or draw.random() >= astray else draw.choice(found[1:])
            times, then = taken(left, pattern)
            path.append((left, bins, waste, found, pattern, times))
            left, bins, waste = then, bins + times, waste + times * (capacity - sum(pattern))
        if bins < fewest or best_path is None:
            best_path = path
        if bins < fewest:
            fewest, incumbent = bins, end
            for *_, pattern, times in path:
                incumbent[pattern] += times

    best_path: list[tuple] | None = None
    draw = random.Random(5)
    descend([], counts, 0, 0, False)
    searched = None
    while searched is not best_path and fewest > bound and budget > 0:
        searched = best_path
        depth, back = len(searched), 1
        while back <= depth and searched is best_path and fewest > bound and budget > 0:
            left, bins, waste, found, *_ = searched[depth - back]
            for other in found[1:]:
                times, then = taken(left, other)
                lost = waste + times * (capacity - sum(other))
                if total + lost <= (fewest - 1) * capacity and budget > 0:
                    descend([*searched[: depth - back], (left, bins, waste, found, other, times)], then, bins + times, lost, True)
                if searched is not best_path or fewest == bound:
                    break
            back += 1 if back < 8 else back // 4
        open_nodes = max(1, sum(len(found) > 1 for *_, found, _, _ in searched))
        while searched is best_path and fewest > bound and budget > 0:
            descend([], counts, 0, 0, True, draw.choice((2, 4, 8)) / open_nodes)
    return sorted(incumbent.items())


def slots(patterns: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first rank, first bin, offset), sorted: the item of a length with a rank has its bin and place."""
    seen: Counter[int] = Counter()
    rows, bin_ = [], 0
    for pattern, n in patterns:
        place = 0
        for size in pattern:
            rows.append((size, seen[size], bin_, place))
            seen[size] += n
            place += size
        bin_ += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


# --- operators ----------------------------------------------------------------------------------


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """items with sequence_id and offset: every row has its place in a sequence of at most `capacity`, gapless from 0.

    items is read twice, so it should be a stored table. Lengths are 1 to capacity; rows of null or other lengths get null
    places. An empty table stays empty; equal rows take different places. New columns take underscores on a clash.
    """
    spark = items.sparkSession
    good = F.col(length).between(1, capacity)
    counts = {r[0]: r[1] for r in items.where(good).groupBy(F.col(length).cast("int").alias("n")).count().collect()}
    table = slots(complete_bins(counts, capacity))
    # Ranks within a length: a frequent length is dealt to many groups, whose sizes give each group its first rank.
    salt, rank, l_, s_, first_ = (free_name(items, c) for c in ("salt", "rank", "own_length", "own_salt", "first_rank"))
    plain = [c for c, kind in items.dtypes if not kind.startswith("map")]
    salted = items.withColumn(salt, block_of(4 * tasks(spark), *plain))
    group = Window.partitionBy(length, salt)
    sizes = salted.where(good).groupBy(length, salt).count()
    first = sizes.select(
        F.col(length).alias(l_), F.col(salt).alias(s_),
        (F.sum("count").over(Window.partitionBy(length).orderBy(salt)) - F.col("count")).alias(first_),
    )
    ranked = salted.withColumn(rank, F.row_number().over(group.orderBy(*plain[:2])))
    ranked = ranked.join(first, (F.col(length) == F.col(l_)) & (F.col(salt) == F.col(s_)), "left")
    ranked = ranked.withColumn(rank, F.col(first_) + F.col(rank) - 1).drop(salt, l_, s_, first_)
    names = [free_name(items, "sequence_id"), free_name(items, "offset")]
    schema = T.StructType([*items.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    given = items.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            n = np.asarray(batch.column(length).cast(pa.int64()).fill_null(0))
            r = np.asarray(batch.column(rank).cast(pa.int64()).fill_null(0))
            none = (n < 1) | (n > capacity)
            at = np.maximum(np.searchsorted(key, n << 44 | r, side="right") - 1, 0)
            got = table[at] if len(table) else np.zeros((len(n), 4), np.int64)
            columns = [batch.column(c) for c in given]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got[:, 2] + r - got[:, 1], mask=none), pa.array(got[:, 3], mask=none)], names=[*given, *names])

    return ranked.mapInArrow(place, schema)


class _Library:
    """Distinct pieces, or whole rows that hold a special token, encoded by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of a token stands for a byte
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), 2000):  # an encoding takes some 1 kB beside its ids
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + 2000], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter(chain.from_iterable(got), np.int32, int(counts[-1].sum())))
        return np.concatenate(flat), np.concatenate(counts)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has.

        Pieces of a blank and ASCII letters are encoded together, as they stay pieces in a row: an encoding of its own costs
        more than its merges. The bytes of the tokens then tell which are whose.
        """
        plain = np.fromiter((w[:1] == b" " and w[1:].isalpha() for w in words), bool, len(words))
        together = list(compress(words, plain.tolist()))
        lines = [b"".join(together[a : a + 64]).decode() for a in range(0, len(together), 64)]
        ids, _ = self._ids(lines)
        ends = np.cumsum(self.bytes_of[ids])
        last = np.cumsum(np.fromiter(map(len, together), np.int64, len(together)))
        at = np.searchsorted(ends, last)
        if len(last) and not (len(ends) == at[-1] + 1 and (ends[at] == last).all()):  # the vocabulary splits otherwise
            plain[:], ids, at = False, ids[:0], at[:0]
        other, n = self._ids([w.decode("utf-8", "replace") for w in compress(words, (~plain).tolist())])
        counts = np.zeros(len(words), np.int64)
        counts[plain], counts[~plain] = np.diff(at, prepend=-1), n
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[spread(first[plain], counts[plain])] = ids
        out[spread(first[~plain], n)] = other
        return out, counts

    def row(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, np.int32)


@lru_cache(2)
def _library(path: str) -> _Library:
    return _Library(path)


def encode_rows(encoder: Encoder, library: _Library, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, at = encoder.encode(raw, offsets)
    data = raw.tobytes()
    if any(s in data for s in library.special):
        rows = [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        parts = [library.row(t) if any(s in t for s in library.special) else ids[at[i] : at[i + 1]] for i, t in enumerate(rows)]
        ids, at = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return ids, at


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", chunk_bytes: int = 1 << 21) -> DataFrame:
    """A row per piece: docs' other columns, piece (from 0), start, length, and ids (packed little-endian 32-bit).

    A document's ids are those of the tokenizer file and then end_id; null text is empty, so it has one id. Only documents
    of more than capacity ids are cut, however long; all pieces but the first have exactly capacity. Repeated rows each
    have their pieces, rows of a null key too; an empty table has none. New columns take underscores on a clash.
    """
    keep = [f for f in docs.schema.fields if f.name != text]
    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids": T.BinaryType()}
    schema = T.StructType([*keep, *(T.StructField(free_name(docs, c), k) for c, k in kinds.items())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _library(tokenizer)
        encoder = Encoder(library.replay, pattern)
        for batch in batches:
            raw, offsets = utf8(batch.column(text))
            for a, b in chunks(offsets, chunk_bytes):
                ids, at = encode_rows(encoder, library, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                at = at + np.arange(len(at))
                n = np.diff(at)
                short = n % capacity
                count = n // capacity + (short > 0)
                row = np.repeat(np.arange(b - a), count)
                piece = spread(np.zeros(len(n), np.int64), count)
                lead = np.where(short > 0, short, capacity)
                start = np.where(piece > 0, lead[row] + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, lead[row])
                cuts = 4 * np.concatenate((at[row] + start, at[-1:]))
                for c, d in chunks(cuts, 1 << 22):
                    own = pa.py_buffer(ids[cuts[c] // 4 : cuts[d] // 4])
                    packed = pa.Array.from_buffers(pa.binary(), d - c, [None, pa.py_buffer((cuts[c : d + 1] - cuts[c]).astype(np.int32)), own])
                    rest = [batch.column(f.name).take(pa.array(a + row[c:d])) for f in keep]
                    yield pa.RecordBatch.from_arrays([*rest, pa.array(piece[c:d].astype(np.int32)), pa.array(start[c:d]), pa.array(length[c:d]), packed], names=names)
        del encoder
        give_back()

    return docs.mapInArrow(run, schema)


def packed_documents(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """The places of all pieces of all documents, with a CRC-32 of each piece's ids instead of the ids.

    Only doc_id and text are looked at; null texts, long ones, repeated rows and an empty table are as in token_pieces().
    """
    cut = token_pieces(docs.select("doc_id", "text"), tokenizer, pattern, capacity)
    cut = cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(cut, "pieces"), capacity=capacity)
