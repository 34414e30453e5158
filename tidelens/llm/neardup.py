"""Near-duplicate documents by ProbMinHash, banding and verification.

A document is a set of shingles of five words, weighted by how often each occurs. Elements emit exponentially distributed
arrivals at a rate equal to their weight; each arrival goes to a random register, and an element stops as soon as its next
arrival is later than every register's earliest. Registers of two documents agree with the probability Jaccard similarity
(Ertl's J_P). Rows with the same weighted set form a class; bands of registers propose pairs of classes; pairs are verified
exactly. Within a bucket every class is compared with one pivot, and where several components are left with a second pivot,
the class closest to the first. Buckets that still hold several components then look for pairs across components; a pair
is verified unless the pivot's exact distances rule it out (1 - J_P obeys the triangle inequality) or FINE other registers,
made for the classes of such buckets only, agree by MARGIN less than the threshold asks for. It is verified where it is
found, and only links leave the task. Links within a component change nothing and are not looked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_of, chunks, free_name, gram_hashes, join_uneven, mix, run_starts, spread, stream, utf8, word_hashes, words, written
from .graph import components

#: Words of a shingle, least similarity, bands and registers of a band: 1 - (1 - 0.8**5)**30 = 0.999993 at the threshold.
SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 5
#: Registers that pairs across components are judged by, how far below the threshold the share of equal ones may be for a
#: pair to be verified (5 standard deviations at the threshold, (0.16 / FINE)**0.5 each; twice that for the first quarter
#: of them, which is looked at before), and classes of a bucket that one task compares with as many others; of long texts
#: fewer: so many bytes of shingles are a tile.
FINE, MARGIN, TILE, TILE_BYTES = 512, 0.0885, 4096, 16 << 20
#: Class ids that may be broadcast to pick out the texts to verify (16 bytes each); more are joined by an exchange.
BROADCAST_CLASSES = 500_000
#: Hashes of keys that one_of_each() broadcasts at most (8 bytes each before Spark's own overhead).
SLOTS = 1 << 21

_MASK = (1 << 44) - 1
_STEP, _ONE, _TWO, _THREE = (int(x) | 1 for x in stream(4, 77))


def shingles(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row as sorted 44-bit hashes, their counts, and the len+1 offsets of the rows.

    A row of fewer than k words, but not none, has one shingle: all its words.
    """
    starts, ends, first = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    n = np.diff(first)
    grams = gram_hashes(h, k)
    many = np.maximum(n - k + 1, 0)
    keys = grams[spread(first[:-1], many)] & np.uint64(_MASK)
    row = np.repeat(np.arange(len(n)), many)
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        at = spread(first[:-1][few], n[few])
        order = spread(np.ones(len(few), np.int64), n[few]).astype(np.uint64)
        sums = np.add.reduceat(mix(h[at] + order * np.uint64(_STEP)), np.cumsum(n[few]) - n[few])
        keys, row = np.concatenate((keys, mix(sums) & np.uint64(_MASK))), np.concatenate((row, few))
    out, counts, rows = [], [], []
    for a in range(0, max(len(n), 1), 1 << 19):  # the row number takes the 20 bits above the hash
        part = (row >= a) & (row < a + (1 << 19)) if len(n) > 1 << 19 else slice(None)
        packed = np.sort((row[part] - a).astype(np.uint64) << np.uint64(44) | keys[part])
        cut = run_starts(packed)
        out.append(packed[cut] & np.uint64(_MASK))
        counts.append(np.diff(cut, append=len(packed)))
        rows.append((packed[cut] >> np.uint64(44)).astype(np.int64) + a)
    return np.concatenate(out), np.concatenate(counts), np.searchsorted(np.concatenate(rows), np.arange(len(n) + 1))


def signatures(elements: np.ndarray, weights: np.ndarray, at: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash registers (rows by m): the element that arrived first in each; rows without elements have zeros."""
    docs = len(at) - 1
    doc = np.repeat(np.arange(docs), np.diff(at))
    e, w, x, reached = mix(elements), weights.astype(np.float64), np.zeros(len(elements)), 0
    first, who = np.full(docs * m, np.inf), np.zeros(docs * m, np.uint64)
    table = first.reshape(docs, m)
    while len(e):
        # When few elements are still active, each makes many arrivals at a time; late ones do no harm.
        block = 1 if len(e) > 2000 else 64
        steps = (np.arange(reached, reached + block, dtype=np.uint64) + np.uint64(1)) * np.uint64(_STEP)
        r = mix((e[:, None] + steps[None, :]).ravel()).reshape(len(e), block)
        gap = -np.log(((r >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / w[:, None]
        times = x[:, None] + np.cumsum(gap, axis=1)
        slot = doc[:, None] * m + ((r & np.uint64(2047)).astype(np.int64) * m >> 11)
        np.minimum.at(first, slot.ravel(), times.ravel())
        won = times == first[slot]
        who[slot[won]] = np.broadcast_to(e[:, None], times.shape)[won]
        x, reached = times[:, -1], reached + block
        cut = run_starts(doc)
        latest = np.repeat(table[doc[cut]].max(axis=1), np.diff(cut, append=len(doc)))
        on = x < latest
        e, w, x, doc = e[on], w[on], x[on], doc[on]
    return who.reshape(docs, m)


def bands_of(registers: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = registers.reshape(len(registers), bands, -1)
    key = np.broadcast_to(stream(bands, 5), parts.shape[:2]).copy()
    for i in range(parts.shape[2]):
        key = mix(key * np.uint64(_ONE) + parts[:, :, i])
    return key


def class_ids(elements: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits for each row that depend on its weighted set alone (rows by 16 bytes)."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    some = np.flatnonzero(np.diff(at) > 0)
    if len(some):
        c = counts.astype(np.uint64)
        for i, odd in enumerate((_TWO, _THREE)):
            out[some, i] = mix(np.add.reduceat(mix(elements * np.uint64(odd) + c), at[:-1][some]) + np.diff(at)[some].astype(np.uint64))
    return out.view(np.uint8).reshape(-1, 16)


def probability_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets with sorted elements; plain Jaccard if all weights are equal."""
    if not len(a) or not len(b):
        return 0.0
    i = np.minimum(np.searchsorted(a, b), len(a) - 1)
    hit = a[i] == b
    n = int(hit.sum())
    if (wa == wa[0]).all() and (wb == wb[0]).all():
        return n / (len(a) + len(b) - n)
    x, y = wa[i[hit]].astype(np.float64), wb[hit].astype(np.float64)
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(-(x / y), kind="stable")
    x, y = x[order], y[order]
    ratio = x / y
    last = np.searchsorted(-ratio, -ratio, side="right")  # those of at least this ratio
    above = np.concatenate(([0.0], np.cumsum(x)))[last] + only_a
    below = y.sum() - np.concatenate(([0.0], np.cumsum(y)))[last] + only_b
    return float((1 / (above / x + below / y)).sum())


def _classes(docs: DataFrame, text: str, keep: list[str], sign: bool) -> DataFrame:
    """keep, cls (16 bytes; null without words) and, if sign, bands (array of long)."""
    fields = [docs.schema[c] for c in keep]
    schema = T.StructType([*fields, T.StructField("cls", T.BinaryType()), *([T.StructField("bands", T.ArrayType(T.LongType()))] if sign else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(text))
            for a, b in chunks(offsets, 1 << 21):
                e, c, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                none = np.diff(at) == 0
                ids = class_ids(e, c, at)
                made = [pa.array([None if x else i.tobytes() for i, x in zip(ids, none, strict=True)], pa.binary())]
                if sign:
                    keys = bands_of(signatures(e, c, at)).view(np.int64)
                    made.append(pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *made], names=schema.names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _texts(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """One text for each wanted class: cls, t."""
    found = _classes(docs.select(F.col(text).alias("t")), "t", ["t"], False)
    wanted = written(wanted.distinct(), "wanted")
    small = wanted.count() <= BROADCAST_CLASSES
    picked = found.join(F.broadcast(wanted) if small else wanted, "cls", "left_semi")
    return written(picked.groupBy("cls").agg(F.first("t").alias("t")), "texts")


def _fine(texts: DataFrame) -> DataFrame:
    """cls, bytes (a byte of each of FINE registers, which are independent of those of the bands), elements and counts (8 bytes
    for each shingle and how often it occurs; counts are empty where all are 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("t"))
            for a, b in chunks(offsets, 1 << 20):
                e, c, at = shingles(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                low = (signatures(mix(e ^ np.uint64(_TWO)), c, at, FINE) & np.uint64(255)).astype(np.uint8)
                spans = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
                counts = c.astype(np.int64)
                made = [[row.tobytes() for row in low], [e[x:y].tobytes() for x, y in spans], [b"" if (counts[x:y] == 1).all() else counts[x:y].tobytes() for x, y in spans]]
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(a, b - a), *[pa.array(x, pa.binary()) for x in made]], names=["cls", "bytes", "elements", "counts"])

    return texts.select("cls", "t").mapInArrow(run, "cls binary, bytes binary, elements binary, counts binary")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes with their exact similarity j."""
    rows = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [utf8(batch.column(c))[1] for c in ("ta", "tb")]
            for lo, hi in chunks(sizes[0] + sizes[1], 1 << 21):
                part = batch.slice(lo, hi - lo)
                (ea, ca, xa), (eb, cb, xb) = (shingles(*utf8(part.column(c))) for c in ("ta", "tb"))
                j = np.array([probability_jaccard(ea[xa[i] : xa[i + 1]], ca[xa[i] : xa[i + 1]], eb[xb[i] : xb[i + 1]], cb[xb[i] : xb[i + 1]]) for i in range(part.num_rows)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(j, pa.float64())], names=["a", "b", "j"])

    return rows.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("j", T.DoubleType())]))


def _across(open_: DataFrame, similarity: float, exact: bool) -> DataFrame:
    """Links (a, b) that join components of one bucket: pairs ruled out neither by distance nor by registers (exact: by
    distance alone), verified in the task that finds them, so that no row is made for a pair that is no link.

    open_: spot, tiles, cls, root, far and far1 (distances to the bucket's second and first pivot), bands, bytes, elements,
    counts. A pair comes from the first of the buckets that it shares. A large bucket is dealt as tiles, each with each. A
    link joins its components for the rest of the task, so a task gives fewer links than it has classes.
    """
    own = F.pmod(F.xxhash64("cls"), "tiles").cast("int")
    rows = open_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("spot", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "root", "far", "far1", "bands", "bytes", "elements", "counts")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        spot, x, y = (k.as_py() for k in key)
        cls, roots = part.column("cls").to_pylist(), {r: i for i, r in enumerate(dict.fromkeys(part.column("root").to_pylist()))}
        root = np.array([roots[r] for r in part.column("root").to_pylist()])
        far, far1 = (np.asarray(part.column(c).combine_chunks().fill_null(np.nan)) for c in ("far", "far1"))
        bands = np.asarray(part.column("bands").combine_chunks().flatten()).reshape(len(cls), -1)
        low = np.stack([np.frombuffer(v, np.uint8) for v in part.column("bytes").to_pylist()])
        tile, names = np.asarray(part.column("own")), np.array(cls, object)
        sets = [np.frombuffer(v, np.uint64) for v in part.column("elements").to_pylist()]
        weights = [np.frombuffer(v, np.int64) if v else np.ones(len(e), np.int64) for v, e in zip(part.column("counts").to_pylist(), sets, strict=True)]
        order = np.argsort(names, kind="stable")
        place = np.empty(len(cls), np.int64)
        place[order] = np.arange(len(cls))
        left, right = [], []
        for i in range(len(cls)):
            too_far = (np.abs(far - far[i]) > 1 - similarity + 1e-9) | (np.abs(far1 - far1[i]) > 1 - similarity + 1e-9)
            j = np.flatnonzero((root != root[i]) & (place > place[i]) & ((tile != tile[i]) | (x == y)) & ~too_far)
            for some, margin in () if exact else ((FINE // 4, 2 * MARGIN), (FINE, MARGIN)):
                j = j[(low[j, :some] == low[i, :some]).mean(axis=1) >= similarity - margin]
            if len(j):
                j = j[bands[i][(bands[j] == bands[i]).argmax(axis=1)] == spot]
            for other in j.tolist():
                if root[other] != root[i] and probability_jaccard(sets[i], weights[i], sets[other], weights[other]) >= similarity - 1e-12:
                    left.append(cls[i])
                    right.append(cls[other])
                    root[root == root[other]] = root[i]
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return rows.groupBy("spot", "x", "y").applyInArrow(run, "a binary, b binary").distinct()


def labelled(docs: DataFrame, key: str, text: str, similarity: float, exact: bool) -> DataFrame:
    """A row per document: k (the key), h (a hash of the text), root (null without words: equal for those that links join)."""
    docs = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    text = "text"
    signed = written(_classes(docs, text, ["k", "h"], True), "signatures")
    reps = signed.where("cls is not null").groupBy("cls").agg(F.first("bands").alias("bands"))
    spots = reps.select("cls", F.explode("bands").alias("spot"))
    pivots = spots.groupBy("spot").agg(F.min("cls").alias("pivot"), F.count("*").alias("n"), F.count("*").alias("rows")).where("n > 1")
    members = written(join_uneven(spots, written(pivots, "pivots"), "spot", "rows"), "buckets")
    texts = _texts(docs, text, members.select("cls"))
    pair = (F.least("pivot", "cls").alias("a"), F.greatest("pivot", "cls").alias("b"))
    tested = written(_verify(members.where("cls <> pivot").select(*pair).distinct(), texts), "tested")

    def still_open(rows: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows of buckets that hold several components, with each class's component; and all components."""
        labels = components(links).toDF("cls", "root")
        known = rows.drop("root").join(labels, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        mixed = known.groupBy("spot").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
        return join_uneven(known, written(mixed.select("spot", "rows"), "mixed"), "spot", "rows"), labels

    similar = F.col("j") >= similarity - 1e-12
    left, labels = still_open(members, tested.where(similar).select("a", "b"))
    # A second pivot for the buckets left: the class most similar to the first one.
    left = written(left.join(tested.withColumnRenamed("j", "near"), (F.col("a") == F.least("pivot", "cls")) & (F.col("b") == F.greatest("pivot", "cls")), "left").drop("a", "b"), "left")
    second = left.where("near is not null").groupBy("spot").agg(F.max_by("cls", F.struct("near", "cls")).alias("next"), F.count("*").alias("rows"))
    left = left.withColumn("far1", F.when(F.col("cls") == F.col("pivot"), 0.0).otherwise(1 - F.col("near")))
    second = written(second.withColumnRenamed("next", "pivot"), "second")
    left = written(join_uneven(left.drop("pivot", "near"), second, "spot", "rows"), "left")
    more = left.where("cls <> pivot").select(*pair).distinct().join(tested.select("a", "b"), ["a", "b"], "left_anti")
    tested = tested.union(written(_verify(more, texts), "tested"))
    left, labels = still_open(left, tested.where(similar).select("a", "b"))
    far = left.join(tested, (F.col("a") == F.least("pivot", "cls")) & (F.col("b") == F.greatest("pivot", "cls")), "left")
    far = far.select("spot", "cls", "root", "far1", F.when(F.col("cls") == F.col("pivot"), 0.0).otherwise(1 - F.col("j")).alias("far"))
    fine = _fine(texts.join(left.select("cls").distinct(), "cls", "left_semi"))
    fine = written(reps.join(fine, "cls"), "fine")
    size = fine.select("cls", (F.length("elements") + F.length("counts")).cast("long").alias("size"))
    sizes = far.join(size, "cls").groupBy("spot").agg(F.count("*").alias("rows"), F.sum("size").alias("size"))
    tiles = F.ceil(F.greatest(F.col("rows") / TILE, F.col("size") / TILE_BYTES)).cast("int")
    far = join_uneven(far, written(sizes.select("spot", "rows", tiles.alias("tiles")), "tiles"), "spot", "rows")
    across = written(_across(far.join(fine, "cls"), similarity, exact), "across")
    if not across.isEmpty():
        labels = components(labels.toDF("a", "b").union(across)).toDF("cls", "root")
    rows = signed.select("k", "h", "cls").join(labels, "cls", "left").select("k", "h", F.coalesce("root", "cls").alias("root"))
    return written(rows, "labelled")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """A row per document: key, component_id (smallest key that similar documents lead to), n_rows of the component, kept.

    Null or empty texts, and texts of white space, link with nothing. Equal texts are linked, repeated rows too: they share
    one key and one flag. kept is key = component_id; components whose keys are all null have a null id and are kept.
    Texts may be of any length; columns besides key and text are left out; an empty table stays empty. exact: pairs across
    components of one bucket are verified unless an exact distance rules them out; else registers may, with the chance that
    stands beside MARGIN.
    """
    rows = labelled(docs, key, text, similarity, exact)
    heads = written(rows.where("root is not null").groupBy("root").agg(F.min("k").alias("head"), F.count("*").alias("n")), "heads")
    out = join_uneven(rows, heads.withColumn("n_rows", F.col("n")), "root", "n", "left")
    single = F.col("root").isNull()
    return out.select(
        F.col("k").alias(key),
        F.when(single, F.col("k")).otherwise(F.col("head")).alias("component_id"),
        F.coalesce("n_rows", F.lit(1)).alias("n_rows"),
        (single | F.col("head").isNull() | (F.col("k") == F.col("head"))).alias("kept"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """docs without near copies: of each component the row with the smallest key (and of these that of the lowest text hash).

    Rows of one key and text are repeated rows, of which a component leaves one; rows of one key and different texts are
    documents of their own. Rows without a key and texts without words stay. Texts may be of any length, other columns pass
    unchanged whatever their names, an empty table stays empty. Only rows whose key may be that of a component of several
    rows are exchanged with their texts: a broadcast of at most SLOTS hashes picks them out, and the rest pass by.
    """
    rows = labelled(docs, key, text, similarity, exact).where("root is not null and k is not null")
    heads = written(rows.groupBy("root").agg(F.min(F.struct("k", "h")).alias("head"), F.count("*").alias("n")).where("n > 1"), "heads")
    slot, one, k_, h_, stays = (free_name(docs, c) for c in ("slot", "row_number", "k", "h", "stays"))
    fate = join_uneven(rows, heads, "root", "n").select(F.col("k").alias(k_), F.col("h").alias(h_), (F.struct("k", "h") == F.col("head")).alias(stays))
    fate = written(fate.groupBy(k_, h_).agg(F.max(stays).alias(stays)), "fate")
    slots = F.broadcast(fate.select(block_of(SLOTS, k_).alias(slot)).distinct())
    rows = docs.withColumn(slot, F.when(F.col(key).isNotNull(), block_of(SLOTS, key)))
    alone = rows.join(slots, slot, "left_anti").drop(slot)
    found = rows.join(slots, slot, "left_semi").drop(slot)
    found = found.join(fate, (F.col(key) == F.col(k_)) & (F.xxhash64(text) == F.col(h_)), "left")
    single = found.where(F.col(k_).isNull()).drop(k_, h_, stays)
    order = Window.partitionBy(key, F.xxhash64(text)).orderBy(F.lit(0))
    first = found.where(F.col(stays)).drop(k_, h_, stays).withColumn(one, F.row_number().over(order)).where(F.col(one) == 1).drop(one)
    return alone.union(single).union(first)
