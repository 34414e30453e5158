"""What the operators of this package share: scratch tables, Arrow text buffers, vectorised words and hashes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The six ASCII characters that separate words: tab, line feed, vertical tab, form feed, carriage return, space.
SPACES = bytes([9, 10, 11, 12, 13, 32])
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: Bytes of text that the vectorised kernels work on at once; temporaries are about 60 times as large at most.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, with its scheme: spark.checkpoint.dir. Where that is unset, a session on one
    machine (as in tests) takes a temporary folder; on a cluster, whose machines would not see it, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelens-")
        spark.sparkContext.setCheckpointDir(folder)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", path).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table below the shared folder; remove_scratch() takes it away again."""
    _MADE.append(f"{shared_folder(spark)}/tidelens-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


_MADE: list[str] = []


def remove_scratch(spark: SparkSession) -> None:
    """Deletes what this driver's operators have written to the shared folder; results that are not yet stored need it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


#: Whether Spark removes a query's shuffle files when it ends; else they stay until the driver collects its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once, safe from lost executors, and its shuffle files go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tasks(spark: SparkSession) -> int:
    """Partitions for a keyed exchange; follows the session, which sizes it to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def join_uneven(left: DataFrame, right: DataFrame, on: str, n: str, how: str = "inner", parts: int = 10_000) -> DataFrame:
    """left joined with right, a stored table with one row for each key, whose column n tells how many rows of left have it.

    Keys with more than a parts-th of all those rows are fewer than parts: they are broadcast, so that no task gets all rows
    of a key; only the other keys' rows are exchanged. how: inner or left. Column n is dropped.
    """
    total, most = (x or 0 for x in right.agg(F.sum(n), F.max(n)).head())
    limit = max(1000, total // parts)
    if most <= limit:
        return left.join(right.drop(n), on, how)
    heavy = F.broadcast(right.where(F.col(n) > limit).drop(n))
    rest = right.where(F.col(n) <= limit).drop(n)
    return left.join(heavy, on).unionByName(left.join(heavy.select(on), on, "left_anti").join(rest, on, how))


def lowest(rows: DataFrame, label: str, h: str, sample: int) -> DataFrame:
    """label and h: of each label the `sample` lowest different h. Each label is dealt to 64 tasks first."""
    hashes = rows.select(label, h).distinct()
    for spread_ in (F.pmod(F.col(h), F.lit(64)), F.lit(0)):
        order = Window.partitionBy(label, spread_).orderBy(h)
        hashes = hashes.withColumn("r", F.row_number().over(order)).where(F.col("r") <= sample).drop("r")
    return hashes


def block_of(n: int, *columns: str | Column) -> Column:
    """A number below n that depends on the columns' content alone, so that rows without an id spread too."""
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def free_name(df: DataFrame, wish: str) -> str:
    """wish, or wish with underscores appended until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def give_back() -> None:
    """Returns freed memory to the system at the end of a task: Spark keeps idle Python workers, with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


# --- Arrow text ---------------------------------------------------------------------------------


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the len+1 offsets of its rows, without a copy where possible."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about size bytes each; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in raw, and for each row of offsets the index of its first word (len+1 of them)."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = IS_SPACE[raw]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- hashing ------------------------------------------------------------------------------------

_ODD = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of the SplitMix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_ODD) + np.uint64(seed))


def byte_numbers(seed: int, without: bytes = b"") -> np.ndarray:
    """A fixed number for each byte; 0 for those that are not to count."""
    numbers = stream(256, seed)
    numbers[list(without)] = 0
    return numbers


_BYTE = byte_numbers(11, SPACES)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """At least n powers of an odd multiplier modulo 2**64, kept for the next call."""
    global _POWERS
    if len(_POWERS) < n:
        m = max(256, 1 << (n - 1).bit_length())
        steps = np.full(m, 0xD6E8FEB86659FD93, np.uint64)
        steps[0] = 1
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, numbers: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each word, from its bytes alone; only bytes whose number is 0 may lie between words."""
    out = np.zeros(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = min(len(starts), max(a + 1, int(np.searchsorted(starts, starts[a] + (CHUNK_BYTES >> 2)))))
        lo, hi = int(starts[a]), int(ends[b - 1])
        at = starts[a:b] - lo
        span = np.diff(at, append=hi - lo)
        place = np.arange(hi - lo, dtype=np.int64) - np.repeat(at, span)
        table = powers(int(span.max()))
        out[a:b] = np.add.reduceat(numbers[raw[lo:hi]] * table[place], at)
        a = b
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def gram_hashes(h: np.ndarray, k: int, seed: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """Hashes of all runs of k consecutive numbers of h, by doubling; len(h)-k+1 of them."""
    n, limit = len(h) - k + 1, (1 << 64) - 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, run, length, step, done, shift = np.zeros(n, np.uint64), h, 1, seed | 1, 0, 1
    while True:
        if k & length:
            total += run[done : done + n] * np.uint64(shift)
            done, shift = done + length, shift * step & limit
        if length * 2 > k:
            return mix(total)
        run = run[:-length] + run[length:] * np.uint64(step)
        step, length = step * step & limit, length * 2


def run_starts(x: np.ndarray) -> np.ndarray:
    """Indices at which a sorted array changes value."""
    return np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))


def numbers_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number from 0 for each value, in ascending order of the values, and for each number the first place that has it."""
    code, values = pd.factorize(h)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(values)] = np.arange(len(values))
    which = rank[code]
    first = np.empty(len(values), np.int64)
    first[which[::-1]] = np.arange(len(h) - 1, -1, -1)
    return which, first


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start+count), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def same_bytes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether every span has the bytes of the span whose index other gives."""
    size = ends - starts
    if (size != size[other]).any():
        return False
    a = 0
    while a < len(starts):
        b = min(len(starts), max(a + 1, int(np.searchsorted(starts, starts[a] + (CHUNK_BYTES >> 2)))))
        if (raw[spread(starts[a:b], size[a:b])] != raw[spread(starts[other[a:b]], size[a:b])]).any():
            return False
        a = b
    return True


# --- numbers in few bytes -----------------------------------------------------------------------


def squeezed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers, none below 0, by planes of bytes."""
    head, parts = [], []
    for x in arrays:
        top = int(x.max()) if len(x) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        head += [len(x), width]
        parts.append(np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes())
    return squeezed(np.array([len(arrays), *head], "<i8").tobytes() + b"".join(parts))


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = unsqueezed(data)
    k = int.from_bytes(raw[:8], "little")
    head, at, out = np.frombuffer(raw, "<i8", 2 * k, 8), 8 + 16 * k, []
    for n, width in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64))
        at += n * width
    return out


def joined(parts: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(n)]


# --- blocks of texts ----------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def numbered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, and the distinct words in that order, which does not depend on that of the rows."""
    which, one = numbers_of(word_hashes(raw, starts, ends))
    data = raw.tobytes()
    if not same_bytes(raw, starts, ends, one[which]):  # two words share a hash
        every = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        table = {w: i for i, w in enumerate(sorted(set(every)))}
        return np.array([table[w] for w in every], np.int64), list(table)
    return which, [data[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]


def text_blocks(docs: DataFrame, text: str, block_bytes: int, lower: bool = False, held_out: str | None = None) -> DataFrame:
    """docs cut into blocks of whole texts, to be stored: block, rows, words, tokens, learnt.

    rows: the other columns as Arrow data. words: the different words of the block, the frequent first, joined by line feeds.
    tokens: packed numbers of all tokens (from 1 on the words, 0 the end of a text), of tokens of each text, and whether it
    is not held out; learnt: tokens of the texts that are not. lower: A-Z as a-z.
    """
    others = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            raw, offsets = utf8(batch.column(names.index(text)))
            keep = pa.RecordBatch.from_arrays([batch.column(names.index(c)) for c in others], names=[f"c{i}" for i in range(len(others))]) if others else None
            held = batch.column(names.index(held_out)).to_numpy(zero_copy_only=False).astype(bool) if held_out else np.zeros(batch.num_rows, bool)
            for a, b in chunks(offsets, block_bytes):
                own = raw[offsets[a] : offsets[b]]
                own = _LOWER[own] if lower else own
                starts, ends, first = words(own, offsets[a : b + 1] - offsets[a])
                which, found = numbered(own, starts, ends)
                order = np.argsort(-np.bincount(which, minlength=len(found)), kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                tokens, sizes = np.insert(rank[which] + 1, first[1:], 0), np.diff(first) + 1
                sink = pa.BufferOutputStream()
                if others:
                    with pa.ipc.new_stream(sink, keep.schema) as out:
                        out.write_batch(keep.slice(a, b - a))
                made = [sink.getvalue().to_pybytes(), squeezed(b"\n".join([found[i] for i in order.tolist()])), packed(tokens, sizes, ~held[a:b])]
                yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.binary()) for x in made], pa.array([int(sizes[~held[a:b]].sum())], pa.int64())], names=["rows", "words", "tokens", "learnt"])
        give_back()

    return docs.mapInArrow(run, "rows binary, words binary, tokens binary, learnt long").select(F.monotonically_increasing_id().alias("block"), "*")
