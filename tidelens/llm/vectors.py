"""Embeddings: multiprobe p-stable search and PCA-ordered near-duplicate links.

Both work on distinct vectors only: rows with the same components form one class, whatever their number.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_uneven, mix, run_starts, spread, stream, tasks, written
from .graph import components

#: Search: projections of a table, width of a cell (for unit vectors), tables, buckets visited in each.
SIZE = (8, 2.5, 6, 48)
#: Rows of one part of the index, rows of a bucket beyond which it is split among parts, and how many such buckets are
#: broadcast at most (16 bytes each; in larger indexes buckets are split from more rows on).
PART_ROWS, BUCKET_ROWS, BROADCAST_BUCKETS = 50_000, 20_000, 1_000_000
#: Near-duplicates: least cosine, vectors of a tile, leading coordinates that bound a tile, tiles whose bounds are broadcast
#: at most (136 bytes each; with more vectors tiles are larger), tiles a side of what a task compares at a time.
COSINE, TILE, BOX, TILES, SIDE = 0.9, 4096, 8, 200_000, 3


def usable(rows: DataFrame, key: str, vector: str, all_rows: bool = False) -> DataFrame:
    """key and v (the components as little-endian doubles) of the rows with a vector that has a direction.

    Null and zero vectors, and those with null or non-finite components or another length than most rows, are left out.
    all_rows: they are kept, with a null v.
    """
    most = rows.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0].d if most else 0
    schema = T.StructType([rows.schema[key], T.StructField("v", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fits = np.asarray(column.value_lengths().fill_null(0)) == d
            part = batch.filter(pa.array(fits))
            x = np.asarray(part.column(1).flatten().cast(pa.float64()).fill_null(np.nan), "<f8").reshape(-1, d or 1)
            with np.errstate(over="ignore", invalid="ignore"):
                size = (x * x).sum(axis=1)
            good = np.isfinite(size) & (size > 0)
            x = np.ascontiguousarray(x[good])
            ends = np.arange(len(x) + 1, dtype=np.int32) * (8 * d)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), packed], names=[key, "v"])
            if all_rows:
                out = fits.copy()
                out[fits] = good
                rest = batch.column(0).filter(pa.array(~out))
                yield pa.RecordBatch.from_arrays([rest, pa.nulls(len(rest), pa.binary())], names=[key, "v"])

    return rows.select(key, vector).mapInArrow(run, schema)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.binary())
    if not len(column):
        return np.zeros((0, 1))
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, "<f8")[at[0] // 8 : at[-1] // 8].reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


# --- search -------------------------------------------------------------------------------------


class Tables:
    """p-stable hash tables over unit vectors: cells of random projections, and their neighbours by estimated success."""

    def __init__(self, d: int, projections: int, cell: float, tables: int, probes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.axes, self.shift, self.cell = rng.normal(size=(tables, d, projections)), rng.uniform(0, cell, (tables, projections)), cell
        self.steps = np.array(list(itertools.product((0, -1, 1), repeat=projections)), np.int64)
        self.odd, self.probes = stream(projections + 1, 3).view(np.int64) | 1, min(probes, len(self.steps))

    def cells(self, u: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        at = (u @ self.axes[table] + self.shift[table]) / self.cell
        cell = np.floor(at)
        return cell.astype(np.int64), (at - cell) * self.cell

    def keys(self, cell: np.ndarray, table: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((cell * self.odd[:-1]).sum(axis=-1) + self.odd[-1] * (table + 1)) * np.int64(0x2545F4914F6CDD1D)

    def own(self, u: np.ndarray) -> np.ndarray:
        """Bucket of each vector in each table (rows by tables)."""
        return np.stack([self.keys(self.cells(u, t)[0], t) for t in range(len(self.axes))], axis=1)

    def visited(self, u: np.ndarray) -> np.ndarray:
        """Buckets to visit in order of the sum of squared distances to the cells crossed (rows by tables*probes)."""
        out = np.empty((len(u), len(self.axes), self.probes), np.int64)
        for t in range(len(self.axes)):
            cell, inside = self.cells(u, t)
            options = np.stack([np.zeros_like(inside), inside**2, (self.cell - inside) ** 2], axis=2).astype(np.float32)
            for i in range(0, len(u), 32):
                cost = np.zeros((len(u[i : i + 32]), 1), np.float32)
                for axis in range(options.shape[1]):  # all sums, in the order of self.steps
                    cost = (cost[:, :, None] + options[i : i + 32, None, axis]).reshape(len(cost), -1)
                first = np.argpartition(cost, self.probes - 1, axis=1)[:, : self.probes]
                first = np.take_along_axis(first, np.argsort(np.take_along_axis(cost, first, axis=1), axis=1, kind="stable"), axis=1)
                out[i : i + 32, t] = self.keys(cell[i : i + 32, None, :] + self.steps[first], t)
        return out.reshape(len(u), -1)


def nearest(rows: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", size: tuple[int, float, int, int] = SIZE) -> DataFrame:
    """For each usable vector whose key is divisible by `every`: query_id, rank, key and score (cosine) of the k nearest found.

    A query's own key is no candidate, nor are further rows with that key; of several vectors of a query's key the smallest
    by its bytes is the query. Null keys take no part. Ties go to the smaller key; equal vectors are candidates each with its
    own key. Fewer than k candidates give fewer rows; an empty table, or one without usable vectors, gives none. Vectors may
    be of any length, other columns are left out. size: the index, as SIZE.
    """
    spark = rows.sparkSession
    base = usable(rows.where(F.col(key).isNotNull()), key, vector).distinct()
    few = Window.partitionBy("v").orderBy(key)
    base = base.withColumn("n_", F.row_number().over(few)).where(F.col("n_") <= k + 1)
    reps = written(base.groupBy("v").agg(F.sort_array(F.collect_list(key)).alias("ids")), "vectors")
    count = reps.count()
    if not count:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    d = len(reps.head().v) // 8
    projections, cell, tables, probes = size
    index = Tables(d, projections, cell, tables, probes)
    parts = max(tasks(spark), -(-count * tables // PART_ROWS))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(index.own(unit(matrix(batch.column("v")))).ravel())], names=["bucket"])

    # Buckets of many rows are split among parts; all parts of a bucket are visited.
    large = max(BUCKET_ROWS, -(-count * tables // BROADCAST_BUCKETS))
    sizes = reps.select("v").mapInArrow(buckets, "bucket long").groupBy("bucket").count().where(F.col("count") > large)
    heavy = sizes.select("bucket", F.ceil(F.col("count") / large).cast("long").alias("times")).orderBy("bucket").toArrow()
    split = spark.sparkContext.broadcast(tuple(np.asarray(heavy.column(c).combine_chunks(), np.int64) for c in ("bucket", "times")))

    def times(bucket: np.ndarray) -> np.ndarray:
        names, n = split.value
        if not len(names):
            return np.ones(len(bucket), np.int64)
        at = np.minimum(np.searchsorted(names, bucket), len(names) - 1)
        return np.where(names[at] == bucket, n[at], 1)

    def part_of(bucket: np.ndarray, share: np.ndarray) -> np.ndarray:
        return ((mix(bucket) + share.astype(np.uint64)) % np.uint64(parts)).astype(np.int32)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            keys, lot = index.own(unit(x)), mix(np.ascontiguousarray(x).view(np.uint64).sum(axis=1, dtype=np.uint64))
            for t in range(tables):
                share = lot % times(keys[:, t]).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(part_of(keys[:, t], share)), pa.array(keys[:, t]), batch.column("v"), batch.column("ids")], names=["part", "bucket", "v", "ids"])

    held = reps.mapInArrow(own, "part int, bucket long, v binary, ids array<long>")
    queries = usable(rows.where(F.col(key) % every == 0), key, vector).groupBy(F.col(key).alias("query_id")).agg(F.min("v").alias("v"))

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The calls to a part: a query once, with all the buckets that it visits there."""
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                own = batch.slice(a, 256)
                out: tuple[list, list, list] = ([], [], [])
                for i, asked in enumerate(index.visited(unit(matrix(own.column("v"))))):
                    bucket = np.unique(asked)
                    n = times(bucket)
                    part = part_of(np.repeat(bucket, n), spread(np.zeros(len(n), np.int64), n))
                    bucket = np.repeat(bucket, n)
                    order = np.lexsort((bucket, part))
                    cut = run_starts(part[order])
                    for where, found in zip(part[order][cut].tolist(), np.split(bucket[order], cut[1:]), strict=True):
                        for column, value in zip(out, (where, i, np.unique(found).tolist()), strict=True):
                            column.append(value)
                at = pa.array(out[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), own.column("query_id").take(at), own.column("v").take(at), pa.array(out[2], pa.list_(pa.int64()))], names=["part", "query_id", "v", "buckets"])

    calls = queries.repartition(tasks(spark), "query_id").mapInArrow(visited, "part int, query_id long, v binary, buckets array<long>")

    def search(own: pa.Table, asked: pa.Table) -> pa.Table:
        bucket = np.asarray(own.column("bucket"))
        order = np.argsort(bucket, kind="stable")
        x = matrix(own.column("v"))[order]
        bucket, norm = bucket[order], np.sqrt((x * x).sum(axis=1))
        ids = own.column("ids").combine_chunks()
        head = np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - np.asarray(ids.offsets)[0]][order] if len(order) else np.zeros(0, np.int64)
        q, found = matrix(asked.column("v")), ([], [], [])
        for i, (name, calls_) in enumerate(zip(asked.column("query_id").to_pylist(), asked.column("buckets"), strict=True)):
            want = np.sort(np.asarray(calls_.values))
            lo, hi = np.searchsorted(bucket, want), np.searchsorted(bucket, want, side="right")
            at = np.concatenate([np.arange(a, b) for a, b in zip(lo.tolist(), hi.tolist(), strict=True) if b > a] or [np.zeros(0, np.int64)])
            if not len(at):
                continue
            score = x[at] @ q[i] / (norm[at] * np.sqrt(q[i] @ q[i]))
            if len(at) > 8 * (k + 1) * tables:  # the same class may stand once in each table
                edge = np.partition(score, -(k + 1) * tables)[-(k + 1) * tables]
                at, score = at[score >= edge], score[score >= edge]
            best = np.lexsort((head[at], -score))
            best = best[np.sort(np.unique(head[at][best], return_index=True)[1])][: k + 1]
            found[0].extend([name] * len(best))
            found[1].extend(score[best].tolist())
            found[2].extend(order[at[best]].tolist())
        return pa.table({"query_id": pa.array(found[0], pa.int64()), "score": pa.array(found[1], pa.float64()), "ids": ids.take(pa.array(found[2], pa.int64()))})

    near = held.groupBy("part").cogroup(calls.groupBy("part")).applyInArrow(search, "query_id long, score double, ids array<long>")
    # The best classes of all parts, then their rows.
    near = near.withColumn("head", F.element_at("ids", 1)).groupBy("query_id", "head").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "head")
    near = near.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= k + 1)
    each = near.select("query_id", "score", F.explode("ids").alias(key)).where(F.col(key) != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


# --- links --------------------------------------------------------------------------------------


def principal_axes(reps: DataFrame, d: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors, of the largest eigenvalue first; d*d sums reach the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            u = unit(matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, d))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d * d)), pa.array(total.ravel())], names=["i", "x"])

    sums = np.zeros(d * d)
    for r in reps.select("v").mapInArrow(moments, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        sums[r.i] = r.x
    return np.linalg.eigh(sums.reshape(d, d))[1][:, ::-1].copy()


class _Tile:
    def __init__(self, packed: bytes, axes: np.ndarray, lead: int):
        n = int.from_bytes(packed[:8], "little")
        self.key = np.frombuffer(packed, "<i8", n, 8)
        self.n = np.frombuffer(packed, "<i8", n, 8 + 8 * n)
        self.u = np.frombuffer(packed, "<f8", offset=8 + 16 * n).reshape(n, -1)
        y = self.u @ axes
        self.lead = y[:, :lead].astype(np.float32)
        self.rest = np.sqrt(np.maximum(1 - (self.lead.astype(np.float64) ** 2).sum(axis=1), 0)).astype(np.float32)
        half = (lead + y.shape[1]) // 2
        self.middle, self.tail = y[:, lead:half], np.sqrt(np.maximum((y[:, half:] ** 2).sum(axis=1), 0))


def compare(a: _Tile, b: _Tile, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted links of a's and of b's vectors, and for each of all of them the smallest place it is connected to."""
    n, slack = len(a.key), np.float32(1e-5)
    links, label = np.zeros(n + len(b.key), np.int64), np.arange(n + len(b.key))
    shift = 0 if same else n
    for lo in range(0, n, 256):
        hi = min(n, lo + 256)
        first = lo if same else 0
        bound = a.lead[lo:hi] @ b.lead[first:].T
        bound += a.rest[lo:hi, None] * b.rest[None, first:]
        i, j = np.nonzero(bound >= np.float32(cosine) - slack)
        i, j = i + lo, j + first
        if same:
            i, j = i[j > i], j[j > i]
        for c in range(0, len(i), 1 << 17):
            x, y = i[c : c + (1 << 17)], j[c : c + (1 << 17)]
            near = np.einsum("ij,ij->i", a.lead[x].astype(np.float64), b.lead[y].astype(np.float64)) + np.einsum("ij,ij->i", a.middle[x], b.middle[y]) + a.tail[x] * b.tail[y]
            x, y = x[near >= cosine - 1e-5], y[near >= cosine - 1e-5]
            hit = np.einsum("ij,ij->i", a.u[x], b.u[y]) >= cosine
            x, y = x[hit], y[hit]
            if not len(x):
                continue
            np.add.at(links, x, b.n[y])
            np.add.at(links, y + shift, a.n[x])
            y = y + shift
            while True:
                least = np.minimum(label[x], label[y])
                if (label[x] == label[y]).all():
                    break
                np.minimum.at(label, label[x], least)
                np.minimum.at(label, label[y], least)
                while (label[label] != label).any():
                    label = label[label]
    return links[:n], links[n:] if not same else links[:0], label


def near_links(rows: DataFrame, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row per vector: key, n_links (other vectors of at least this cosine), component_id (smallest key reachable), kept.

    Distinct vectors are sorted along the first principal axis and cut into tiles. A pair of tiles is compared if boxes
    around their leading coordinates and the largest remaining norms allow the cosine; within it, leading coordinates come
    first, and a pair of vectors goes on only while its product plus the product of the norms that remain can reach it.
    Vectors that usable() leaves out, and null keys, link with nothing, whatever other rows share their key. Repeated rows
    count as other vectors; ties need no rule. Vectors may be of any length, other columns are left out, and an empty table
    stays empty.
    """
    spark = rows.sparkSession
    every = usable(rows, key, vector, all_rows=True).select(key, F.when(F.col(key).isNotNull(), F.col("v")).alias("v"))
    every = written(every.withColumn("cls", F.unhex(F.md5("v"))), "vectors")
    vectors, bad = every.where("v is not null"), every.where("v is null")
    bad = bad.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id"))
    classes = vectors.groupBy("cls").agg(F.first("v").alias("v"), F.min(key).alias("head"), F.count("*").alias("n"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("c"), "*"), "classes")
    head, kept = classes.head(), F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))
    if head is None:
        return bad.withColumn("kept", kept)
    d = len(head.v) // 8
    axes = principal_axes(classes, d)
    box, count = min(BOX, d), classes.count()
    tile_rows = max(TILE, -(-count // TILES))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = unit(matrix(batch.column("v"))) if batch.num_rows else np.zeros((0, d))
            yield pa.RecordBatch.from_arrays([batch.column("c"), batch.column("n"), batch.column("v"), pa.array(u @ axes[:, 0])], names=["c", "n", "v", "x"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            held += [batch] if batch is not None and batch.num_rows else []
            while held and (batch is None or sum(b.num_rows for b in held) >= tile_rows):
                table = pa.Table.from_batches(held)
                own, rest = table.slice(0, tile_rows), table.slice(tile_rows)
                held = rest.to_batches() if rest.num_rows else []
                u = unit(matrix(own.column("v")))
                y = (u @ axes)[:, :box]
                left = np.sqrt(np.maximum(1 - (y**2).sum(axis=1), 0)).max()
                blob = len(u).to_bytes(8, "little") + np.asarray(own.column("c"), "<i8").tobytes() + np.asarray(own.column("n"), "<i8").tobytes() + u.astype("<f8").tobytes()
                bounds = [*y.min(axis=0).tolist(), *y.max(axis=0).tolist(), float(left)]
                yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), pa.array([bounds], pa.list_(pa.float64()))], names=["blob", "bounds"])

    tiles = classes.select("c", "n", "v").mapInArrow(project, "c long, n long, v binary, x double")
    tiles = tiles.repartitionByRange(max(1, -(-count // tile_rows)), "x", "c").sortWithinPartitions("x", "c").mapInArrow(pack, "blob binary, bounds array<double>")
    tiles = written(tiles.select(F.monotonically_increasing_id().alias("tile"), "*"), "tiles")
    found = sorted((r.tile, r.bounds) for r in tiles.select("tile", "bounds").toLocalIterator())
    names = np.array([b[0] for b in found])
    shared = spark.sparkContext.broadcast((names, np.array([b[1] for b in found])))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, edges = shared.value
        low, high, rest = edges[:, :box], edges[:, box : 2 * box], edges[:, -1]
        for batch in batches:
            for tile in batch.column("tile").to_pylist():
                i = int(np.searchsorted(names, tile))
                corners = np.stack([low[i] * low, low[i] * high, high[i] * low, high[i] * high]).max(axis=0).sum(axis=1)
                fit = np.flatnonzero((corners + rest[i] * rest >= cosine - 1e-9) & (np.arange(len(names)) >= i))
                columns = [np.full(len(fit), tile), names[fit], np.full(len(fit), i // SIDE), fit // SIDE]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["i", "j", "a", "b"])

    # A task gets the tiles of a square of SIDE by SIDE pairs, each once, and compares the pairs that fit.
    pairs = written(tiles.select("tile").mapInArrow(partners, "i long, j long, a long, b long"), "pairs")
    need = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), F.explode(F.array("i", "j")).alias("tile")).distinct()
    need = need.join(tiles.select("tile", "blob"), "tile")
    lead = min(d, max(8, 3 * d // 8))

    def link(key_: tuple, listed: pa.Table, own: pa.Table) -> pa.Table:
        held = dict(zip(own.column("tile").to_pylist(), own.column("blob").to_pylist(), strict=True))
        made: dict[int, _Tile] = {}

        def tile(i: int) -> _Tile:
            if i not in made:
                made[i] = _Tile(held.pop(i), axes, lead)
            return made[i]

        parts: tuple[list, list, list] = ([], [], [])
        for i, j in zip(listed.column("i").to_pylist(), listed.column("j").to_pylist(), strict=True):
            a, b = tile(i), tile(j)
            la, lb, label = compare(a, b, i == j, cosine)
            names, n = (a.key, la) if i == j else (np.concatenate((a.key, b.key)), np.concatenate((la, lb)))
            some = np.flatnonzero(n)
            for part, x in zip(parts, (names[some], names[label[some]], n[some]), strict=True):
                part.append(x)
        return pa.table([pa.array(np.concatenate(x)) for x in parts], names=["a", "b", "n"])

    work = pairs.groupBy("a", "b").cogroup(need.groupBy("x", "y"))
    linked = written(work.applyInArrow(link, "a long, b long, n long"), "links")
    degree = linked.groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("n_"))
    root = components(linked.select("a", "b")).toDF("c", "root")
    full = classes.drop("v").join(degree, "c", "left").join(root, "c", "left")
    full = full.select("cls", "n", "head", F.coalesce("root", "c").alias("root"), (F.coalesce("n_", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    full = written(full, "classes")
    least = written(full.groupBy("root").agg(F.min("head").alias("component_id"), F.count("*").alias("m")), "roots")
    full = written(join_uneven(full, least, "root", "m").select("cls", "n", "n_links", "component_id"), "classes")
    result = join_uneven(vectors.select(key, "cls"), full, "cls", "n").select(key, "n_links", "component_id").union(bad)
    return result.withColumn("kept", kept)
