"""Connected components of a table of links, on executors only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that one task contracts at a time (about 100 bytes each while it does); more are contracted in parts.
TASK_LINKS = 1_000_000


def stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the vertices 0 to n-1 the smallest one that the links (a, b) lead to."""
    least = np.arange(n)
    while True:
        x, y = least[a], least[b]
        apart = x != y
        if not apart.any():
            return least
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != least[least]).any():
            least = least[least]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as stars: every id but the smallest of its component, and that smallest id; by TASK_LINKS at a time."""

    def star(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = pa.Table.from_batches(parts).combine_chunks()
        ids = pa.chunked_array([*links.column("a").chunks, *links.column("b").chunks]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(ids.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[ids.indices.to_numpy()]
        least = stars(at[: links.num_rows], at[links.num_rows :], len(order))
        names, rest = ids.dictionary.take(pa.array(order)), np.flatnonzero(least != np.arange(len(order)))
        for i in range(0, len(rest), 1 << 16):
            part = rest[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(part)), names.take(pa.array(least[part]))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= TASK_LINKS:
            yield from star(held)
            held = []
    if held:
        yield from star(held)


def components(edges: DataFrame) -> DataFrame:
    """From links (a, b) of any orderable type to (a, b): every linked id but a component's smallest, and that smallest id.

    Each task contracts its own links to stars. As soon as TASK_LINKS links at most are left, one task joins them; until
    then the large-star and small-star rewrites of Kiveris et al. alternate, each a grouped minimum, combined before its
    exchange, and a join with it. Every round is written to the shared folder.
    """
    pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
    edges = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    kind = edges.schema
    edges = written(edges.mapInArrow(_contracted, kind), "links")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now["n"] <= TASK_LINKS:
            return written(edges.coalesce(1).mapInArrow(_contracted, kind), "links")
        if now == before:
            return edges
        before = now
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").where("b <> m").select(*pair("b", "m")).union(own.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "links")
