"""URL filter: host and path rules, then the ratio of two character language models.

Both models are smoothed variable-order Markov models (Witten-Bell interpolation of orders 0 to ORDER), one of accepted
and one of rejected URLs. They are fitted on all different URLs that the rules judge but a fifth, which is held out; the rest
get the verdict of the mean log-likelihood difference per character, against a threshold calibrated on all that is held out.

The models are never in one place. Counts of a character and the five before it are dealt to shards by the two before it, so
that a shard has all longer contexts of these; only counts of single characters and of pairs go to all. URLs lie in blocks,
each of which asks the shards for what it needs, once for each different run of characters.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, mix, packed, run_starts, spread, tasks, unpacked, utf8, written

#: Longest context; bytes of URLs in a block, and how many times that its rows may have in all; bits of a character.
ORDER, BLOCK_BYTES, WHOLE, BITS = 5, 1 << 20, 16, 21

Rule = tuple[str, str, str]  # verdict, host, path


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty where the url is null or has no '://'."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (host + path as text) and its verdict; null where none fits. Equal lengths: allow first."""
    name = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if name is None else (name, verdict)


class Markov:
    """Counts of every context up to ORDER characters; ^ pads the start."""

    def __init__(self, urls: list[str], order: int = ORDER):
        self.order = order
        self.counts: dict[str, Counter[str]] = defaultdict(Counter)
        for url in urls:
            text = "^" * order + url + "\n"
            for i in range(order, len(text)):
                for k in range(order + 1):
                    self.counts[text[i - k : i]][text[i]] += 1
        self.counts = dict(self.counts)
        self.total = {c: sum(n.values()) for c, n in self.counts.items()}

    def probability(self, context: str, symbol: str) -> float:
        """Witten-Bell: each context mixes with its suffix by the number of different symbols seen after it."""
        p = 1 / 65536
        for k in range(len(context) + 1):
            seen = self.counts.get(context[len(context) - k :])
            if not seen:
                break
            n, kinds = self.total[context[len(context) - k :]], len(seen)
            p = (seen[symbol] + kinds * p) / (n + kinds)
        return p


class Ratio:
    """Mean difference per character of the log10 probabilities of accepted and rejected."""

    def __init__(self, accepted: list[str], rejected: list[str], order: int = ORDER):
        self.order, self.models, self.known = order, (Markov(accepted, order), Markov(rejected, order)), {}

    def score(self, url: str | None) -> float:
        if not url:
            return 0.0
        text, k, known, total = "^" * self.order + url + "\n", self.order, self.known, 0.0
        for i in range(k, len(text)):
            gram = text[i - k : i + 1]
            part = known.get(gram)
            if part is None:
                a, r = (m.probability(gram[:-1], gram[-1]) for m in self.models)
                part = math.log10(a / r)
                if len(known) < 1_000_000:
                    known[gram] = part
            total += part
        return total / (len(text) - k)


def cut(s: np.ndarray, good: np.ndarray, bad: np.ndarray, before: tuple[int, int], total: tuple[int, int], after: float) -> tuple[float, float]:
    """The best balanced accuracy of rejecting some of the lowest scores, and the middle between the scores around the cut.

    s: different scores, ascending; good, bad: how many accepted and rejected URLs have each; before: those of lower scores;
    after: the next score.
    """
    value = (1 - (before[0] + np.cumsum(good)) / total[0] + (before[1] + np.cumsum(bad)) / total[1]) / 2
    at = int(np.argmax(value))
    return float(value[at]), float((s[at] + np.append(s[1:], after)[at]) / 2)


def calibrate(scores: list[tuple[float, bool]]) -> float:
    """The threshold of best balanced accuracy; the middle between the scores around it. True: accepted."""
    good, bad = sum(y for _, y in scores), sum(not y for _, y in scores)
    if not good or not bad:
        return 0.0
    s, of = np.unique([x for x, _ in scores], return_inverse=True)
    y = np.array([y for _, y in scores])
    value, at = cut(s, np.bincount(of, y), np.bincount(of, ~y), (0, 0), (good, bad), s[-1] + 2e-9)
    return at if value > 0.5 else float(s[0] - 1e-9)


def threshold(scores: DataFrame) -> float:
    """calibrate() of a table: s, good and bad (how many accepted and rejected URLs have the score)."""
    counted = scores.groupBy("s").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    ordered = written(counted.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "scores")
    parts = ordered.groupBy("part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("s").alias("s"), F.max("s").alias("last")).orderBy("s").collect()
    total = sum(r.good for r in parts), sum(r.bad for r in parts)
    if not all(total):
        return 0.0
    known = {r.part: ((sum(x.good for x in parts[:i]), sum(x.bad for x in parts[:i])), parts[i + 1].s if i + 1 < len(parts) else r.last + 2e-9) for i, r in enumerate(parts)}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("s")
        before, after = known[key[0].as_py()]
        value, at = cut(*(np.asarray(rows.column(c)) for c in ("s", "good", "bad")), before, total, after)
        return pa.table({"value": [value], "at": [at]})

    best = ordered.groupBy("part").applyInArrow(run, "value double, at double").orderBy(F.desc("value"), "at").head()
    return best["at"] if best["value"] > 0.5 else parts[0].s - 1e-9


# --- models on shards ---------------------------------------------------------------------------

_ONE = (1 << BITS) - 1


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each character of each url, and its end, with the five before it: the first three and the last three of these six as
    a number each; and the number of them for each url."""
    flat = np.frombuffer("".join(["^" * ORDER + u + "\n" for u in urls]).encode("utf-32-le"), "<u4").astype(np.int64)
    size = np.array([len(u) + 1 for u in urls], np.int64)
    at = spread(np.cumsum(size + ORDER) - size - ORDER, size)
    three = (flat[:-2] << 2 * BITS | flat[1:-1] << BITS | flat[2:]) if len(flat) else flat
    return three[at], three[at + 3], size


def different(left: np.ndarray, right: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different pairs by shard, in an order that depends on them alone, the shard of each, and of each row its pair."""
    (a, lefts), (b, rights) = pd.factorize(left, sort=True), pd.factorize(right, sort=True)
    pair, which = np.unique(a * max(len(rights), 1) + b, return_inverse=True)
    left, right = lefts[pair // max(len(rights), 1)], rights[pair % max(len(rights), 1)]
    shard = (mix(right >> BITS) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return left[order], right[order], shard[order], place[which]


def mixed(p: np.ndarray, seen: np.ndarray, n: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Witten-Bell: a context mixes with its suffix (p) by the number of different symbols seen after it."""
    return np.where(n > 0, (seen + kinds * p) / np.maximum(n + kinds, 1), p)


@dataclass
class Short:
    """Counts of pairs of characters (sorted) in one class, from which the contexts of none and of one follow."""

    pair: np.ndarray
    n: np.ndarray

    def probability(self, right: np.ndarray) -> np.ndarray:
        symbol, p = right & _ONE, np.full(len(right), 1 / 65536)
        for names, found in ((self.pair & _ONE, symbol), (self.pair, right & (1 << 2 * BITS) - 1)):
            keys, of = np.unique(names, return_inverse=True)
            count = np.bincount(of, self.n, minlength=len(keys))
            contexts, own = np.unique(keys >> BITS, return_inverse=True)
            size, kinds = np.bincount(own, count), np.bincount(own, count > 0)
            at, up = np.minimum(np.searchsorted(keys, found), len(keys) - 1), np.minimum(np.searchsorted(contexts, found >> BITS), len(contexts) - 1)
            there = contexts[up] == found >> BITS
            p = mixed(p, np.where(keys[at] == found, count[at], 0), np.where(there, size[up], 0), kinds[up])
        return p


def shard_of(short: tuple[Short, Short]):
    """A shard's answers: of each run that a block asks for the log10 of the ratio of its probabilities."""

    def run(key: tuple, asked: pa.Table, counts: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"block": pa.array([], pa.int64()), "shard": pa.array([], pa.int32()), "payload": pa.array([], pa.binary())})
        parts = [unpacked(x.as_py()) for x in asked.column("payload")]
        known = counts.num_rows
        left, right = (np.concatenate([np.asarray(counts.column(c).combine_chunks(), np.int64), *[p[i] for p in parts]]) for i, c in enumerate(("l", "r")))
        seen = [np.concatenate((np.asarray(counts.column(c).combine_chunks(), np.float64), np.zeros(len(left) - known))) for c in ("allow", "block")]
        symbol, symbols = pd.factorize(right & _ONE)
        context, p = pd.factorize(right >> BITS)[0], [x.probability(right) for x in short]
        for more in (None, left & _ONE, left >> BITS & _ONE, left >> 2 * BITS):
            context = context if more is None else pd.factorize(context << BITS | more)[0]
            pair, pairs = pd.factorize(context * len(symbols) + symbol)
            for i, n in enumerate(seen):
                count = np.bincount(pair, n)
                p[i] = mixed(p[i], count[pair], np.bincount(context, n)[context], np.bincount(pairs // len(symbols), count > 0)[context])
        ratio, cuts = np.log10(p[0] / p[1])[known:], np.cumsum([0, *(len(x[0]) for x in parts)]).tolist()
        payload = [ratio[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"block": asked.column("block"), "shard": asked.column("shard"), "payload": pa.array(payload, pa.binary())})

    return run


def _stream(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _read(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_py()).read_all()


def url_blocks(rows: DataFrame, url: str) -> DataFrame:
    """rows as blocks, to be stored: block, urls, rows (as Arrow data)."""
    place = rows.columns.index(url)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            size = WHOLE * utf8(batch.column(place))[1]
            for column in batch.columns:
                if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                    size = size + utf8(column)[1]
            plain = pa.RecordBatch.from_arrays(batch.columns, names=names)
            for a, b in chunks(size, WHOLE * BLOCK_BYTES):
                own = plain.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([pa.array([_stream(own.select([names[place]]))], pa.binary()), pa.array([_stream(own)], pa.binary())], names=["urls", "rows"])

    return rows.mapInArrow(run, "urls binary, rows binary").select(F.monotonically_increasing_id().alias("block"), "*")


def scores(data: pa.Scalar, answers: pa.Table, shards: int) -> np.ndarray:
    """Mean difference per character of the urls of a block; 0 for null and empty ones."""
    urls = _read(data).column(0).to_pylist()
    some = np.array([bool(u) for u in urls], bool)
    left, right, size = grams([u for u in urls if u])
    out = np.zeros(len(urls))
    if some.any():
        which = different(left, right, shards)[3]
        part = np.concatenate([np.frombuffer(x.as_py()) for x in answers.sort_by("shard").column("payload")])
        out[some] = np.bincount(np.repeat(np.arange(len(size)), size), part[which]) / size
    return out


def judge(pages: DataFrame, rules: list[Rule], url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict (allow or block) and score (null where a rule judged).

    The models are fitted on all different URLs that rules judge; every fifth of them by hash is held out for calibration. If
    a class has no URL, the models say nothing and everything without a rule is allowed,
    as is an empty or null url. Equal URLs get equal verdicts, URLs may be of any length, an empty table stays empty. New columns take underscores on a clash.
    """
    shards = tasks(pages.sparkSession)
    names = [free_name(pages, n) for n in ("host", "path", "rule", "verdict", "score")]
    host, path = parts(F.col(url))
    base = pages.withColumns({names[0]: host, names[1]: path})
    rule, verdict = match(F.col(names[0]), F.col(names[1]), rules)
    base = base.withColumns({names[2]: rule, names[3]: verdict})
    judged, rest = base.where(F.col(names[3]).isNotNull()), base.where(F.col(names[3]).isNull())
    labelled = written(judged.select(F.col(url).alias("u"), (F.col(names[3]) == "allow").alias("good")).distinct(), "labelled")
    held = F.crc32(F.col("u").cast("binary")) % 5 == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in chunks(utf8(batch.column("u"))[1], BLOCK_BYTES):
                left, right, size = grams(batch.column("u").slice(a, b - a).to_pylist())
                left, right, shard, which = different(left, right, shards)
                y = np.repeat(good[a:b], size)
                n = [np.bincount(which, x, minlength=len(left)).astype(np.int64) for x in (y, ~y)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), *map(pa.array, (left, right, *n))], names=["shard", "l", "r", "allow", "block"])

    sums = (F.sum("allow").alias("allow"), F.sum("block").alias("block"))
    counts = labelled.where(~held).mapInArrow(count, "shard int, l long, r long, allow long, block long")
    counts = written(counts.groupBy("shard", "l", "r").agg(*sums), "counts")
    found = counts.groupBy(F.col("r").bitwiseAND((1 << 2 * BITS) - 1).alias("pair")).agg(*sums).toArrow().sort_by("pair")
    pair, *n = (np.asarray(found.column(c).combine_chunks(), np.int64) for c in ("pair", "allow", "block"))
    if not all(x.sum() for x in n):
        return judged.withColumn(names[4], F.lit(None).cast("double")).union(rest.withColumns({names[3]: F.lit("allow"), names[4]: F.lit(0.0)}))
    own = written(url_blocks(rest, url), "blocks")
    kept = written(url_blocks(labelled.where(held), "u").withColumn("block", -1 - F.col("block")), "blocks")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("urls"), strict=True):
                left, right, _ = grams([u for u in _read(data).column(0).to_pylist() if u])
                left, right, shard, _ = different(left, right, shards)
                at = run_starts(shard)
                payload = [packed(x, y) for x, y in zip(np.split(left, at[1:]), np.split(right, at[1:]), strict=True)] if len(at) else []
                yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array([block] * len(at), pa.int64()), pa.array(payload, pa.binary())], names=["shard", "block", "payload"])

    asked = own.select("block", "urls").union(kept.select("block", "urls")).mapInArrow(ask, "shard int, block long, payload binary")
    short = tuple(Short(pair, x) for x in n)
    answers = written(asked.groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(shard_of(short), "block long, shard int, payload binary"), "answers")

    def rate_held(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        good = _read(rows.column("rows")[0]).column(1).cast(pa.int64())
        return pa.table({"s": scores(rows.column("urls")[0], got, shards), "good": good, "bad": pa.array(1 - np.asarray(good))})

    least = threshold(kept.groupBy("block").cogroup(answers.where("block < 0").groupBy("block")).applyInArrow(rate_held, "s double, good long, bad long"))
    schema = T.StructType([*base.schema.fields, T.StructField(names[4], T.DoubleType())])
    at, place = base.columns.index(names[3]), base.columns.index(url)

    def rate(key: tuple, rows: pa.Table, got: pa.Table) -> pa.Table:
        every, score = _read(rows.column("rows")[0]), scores(rows.column("urls")[0], got, shards)
        none = [not u for u in every.column(place).to_pylist()]
        columns = every.columns
        columns[at] = pa.array(np.where(none | (score >= least), "allow", "block"), pa.string())
        return pa.table([*columns, pa.array(score)], names=schema.names)

    rated = own.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInArrow(rate, schema)
    return judged.withColumn(names[4], F.lit(None).cast("double")).union(rated)
