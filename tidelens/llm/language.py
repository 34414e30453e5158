"""Language identification by Bayesian evidence fusion.

Text likelihoods come from byte trigram models fitted on a bounded sample of labelled rows. The other evidence is counted
over all rows by grouped aggregation of the languages that the text alone suggests: what a declared language says about the
real one, and how often each language occurs under an address suffix, a domain and a host, each smoothed towards the level
above. The posterior is their product; 'und' (text that no model explains) is one of the hypotheses.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, lowest, utf8, written

#: Different texts of each language in the training sample, and the least posterior that is accepted.
SAMPLE, LEAST = 400, 0.5
#: Trigrams count as at most so many independent ones; weight of the level above; smoothing of a declaration's counts.
INDEPENDENT, KAPPA, DECLARED = 60.0, 20.0, 1.0
#: Distinct hosts whose priors may be broadcast (about 100 bytes each), and texts of the sample (16 bytes each); more are
#: joined by an exchange.
BROADCAST_HOSTS = BROADCAST_SAMPLE = 100_000
UND = "und"
BUCKETS = 1 << 16

# Letters in lower case; every other ASCII byte counts as a blank.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def trigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket for each three bytes, and whether the middle one is a letter; two fewer than bytes."""
    f = _FOLD[raw]
    code = (f[:-2] << np.uint32(16)) | (f[1:-1] << np.uint32(8)) | f[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), f[1:-1] != 32


class TextModel:
    """log P(trigram | language) for each language and 'und', which expects all buckets alike."""

    def __init__(self, samples: dict[str, np.ndarray]):
        """samples: the counts of all buckets, by language."""
        self.languages = [*sorted(samples), UND]
        self.table = np.full((len(self.languages), BUCKETS), -np.log(BUCKETS), np.float32)
        for row, name in enumerate(self.languages[:-1]):
            self.table[row] = np.log((samples[name] + 0.02) / (samples[name].sum() + 0.02 * BUCKETS))

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods (rows by languages), tempered to INDEPENDENT trigrams, and the number of trigrams."""
        n = len(offsets) - 1
        if len(raw) < 3:
            return np.zeros((n, len(self.languages))), np.zeros(n)
        bucket, letter = trigrams(raw)
        first = np.minimum(offsets[:-1], len(bucket))
        last = np.maximum(np.minimum(offsets[1:] - 2, len(bucket)), first)
        total = lambda x: (s := np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))))[last] - s[first]
        count = total(letter)
        sums = np.stack([total(row[bucket] * letter) for row in self.table], axis=1)
        return sums * (np.minimum(INDEPENDENT, count) / np.maximum(count, 1))[:, None], count


def sampled(labelled: DataFrame, text: str, label: str, sample: int = SAMPLE) -> DataFrame:
    """l, h, t: of each label the `sample` different texts of lowest hash."""
    rows = labelled.where(F.col(label).isNotNull() & (F.col(label) != UND) & (F.length(text) > 2))
    rows = rows.select(F.col(label).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    # Equal texts have equal hashes: the hashes to take are found first, so that no text is carried through the ranking.
    hashes = written(lowest(rows, "l", "h", sample), "sample")
    hashes = F.broadcast(hashes) if hashes.count() <= BROADCAST_SAMPLE else hashes
    return rows.join(hashes, ["l", "h"]).groupBy("l", "h").agg(F.min("t").alias("t"))


def fit(labelled: DataFrame, text: str, label: str, sample: int = SAMPLE) -> TextModel:
    """Fits on the whole texts of sampled(); only the counts of buckets, 65,536 a label at most, reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column("t"))
            for i, l in enumerate(batch.column("l")):
                bucket, letter = trigrams(raw[offsets[i] : offsets[i + 1]])
                found, n = np.unique(bucket[letter], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([l.as_py()] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n)], names=["l", "b", "n"])

    chosen = written(sampled(labelled, text, label, sample), "sample")
    labels = sorted(r.l for r in chosen.select("l").distinct().collect())
    counts = chosen.select("l", "t").mapInArrow(run, "l string, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()
    row = {name: i for i, name in enumerate(labels)}
    table = np.zeros((len(labels), BUCKETS))
    table[[row[x] for x in counts.column("l").to_pylist()], np.asarray(counts.column("b"), np.int64)] = np.asarray(counts.column("n"), np.int64)
    samples = dict(zip(labels, table, strict=True))
    return TextModel(samples)


def host_parts(url: Column) -> tuple[Column, Column, Column]:
    """Address suffix, domain (last two labels) and host of a url; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#:]*)", 1))
    return F.regexp_extract(host, r"([^.]*)$", 1), F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1), host


def declared_in(html: Column) -> Column:
    """The primary subtag of the lang attribute of the html element, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1))
    return F.when(found != "", found)


def identify(rows: DataFrame, model: TextModel, text: Column, declared: Column, levels: list[Column], least: float = LEAST) -> DataFrame:
    """rows with language, posterior, text_language (by the text alone) and accepted.

    levels: from the widest to the narrowest, such as suffix, domain, host; null counts as an empty name. A row is
    accepted if its language is not 'und', its posterior is at least `least`, and its text has a trigram. Null or empty
    text is 'und', posterior 1, not accepted. A null declaration is no evidence. Ties go to the first language in
    alphabetical order. New columns take underscores on a clash; an empty table stays empty.
    """
    n, names = len(model.languages), model.languages
    helpers = [free_name(rows, c) for c in ("text__", "declared__", *[f"level{i}__" for i in range(len(levels))])]
    prior_ = free_name(rows, "prior__")
    base = rows.withColumns(dict(zip(helpers, [text.cast("string"), declared.cast("string"), *[F.coalesce(x.cast("string"), F.lit("")) for x in levels]], strict=True)))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(helpers[0]))
            found = np.full(batch.num_rows, n - 1)
            for a, b in chunks(offsets):
                score, count = model.scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found[a:b] = np.where(count > 0, score.argmax(axis=1), n - 1)
            yield pa.RecordBatch.from_arrays([*[batch.column(h) for h in helpers[1:]], pa.array(found.astype(np.int32))], names=[*helpers[1:], "found__"])

    kinds = ", ".join(f"{h} string" for h in helpers[1:])
    counted = base.select(*helpers).mapInArrow(best, f"{kinds}, found__ int").groupBy(*helpers[1:], "found__").agg(F.count("*").alias("c__"))
    counted = written(counted, "languages")
    counts = [F.sum(F.when(F.col("found__") == i, F.col("c__")).otherwise(0)).cast("double") for i in range(n)]
    # What a declaration says: P(declared | language), for the declarations that name one of the languages.
    said = np.zeros((n, n))
    for r in counted.where(F.col(helpers[1]).isin(names)).groupBy(helpers[1], "found__").agg(F.sum("c__").alias("c")).collect():
        said[names.index(r[0]), r[1]] = r.c
    said = np.log((said + DECLARED) / (said + DECLARED).sum(axis=0, keepdims=True))
    # Priors, each level smoothed towards the one above.
    top = counted.agg(F.array(*[F.coalesce(c, F.lit(0.0)) for c in counts]).alias("p")).head().p
    above = [(c + 1) / (sum(top) + n) for c in top]
    prior: DataFrame | None = None
    for i in range(len(levels)):
        own = counted.groupBy(*helpers[2 : 3 + i]).agg(F.array(*counts).alias("own__"))
        parent = F.array(*[F.lit(p) for p in above]) if prior is None else F.col(prior_)
        own = own if prior is None else own.join(prior, helpers[2 : 2 + i], "left")
        total = F.aggregate("own__", F.lit(0.0), lambda a, x: a + x)
        prior = own.select(*helpers[2 : 3 + i], F.zip_with("own__", parent, lambda c, p: (c + KAPPA * p) / (total + KAPPA)).alias(prior_))
    if prior is not None:
        prior = written(prior, "priors")
        small = prior.count() <= BROADCAST_HOSTS
        base = base.join(F.broadcast(prior) if small else prior, helpers[2:], "left")
    else:
        base = base.withColumn(prior_, F.array(*[F.lit(p) for p in above]))
    made = [free_name(rows, c) for c in ("language", "posterior", "text_language", "accepted")]
    types = [T.StringType(), T.DoubleType(), T.StringType(), T.BooleanType()]
    keep = rows.columns
    place = {k: i for i, k in enumerate(base.columns)}
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, k) for c, k in zip(made, types, strict=True))])

    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(place[helpers[0]]))
            row = {d: i for i, d in enumerate(names)}
            which = np.array([row.get(d, -1) for d in batch.column(place[helpers[1]]).to_pylist()], np.int64)
            priors = np.log(np.asarray(batch.column(place[prior_]).flatten(), np.float64).reshape(-1, n)) if batch.num_rows else np.zeros((0, n))
            score, count = np.zeros((batch.num_rows, n)), np.zeros(batch.num_rows)
            for a, b in chunks(offsets):
                score[a:b], count[a:b] = model.scores(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            alone = np.where(count > 0, score.argmax(axis=1), n - 1)
            score += priors + np.where(which[:, None] >= 0, said[which], 0.0)
            score -= score.max(axis=1, keepdims=True) if batch.num_rows else 0
            share = np.exp(score)
            share /= share.sum(axis=1, keepdims=True)
            most = np.where(count > 0, share.argmax(axis=1), n - 1)
            sure = np.where(count > 0, share[np.arange(len(most)), most], 1.0)
            good = (most != n - 1) & (sure >= least) & (count > 0)
            label = lambda at: pa.array([names[i] for i in at.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], label(most), pa.array(sure), label(alone), pa.array(good)], names=[*keep, *made])

    order = [*[f"{c}" for c in keep], *helpers, prior_]
    base = base.select(*[F.col(f"`{c}`") for c in order])
    place.update({k: i for i, k in enumerate(order)})
    return base.mapInArrow(fuse, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """Languages of documents: text, the declared column lang, and the source in place of a host.

    Nulls, empty and long texts, ties, repeated rows, an empty table and clashing names are as in identify().
    """
    model = fit(docs, "text", "lang")
    return identify(docs, model, F.col("text"), F.lower(F.col("lang")), [F.col("source")])


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Languages of web pages: visible text, markup language, and suffix, domain and host of the address.

    A null or unreadable url has empty levels, null html an empty text; the rest is as in identify(). The models are fitted
    on `labelled` (text, lang).
    """
    model = fit(labelled, "text", "lang")
    visible = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("html"), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"<[^>]*>|&\w+;", " ")
    return identify(pages, model, visible, declared_in(F.col("html")), list(host_parts(F.col("url"))))
