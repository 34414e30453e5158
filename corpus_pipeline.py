"""A training corpus from raw documents: language identification, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run()
writes each stage's result as Parquet below the shared folder and hands what it reads back to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens.llm import language, neardup, packing, substrings
from tidelens.llm.common import free_name, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language is not one that the labels name, or is not sure; the label becomes the language found.

    So null and empty texts go. A null lang or source is no evidence; repeated rows share their fate; texts may be of any
    length; further columns pass unchanged, whatever their names; an empty table stays empty.
    """
    accepted, found = free_name(docs, "accepted"), free_name(docs, "language")
    return language.identify_documents(docs).where(F.col(accepted)).withColumn("lang", F.col(found)).select(*docs.columns)


def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest doc_id.

    Documents without words and those of a null doc_id stay; repeated rows leave one; texts may be of any length; further
    columns pass unchanged, whatever their names; an empty table stays empty.
    """
    return neardup.one_of_each(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring passages out of the texts; a document of which nothing is left goes, so null and empty texts do.

    Repeated rows lose all passages that they share. Texts may be of any length; n_chars becomes that of what is left;
    further columns pass unchanged, whatever their names; an empty table stays empty.
    """
    n_words, n_removed = free_name(docs, "n_words"), free_name(docs, "n_removed")
    left = substrings.remove_repeats(docs).where(F.col(n_words) > F.col(n_removed))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' token pieces in sequences of 1024.

    Null texts are empty and have one token; long ones are cut; repeated rows and null doc_ids have their places; only
    doc_id and text are looked at; an empty table has no places.
    """
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [(f.__name__, f) for f in (language_id, minhash_neardup, substring_dedup, best_fit_packing)]

#: SQL expresses none of the four methods; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
