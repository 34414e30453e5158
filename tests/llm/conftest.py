import pyarrow as pa
import pytest


@pytest.fixture(scope="session")
def brute_words():
    import re

    return re.compile(r"[^\x20\x09-\x0D]+").findall


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with new ones."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "a b"), (5, "a b"), (None, "x y z " * 40), (None, None), (6, long), (7, long), (8, "é ß 中 😀 's 'll <|endoftext|> x"), (9, "word " * 50)]
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, kept string, rank string, piece int")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def batch(*texts):
    return pa.array(texts, pa.string())
