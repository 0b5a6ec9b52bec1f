"""Rows that every operator has to bear."""

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])


def odd_texts() -> list:
    """Null, empty, blank, very long, repeated and foreign texts."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta-7", "数据", "😀", "it's", "#tag"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    return [None, "", " \t\n\r\x0b\x0c ", "one", "one two three four", "x" * 50_000, long, long + " end", "a\x00b \x1f c\x85d e f", "Zeile\n\nZeile\r\nZeile\n", "ſecret=abcdef Kelvin K İ ß ﬁ", "<|endoftext|> <|startoftext|>", "same text here", "same text here"]


def frame(spark, texts, **columns):
    rows = [(k, t, "en", f"src{k % 3}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts, with a repeated row and rows without an id."""
    df = frame(spark, odd_texts())
    more = spark.createDataFrame([(3, "one", "en", "src0", 3), (None, "one", None, None, None), (None, None, None, None, None)], DOCUMENTS)
    return df.unionAll(more).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def documents(spark):
    """All documents at scale 0.001, as rows and as a frame."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def doubling(work, n, most=3.2, tries=4):
    """Whether twice the work takes about twice the time, in one of some tries;
    time that grows with the square takes four times as long in all of them."""
    import time

    for _ in range(tries):
        took = []
        for k in (n, 2 * n):
            began = time.process_time()
            work(k)
            took.append(time.process_time() - began)
        if took[1] <= most * took[0] + 0.02:
            return True
    return False
