import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) with extra columns whose names operators use inside."""

    def make(rows):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        clashing = ("kept", "keep_id", "node", "blob", "key", "size", "part", "row", "vector", "gone")
        return docs.select(
            "*",
            F.lit("en").alias("lang"),
            F.lit(None).cast("string").alias("source"),
            F.length("text").cast("bigint").alias("n_chars"),
            *[F.lit(n).alias(c) for n, c in enumerate(clashing)],
        )

    return make


ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "same words in this text and some more of them"),
    (5, "same words in this text and some more of them"),
    (5, "same words in this text and some more of them"),
    (6, "1234 5678"),
    (7, "x" * 70_000 + " end"),
    (8, "Grüße 🙂 漢字 <|endoftext|> naïve"),
    (None, "a row without an id"),
    (None, None),
]


@pytest.fixture
def odd_docs(make_docs):
    return make_docs(ODD)


@pytest.fixture
def no_docs(make_docs):
    return make_docs([])
