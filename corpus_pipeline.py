"""A corpus pipeline: quality, exact copies, near copies, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colprobe.llm import exact_dedup, near_dedup, packing, pii, quality
from colprobe.session import new_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model accepts; learned from the labels of these documents.

    Null texts are scored as empty ones, long texts whole; repeated rows share their fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.accepted(docs, quality.learn(docs, labels))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts."""
    return exact_dedup.first_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates.

    Rows are told apart by id and text; those without an id or without a word stay.
    """
    return near_dedup.first_of_groups(docs)


def masked_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.masked(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left."""
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("quality", good_texts),
    ("exact_dedup", first_copies),
    ("near_dedup", one_of_similar),
    ("personal_data", masked_texts),
    ("packing", sequences),
]

# Neither the model nor the sketches can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
