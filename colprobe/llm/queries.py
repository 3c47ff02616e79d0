"""The registered queries of this package, one per operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colprobe.llm import (
    ann,
    bpe,
    collocations,
    exact_dedup,
    language,
    merkle,
    near_dedup,
    packing,
    pii,
    quality,
    secrets,
    sharding,
    toxicity,
)
from colprobe.llm.common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
Query = Callable[[SparkSession, str], DataFrame]


def op1_family_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def op2_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return ann.search_index(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op5_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_spans(read(spark, sf_dir, "documents"))


def op6_patricia_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op7_transducer_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENIZER)


def op9_prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(read(spark, sf_dir, "documents"), 24)


def op10_additive_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def op11_setm_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op12_ftrl_proximal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def op13_recursive_climb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(read(spark, sf_dir, "documents"), merkle.without_newlines())


QUERIES: dict[str, Query] = {
    "op1_family_svm": op1_family_svm,
    "op2_multi_index": op2_multi_index,
    "op3_blob_ledger": op3_blob_ledger,
    "op4_bag_minhash": op4_bag_minhash,
    "op5_anchor_expansion": op5_anchor_expansion,
    "op6_patricia_owners": op6_patricia_owners,
    "op7_transducer_lexicon": op7_transducer_lexicon,
    "op8_best_fit_decreasing": op8_best_fit_decreasing,
    "op9_prefix_sums": op9_prefix_sums,
    "op10_additive_model": op10_additive_model,
    "op11_setm_phrases": op11_setm_phrases,
    "op12_ftrl_proximal": op12_ftrl_proximal,
    "op13_recursive_climb": op13_recursive_climb,
}
