import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from colprobe.llm import toxicity
from colprobe.llm.common import draw_limit, drawn

SF_DIR = "/root/testdata/sf0.1"


def plain_mix(x):
    x = (x ^ (x >> 31)) * 0x9E3779B97F4A7C15 % 2**64
    return x ^ (x >> 29)


def plain_coordinates(text):
    """Words, stems, pairs and pairs over one word, one at a time."""
    words = re.findall(r"\w+", text.lower())
    word = [xxhash.xxh3_64_intdigest(w) for w in words]
    found = word + [xxhash.xxh3_64_intdigest(w[:4], 1) for w in words]
    found += [plain_mix((plain_mix(a) + b) % 2**64) for a, b in zip(word, word[1:], strict=False)]
    found += [plain_mix((plain_mix(a) + 3 * b) % 2**64) for a, b in zip(word, word[2:], strict=False)]
    return sorted({f >> 44 for f in found})


def plain_fit(rows, labels):
    """The steps, coordinate by coordinate."""
    z, n = {}, {}

    def weight(i, l1, l2):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * l1) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + l2)

    for _ in range(toxicity.EPOCHS):
        for row, label in zip(rows, labels, strict=True):
            now = {i: weight(i, toxicity.L1, toxicity.L2) for i in row} | {-1: weight(-1, 0, 0)}
            slope = 1 / (1 + math.exp(-sum(now.values()))) - label
            for i, w in now.items():
                old = n.get(i, 0.0)
                n[i] = old + slope**2
                z[i] = z.get(i, 0.0) + slope - (math.sqrt(n[i]) - math.sqrt(old)) / toxicity.ALPHA * w
    return {i: w for i in z if i >= 0 and (w := weight(i, toxicity.L1, toxicity.L2))}, weight(-1, 0, 0)


def test_coordinates_are_those_of_single_grams():
    grams = toxicity.Grams()
    for text in ("", "One", "Two words", "the cat, the CAT sat. The cat", "Ünï_cödé 漢字 x1"):
        assert grams.of(text).tolist() == plain_coordinates(text)


def test_fit_is_that_of_single_steps():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60, rng.integers(0, 25))).astype(np.uint32) for _ in range(400)]
    labels = np.array([float(7 in r or (3 in r and 5 in r)) for r in rows])
    weights, bias = toxicity.fit(rows, labels)
    expected, expected_bias = plain_fit([r.tolist() for r in rows], labels)
    assert bias == pytest.approx(expected_bias)
    assert {int(i): pytest.approx(weights[i]) for i in np.flatnonzero(weights)} == expected
    assert 0 < len(expected) < 60  # some coordinates stay at zero


def test_scores_are_those_of_single_texts(spark):
    """Scoring in tasks next to one text at a time, and held-out rows told apart."""
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 600")
    model = toxicity.learn(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.toxicity_scores(docs, model).collect()}
    table = dict(zip(model.at.tolist(), model.weights.tolist(), strict=True))
    assert len(found) == docs.count() and table
    for r in docs.collect():
        total = model.bias + sum(table.get(i, 0.0) for i in plain_coordinates(r["text"] or ""))
        own = found[r["doc_id"]]
        assert own["score"] == pytest.approx(1 / (1 + math.exp(-total)))
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert own["predicted"] == (own["score"] >= 0.3)


def test_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity_scores(docs, toxicity.learn(docs, labels))
    judged = found.join(labels, "doc_id").where("held_out AND toxic IS NOT NULL")
    judged = judged.join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (judged["predicted"] == judged["toxic"]).mean() >= 0.97
    assert judged[judged["toxic"] == 0]["predicted"].mean() <= 0.015
    assert judged[(judged["toxic"] == 1) & (judged["lang"] == "en")]["predicted"].mean() >= 0.9


def test_held_out_labels_are_not_learned(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 400")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, other = toxicity.learn(docs, labels), toxicity.learn(docs, turned)
    assert one.bias == other.bias and (one.weights == other.weights).all()


def test_bytes_of_features_are_bounded(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.where("doc_id < 800")
    monkeypatch.setattr(toxicity, "FEATURE_BYTES", 100_000)
    seen = []
    real = toxicity.drawn
    monkeypatch.setattr(toxicity, "drawn", lambda key, share: seen.append(share) or real(key, share))
    toxicity.learn(docs, labels)
    assert seen[0] >= 1 and 0 < seen[1] < 1


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame(
        [(4, 1, 1), (5, 1, 1), (5, 1, 0), (6, 0, 0), (7, None, None), (None, 1, 1), (99, 1, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    model = toxicity.learn(odd_docs, labels)
    rows = toxicity.toxicity_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (4, 5)}) == 1
    assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.toxicity_scores(no_docs, model).count() == 0
    nothing = toxicity.learn(no_docs, labels.limit(0))
    assert {r["score"] for r in toxicity.toxicity_scores(odd_docs, nothing).collect()} == {0.5}


def test_draws_hold_at_any_size(spark):
    """The share is followed where a step of one millionth would draw nothing."""
    ids = spark.range(2_000_000)
    for share in (0.5, 1e-3):
        assert abs(ids.where(drawn(F.col("id"), share)).count() / (2e6 * share) - 1) < 0.1
    for count in (10**9, 10**10, 10**11, 10**12):
        assert draw_limit(12_000 / count) / 2**63 * count == pytest.approx(12_000, rel=1e-6)
    assert ids.where(drawn(F.col("id"), 1.0)).count() == 2_000_000
