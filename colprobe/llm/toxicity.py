"""Toxicity of texts by logistic regression, learned by FTRL-proximal steps."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import drawn, fold, id_type, short_batches, texts
from colprobe.session import stage

# Bounds of what the weights are learned from: labelled rows (expected number), and bytes
# of their features, as they meet in one task.
LABELLED_ROWS = 16_000
FEATURE_BYTES = 256 * 1024 * 1024
WIDTH = 1 << 20
EPOCHS = 4
# Steps: alpha / (beta + root of summed squared slopes) per coordinate.
ALPHA, BETA = 1.0, 1.0
L1, L2 = 4.0, 1.0
HELD_OUT = 2
THRESHOLD = 0.3
# Letters that inflected forms of a word are taken to share.
STEM = 4
REMEMBERED_WORDS = 500_000

_WORD = re.compile(r"\w+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(29))


class Grams:
    """Hashed words, word stems, pairs of neighbours and pairs that skip one word."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def _hashes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        known = self.known
        for word in set(words).difference(known):
            stem = word[:STEM]
            known[word] = (xxhash.xxh3_64_intdigest(word), xxhash.xxh3_64_intdigest(stem, 1))
        pairs = [known[w] for w in words]
        both = np.array(pairs, _U).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def of(self, text: str) -> np.ndarray:
        """The coordinates that a text has, each once, in order."""
        word, stem = self._hashes(_WORD.findall(text.lower()))
        turned = _mix(word)
        grams = [word, stem, _mix(turned[:-1] + word[1:]), _mix(turned[:-2] + _U(3) * word[2:])]
        return np.unique((np.concatenate(grams) >> _U(44)).astype(np.uint32))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights (of WIDTH coordinates, mostly zero) and bias, from rows in the given order.

    Each coordinate has a rate of its own, which falls with the slopes it has seen; the
    L1 term keeps at zero what has not been pulled one way often enough.
    """
    z, n = np.zeros(WIDTH), np.zeros(WIDTH)
    bias_z = bias_n = bias = 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        beyond = np.maximum(np.abs(z[at]) - L1, 0)
        return -np.sign(z[at]) * beyond / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for at, label in zip(rows, labels, strict=True):
            now = weights(at)
            slope = 1 / (1 + np.exp(-min(max(bias + now.sum(), -35.0), 35.0))) - label
            more = n[at] + slope * slope
            z[at] += slope - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * now
            n[at] = more
            more = bias_n + slope * slope
            bias_z += slope - (np.sqrt(more) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n = more
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    return weights(slice(None)), bias


@dataclass
class Model:
    """The coordinates whose weight is not zero, in order, their weights, and the bias."""

    at: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        full = np.zeros(WIDTH)
        full[self.at] = self.weights
        return full


def probability(table: np.ndarray, bias: float, coordinates: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-(bias + table[coordinates].sum()))))


def _measured(docs: DataFrame, labels: DataFrame, held_out_fold: int, rows: int) -> DataFrame:
    """(seed, toxic, grams): the features of the drawn labelled rows; staged."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & (fold(4) != held_out_fold)
    )
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    count = usable.count()
    chosen = usable.where(drawn(F.col("doc_id"), rows / max(count, 1)))
    known = texts(docs).join(F.broadcast(chosen), "doc_id")  # bounded by ``rows``
    known = known.select(F.xxhash64("doc_id", F.lit(1)).alias("seed"), "toxic", "text")
    short_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [grams.of(t).tobytes() for t in batch.column("text").to_pylist()]
            columns = [batch.column("seed"), batch.column("toxic"), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "toxic", "grams"])

    return stage(known.mapInArrow(measure, "seed bigint, toxic int, grams binary"), "toxic")


def learn(
    docs: DataFrame, labels: DataFrame, held_out_fold: int = HELD_OUT, rows: int = LABELLED_ROWS
) -> Model:
    """Weights from about ``rows`` labelled documents, drawn by a hash of their ids.

    Rows whose crc32 of the id modulo 4 is ``held_out_fold`` never take part, nor do
    labels other than 0 and 1. The drawn rows, their features bounded by FEATURE_BYTES,
    are learned from in one task, in an order that follows from their ids and features.
    Of several labels of an id the larger counts. Without usable labels the bias is 0
    and there are no weights, so every score is 0.5.
    """
    measured = _measured(docs, labels, held_out_fold, rows)
    size = measured.agg(F.sum(F.octet_length("grams"))).first()[0] or 0
    measured = measured.where(drawn(F.col("seed"), FEATURE_BYTES / max(size, 1)))

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seed", "toxic", "grams"])
        found = [np.frombuffer(g, np.uint32) for g in group["grams"]]
        weights, bias = fit(found, group["toxic"].to_numpy(float))
        at = np.flatnonzero(weights).astype(np.uint32)
        return pd.DataFrame({"at": [at.tobytes()], "weights": [weights[at].tobytes()], "bias": [bias]})

    whole = measured.withColumn("whole", F.lit(1)).groupBy("whole")
    found = whole.applyInPandas(grow, "at binary, weights binary, bias double").first()
    if found is None:
        return Model(np.zeros(0, np.uint32), np.zeros(0), 0.0)
    return Model(np.frombuffer(found["at"], np.uint32), np.frombuffer(found["weights"]), found["bias"])


def toxicity_scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the text alone.

    ``held_out`` tells whether crc32 of the id modulo 4 is 2; ``predicted`` is 1 at a
    score of 0.3 or more, that value included. A null text is scored as an empty one,
    which gets what the bias says. Very long texts are read whole; each coordinate
    counts once. A null id is not held out; repeated rows get a row each, with equal
    scores; an empty table gives no rows. Further columns of ``docs``, whatever their
    names, are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, table, bias = Grams(), shipped.value.table(), shipped.value.bias
        for batch in batches:
            found = [probability(table, bias, grams.of(t)) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id").cast(kind),
                batch.column("held_out"),
                pa.array(found, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    rows = texts(docs, _held_out()).select("doc_id", "held_out", "text")
    done = rows.mapInArrow(score, f"doc_id {id_type(docs)}, held_out boolean, score double")
    return done.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _held_out() -> Column:
    return F.coalesce(fold(4) == HELD_OUT, F.lit(False)).alias("held_out")
