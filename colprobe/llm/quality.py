"""Quality of texts by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.llm.common import drawn, fold, id_type, short_batches, texts

# Bound of the labelled rows that the model is fitted on (expected number).
LABELLED_ROWS = 12_000
BINS = 32
COARSE = 8
ROUNDS = 150
PAIRS = 12
PAIR_ROUNDS = 60
RATE = 0.15
LEAF_WEIGHT = 2.0

_SYMBOLS = b"#$%&*@^~<>{}[]\\/=+_`"
FEATURES = (
    "log_bytes",
    "word_length",
    "longest_word",
    "short_words",
    "upper",
    "digits",
    "white",
    "stops",
    "shouts",
    "bars",
    "symbols",
    "non_ascii",
    "entropy",
    "line_words",
    "repeated_lines",
    "repeated_words",
    "distinct_words",
    "top_word",
    "title_words",
    "word_ends",
)


def _class(chars: bytes) -> np.ndarray:
    found = np.zeros(256)
    found[list(chars)] = 1
    return found


_CLASSES = np.stack(
    [
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(b" \t\n\r\x0b\x0c"),
        _class(b".,;:?"),
        _class(b"!"),
        _class(b"|"),
        _class(_SYMBOLS),
        _class(bytes(range(128, 256))),
    ],
    axis=1,
)
_WORD_END = re.compile(r"[^\w\s]+(?=\s|$)")


def features(text: str) -> list[float]:
    """The measures named in FEATURES, over the whole text."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size = len(raw)
    shares = (counts @ _CLASSES) / max(size, 1)
    some = counts[counts > 0] / max(size, 1)
    words = text.split()
    n = len(words)
    lines = text.split("\n")
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        of: dict[str, int] = {}
        for word in words:
            of[word] = of.get(word, 0) + 1
        same = sum(a == b for a, b in zip(words, words[1:], strict=False))
        by_word = [
            float(lengths.mean()),
            float(np.log1p(lengths.max())),
            float((lengths <= 3).mean()),
        ]
        repeats = [same / n, len(of) / n, max(of.values()) / n, sum(map(str.istitle, of)) / len(of)]
        ends = len(_WORD_END.findall(text)) / n
    else:
        by_word, repeats, ends = [0.0] * 3, [0.0] * 4, 0.0
    return [
        float(np.log1p(size)),
        *by_word,
        *shares.tolist(),
        float(-(some * np.log2(some)).sum()),
        float(np.log1p(n / len(lines))),
        1 - len(set(lines)) / len(lines),
        *repeats,
        ends,
    ]


def _cut(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gain, left value and right value of every cut along the last axis."""
    g, h = gradient.cumsum(-1), weight.cumsum(-1)
    total_g, total_h = g[..., -1:], h[..., -1:]
    left_g, left_h = g[..., :-1], h[..., :-1]
    right_g, right_h = total_g - left_g, total_h - left_h
    fair = (left_h > 1e-3) & (right_h > 1e-3)
    gain = np.where(
        fair,
        left_g**2 / (left_h + LEAF_WEIGHT)
        + right_g**2 / (right_h + LEAF_WEIGHT)
        - total_g**2 / (total_h + LEAF_WEIGHT),
        -np.inf,
    )
    return gain, left_g / (left_h + LEAF_WEIGHT), right_g / (right_h + LEAF_WEIGHT)


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values per bin of a tree with up to four leaves along one feature."""
    gain, left, right = _cut(gradient, weight)
    at = int(gain.argmax())
    values = np.zeros(len(gradient))
    if not gain[at] > 0:
        return values
    for part, value in ((slice(0, at + 1), left[at]), (slice(at + 1, None), right[at])):
        values[part] = value
        if len(gradient[part]) > 1:
            below, a, b = _cut(gradient[part], weight[part])
            again = int(below.argmax())
            if below[again] > 0:
                inner = values[part]
                inner[: again + 1], inner[again + 1 :] = a[again], b[again]
    return values


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best tree that cuts rows once and each part's columns once."""
    g, h = gradient.cumsum(0), weight.cumsum(0)
    best, values = 0.0, np.zeros_like(gradient)
    parts = [_cut(g[:-1], h[:-1]), _cut(g[-1] - g[:-1], h[-1] - h[:-1])]
    row_gain, _, _ = _cut(gradient.sum(1), weight.sum(1))
    column = [p[0].argmax(-1) for p in parts]
    gain = row_gain + sum(
        np.maximum(p[0].max(-1), 0) for p in parts
    )
    row = int(gain.argmax())
    if gain[row] > 0:
        best = float(gain[row])
        for part, cut, rows in zip(parts, column, (slice(0, row + 1), slice(row + 1, None)), strict=True):
            at = cut[row]
            if part[0][row, at] > 0:
                values[rows, : at + 1] = part[1][row, at]
                values[rows, at + 1 :] = part[2][row, at]
            else:
                total_g, total_h = gradient[rows].sum(), weight[rows].sum()
                values[rows] = total_g / (total_h + LEAF_WEIGHT)
    return best, values


def fit(values: np.ndarray, labels: np.ndarray) -> dict:
    """Tables of the model from rows of FEATURES and labels 0 or 1.

    One shallow tree per feature and round, feature after feature, adds to the feature's
    table; then the pairs that explain most of what is left are boosted the same way.
    """
    n, width = values.shape
    if n == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if n else 0.5
        share = min(max(share, 0.01), 0.99)
        return {"base": float(np.log(share / (1 - share))), "edges": [], "tables": [], "pairs": []}
    edges = [
        np.unique(np.quantile(values[:, f], np.arange(1, BINS) / BINS, method="nearest"))
        for f in range(width)
    ]
    bins = np.stack([np.searchsorted(e, values[:, f], "left") for f, e in enumerate(edges)], 1)
    coarse = bins * COARSE // BINS
    base = float(np.log(labels.mean() / (1 - labels.mean())))
    tables = [np.zeros(BINS) for _ in edges]
    score = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-score))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(width):
            gradient, weight = slopes()
            own = bins[:, f]
            step = RATE * _tree(
                np.bincount(own, gradient, BINS), np.bincount(own, weight, BINS)
            )
            tables[f] += step
            score += step[own]

    def grid(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cell = coarse[:, a] * COARSE + coarse[:, b]
        gradient, weight = slopes()
        shape = (COARSE, COARSE)
        size = COARSE * COARSE
        return (
            cell,
            np.bincount(cell, gradient, size).reshape(shape),
            np.bincount(cell, weight, size).reshape(shape),
        )

    gains = [
        (_pair_tree(*grid(a, b)[1:])[0], a, b) for a in range(width) for b in range(width) if a != b
    ]
    pairs = []
    for gain, a, b in sorted(gains, reverse=True):
        if len(pairs) < PAIRS and gain > 0 and (b, a) not in [p[:2] for p in pairs]:
            pairs.append((a, b, np.zeros((COARSE, COARSE))))
    for _ in range(PAIR_ROUNDS):
        for a, b, table in pairs:
            cell, gradient, weight = grid(a, b)
            step = RATE * _pair_tree(gradient, weight)[1]
            table += step
            score += step.ravel()[cell]
    return {"base": base, "edges": edges, "tables": tables, "pairs": pairs}


def scored(model: dict, values: np.ndarray) -> np.ndarray:
    """Probability of label 1: bins looked up and added."""
    score = np.full(len(values), model["base"])
    if model["edges"] and len(values):
        bins = np.stack(
            [np.searchsorted(e, values[:, f], "left") for f, e in enumerate(model["edges"])], 1
        )
        coarse = bins * COARSE // BINS
        for f, table in enumerate(model["tables"]):
            score += table[bins[:, f]]
        for a, b, table in model["pairs"]:
            score += table[coarse[:, a], coarse[:, b]]
    return 1 / (1 + np.exp(-score))


def learn(docs: DataFrame, labels: DataFrame, held_out_fold: int = 1, rows: int = LABELLED_ROWS) -> dict:
    """Fit on at most about ``rows`` labelled documents, drawn by a hash of their ids.

    Rows whose crc32 of the id modulo 3 is ``held_out_fold`` never take part. The model
    grows in one task, whose input the bound keeps small.
    """
    usable = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(
        F.col("quality").isin(0, 1) & (fold(3) != held_out_fold)
    )
    count = usable.count()
    chosen = usable.where(drawn(F.col("doc_id"), rows / max(count, 1)))
    # one label per document, and no more rows than asked for
    chosen = chosen.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = texts(docs).join(F.broadcast(chosen), "doc_id").select("text", "quality")
    short_batches(docs.sparkSession)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, pa.list_(pa.float64())), batch.column("quality")],
                names=["value", "quality"],
            )

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        # the order of arrival depends on the cluster, the model must not
        rows = sorted(zip(group["value"].map(tuple), group["quality"], strict=True))
        values = np.array([v for v, _ in rows])
        model = fit(values, np.array([q for _, q in rows], float))
        return pd.DataFrame({"model": [pickle.dumps(model)]})

    measured = known.mapInArrow(measure, "value array<double>, quality int")
    whole = measured.withColumn("whole", F.lit(1)).groupBy("whole")
    found = whole.applyInPandas(grow, "model binary").first()
    if found is None:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    return pickle.loads(found["model"])


def quality_scores(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row.

    ``held_out`` tells whether crc32 of the id modulo 3 is 1. A null text is scored as an
    empty one; a null id is not held out; repeated rows get a row each; an empty table
    gives no rows. Without usable labels every score is 0.5.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    short_batches(docs.sparkSession)
    kind = to_arrow_type(docs.schema["doc_id"].dataType)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t) for t in batch.column("text").to_pylist()]
            found = scored(shipped.value, np.array(values).reshape(-1, len(FEATURES)))
            columns = [batch.column("doc_id").cast(kind), batch.column("held_out"), pa.array(found)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "score"])

    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    rows = texts(docs, held).select("doc_id", "held_out", "text")
    done = rows.mapInArrow(score, f"doc_id {id_type(docs)}, held_out boolean, score double")
    return done.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns; no shuffle.

    A null text is scored as an empty one.
    """
    short_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [features(t or "") for t in batch.column("text").to_pylist()]
            found = scored(shipped.value, np.array(values).reshape(-1, len(FEATURES)))
            yield batch.filter(pa.array(found >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
