"""Nearest neighbours by inner product through an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.llm.common import drawn
from colprobe.session import stage

# Rows, at about this number, that the codebooks are fitted on.
SAMPLE_ROWS = 20_000
# Queries, at about this number, whose exact neighbours set the depth of the search.
TRIAL_QUERIES = 64
# Share of those neighbours that the depth has to reach.
REACH = 0.98
LARGEST_BOOK = 256
ITERATIONS = 12
# Rows and queries that meet in one task.
ENTRY_BLOCK = 4096
QUERY_BLOCK = 4096


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(vec_id, vector as bytes of doubles) of the vectors that take part.

    Null and zero vectors, those with null, infinite or NaN components and those of
    another length than ``width``, by default that of most, take no part; nor do rows
    without an id.
    """
    value = F.col("embedding").cast("array<double>")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(value, lambda x: x != 0)
    rows = vectors.select("vec_id", value.alias("value")).where(
        F.col("vec_id").isNotNull() & finite & some
    )
    if width is None:
        widths = rows.groupBy(F.size("value").alias("width")).count()
        widest = widths.orderBy(F.desc("count"), "width").first()
        width = widest["width"] if widest else 0

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = [np.asarray(v, np.float64).tobytes() for v in batch["value"]]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": raw})

    return rows.where(F.size("value") == width).mapInPandas(packed, "vec_id bigint, vector binary")


def _matrix(raw: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(raw)).reshape(len(raw), -1)


def book_size(count: int) -> int:
    """Centroids per half: the cube root of the rows, so that cells hold few of them."""
    return int(min(LARGEST_BOOK, max(1, np.ceil(1.5 * count ** (1 / 3)))))


def centroids(points: np.ndarray, size: int) -> np.ndarray:
    """Lloyd's algorithm from evenly spread rows; empty clusters keep their centre."""
    start = np.unique(points, axis=0)
    centres = start[np.linspace(0, len(start) - 1, min(size, len(start))).astype(int)]
    for _ in range(ITERATIONS):
        own = nearest(points, centres)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def _halves(vectors: np.ndarray) -> list[np.ndarray]:
    cut = vectors.shape[1] // 2
    return [vectors[:, :cut], vectors[:, cut:]]


def fit_books(rows: DataFrame, count: int) -> list[np.ndarray]:
    """One codebook per half, each fitted in a task of its own on a bounded sample."""
    sample = rows.where(drawn(F.col("vec_id"), SAMPLE_ROWS / max(count, 1)))
    size = book_size(count)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(group.sort_values(["vec_id", "vector"])["vector"])
        half = int(group["half"].iloc[0])
        found = centroids(_halves(points)[half], size)
        return pd.DataFrame({"half": [half], "book": [found.tobytes()], "size": [len(found)]})

    both = sample.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1))))
    fitted = both.groupBy("half").applyInPandas(fit, "half int, book binary, size int")
    books = {r["half"]: np.frombuffer(r["book"]).reshape(r["size"], -1) for r in fitted.collect()}
    return [books[0], books[1]]


def visit(first: np.ndarray, second: np.ndarray, counts: np.ndarray, depth: int, least: int):
    """Cells (i, j) by falling ``first[i] + second[j]``, from a heap of their frontier.

    Yields cells that hold rows until those before hold ``depth`` rows and at least
    ``least``.
    """
    by_first, by_second = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b = first[by_first].tolist(), second[by_second].tolist()
    by_first, by_second = by_first.tolist(), by_second.tolist()
    size = counts.tolist()
    heap, met = [(-(a[0] + b[0]), 0, 0)], 0
    while heap and (met <= depth or met < least):
        _, i, j = heapq.heappop(heap)
        # each cell is pushed once: along a row from its left, along column 0 from above
        if j + 1 < len(b):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-(a[i + 1] + b[0]), i + 1, 0))
        held = size[by_first[i]][by_second[j]]
        if held:
            yield by_first[i], by_second[j]
            met += held


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k ids of largest score, ties to smaller ids; -inf does not count.

    An id that occurs several times counts once, with its largest score.
    """
    every, wanted = np.flatnonzero(scores > -np.inf), k
    while True:
        place = every
        if len(every) > wanted:
            limit = np.partition(scores[every], len(every) - wanted)[len(every) - wanted]
            place = every[scores[every] >= limit]
        place = place[np.lexsort((ids[place], -scores[place]))]
        first = np.unique(ids[place], return_index=True)[1]
        if len(first) >= k or len(place) == len(every):
            return place[np.sort(first)][:k]
        wanted *= 2


def exact(rows: DataFrame, asked: pd.DataFrame, k: int, columns: list[str]) -> DataFrame:
    """Best k rows of every partition batch for a few queries; brute force."""
    shipped = rows.sparkSession.sparkContext.broadcast(
        (asked["vec_id"].to_numpy(), _matrix(asked["vector"]))
    )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, vectors = shipped.value
        for batch in batches:
            scores = vectors @ _matrix(batch["vector"]).T
            ids = batch["vec_id"].to_numpy()
            for query, row in zip(own, scores, strict=True):
                place = _best(np.where(ids == query, -np.inf, row), ids, k)
                found = batch[columns].iloc[place]
                yield found.assign(query_id=query, score=row[place])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", query_id bigint, score double"
    return top(rows.mapInPandas(search, schema), k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best ids of each query, each with its best row."""
    more = [c for c in found.columns if c not in ("query_id", "vec_id", "score")]
    best = F.max(F.struct("score", *more)).alias("best")
    found = found.groupBy("query_id", "vec_id").agg(best).select("query_id", "vec_id", "best.*")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def once(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Repeated rows reduced to one, staged, and the most rows that an id then has."""

    def most(rows: DataFrame) -> int:
        return rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0

    rows = stage(rows, name)
    if most(rows) > 1:  # only then do the vectors travel
        rows = stage(rows.distinct(), name)
    return rows, most(rows)


def search_index(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for each query.

    Both frames have (vec_id, embedding). Each half of a vector is quantised by its own
    codebook; a pair of centroids is a cell. A query visits cells by falling sum of the
    inner products of its halves with the centroids until the cells hold as many rows as
    the depth asks, and at least k other ids, so only a table with fewer gives fewer. The
    depth is what reaches nearly all exact neighbours of a bounded draw of the queries.
    Rows of visited cells are scored exactly, those of one first centroid together, in
    blocks of bounded size. Ties go to the smaller id; a query's own id is no candidate;
    what ``usable`` leaves out takes no part; empty tables give no rows.

    Repeated rows, of queries or of vectors, count once: every query id has one list of
    up to k different ids. Where an id has several different vectors, all of them ask or
    are candidates, and the score of two ids is the largest of their vectors.
    """
    spark = vectors.sparkSession
    nothing = "query_id bigint, rank int, vec_id bigint, score double"
    rows, most = once(usable(vectors), "vectors")
    some = rows.first()
    if some is None:
        return spark.createDataFrame([], nothing)
    asked, _ = once(usable(queries, len(some["vector"]) // 8), "queries")
    least = (k + 1) * most  # so many rows hold k ids besides the query's own
    count, wanted = rows.count(), asked.count()
    if not wanted:
        return spark.createDataFrame([], nothing)
    books = fit_books(rows, count)
    shipped = spark.sparkContext.broadcast(books)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = [
                nearest(half, book)
                for half, book in zip(_halves(_matrix(batch["vector"])), shipped.value, strict=True)
            ]
            yield batch.assign(first=cells[0], second=cells[1])

    index = rows.mapInPandas(assign, "vec_id bigint, vector binary, first int, second int")
    index = stage(index, "index")
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    for r in index.groupBy("first", "second").count().collect():  # at most one row per cell
        counts[r["first"], r["second"]] = r["count"]

    depth = _depth(index, asked, books, counts, wanted, k)
    sizes = spark.sparkContext.broadcast(counts)

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, counts = shipped.value, sizes.value
        for batch in batches:
            halves = _halves(_matrix(batch["vector"]))
            sums = [half @ book.T for half, book in zip(halves, books, strict=True)]
            for n, (query, vector) in enumerate(zip(batch["vec_id"], batch["vector"], strict=True)):
                cells: dict[int, list[int]] = {}
                for i, j in visit(sums[0][n], sums[1][n], counts, depth, least):
                    cells.setdefault(i, []).append(j)
                yield pd.DataFrame(
                    {
                        "query_id": query,
                        "query": [vector] * len(cells),
                        "first": list(cells),
                        "cells": list(cells.values()),
                    }
                )

    probes = asked.mapInPandas(probe, "query_id bigint, query binary, first int, cells array<int>")
    # blocks per first centroid, at most one row per centroid
    held = counts.sum(1)
    blocks = F.array(*[F.lit(int(n // ENTRY_BLOCK + 1)) for n in held])[F.col("first")]
    query_blocks = wanted // QUERY_BLOCK + 1
    keys = ["first", "entry_block", "query_block"]
    probes = probes.withColumn(
        "query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))
    ).withColumn("entry_block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    entries = index.withColumn(
        "entry_block", F.pmod(F.xxhash64("vec_id", "vector"), blocks).cast("int")
    ).withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1))))

    def rerank(own: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(found):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        found = found.sort_values("second", kind="stable")
        ids, cell = found["vec_id"].to_numpy(), found["second"].to_numpy()
        entries = _matrix(found["vector"])
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        spans = {c: (a, b) for c, a, b in zip(cell[starts], starts, [*starts[1:], len(cell)], strict=True)}
        out = []
        for at in range(0, len(own), 256):
            part = own.iloc[at : at + 256]
            vectors = _matrix(part["query"])
            visitors: dict[int, list[int]] = {}
            for n, cells in enumerate(part["cells"]):
                for c in cells:
                    visitors.setdefault(c, []).append(n)
            scores = np.full((len(part), len(ids)), -np.inf)
            for c, who in visitors.items():
                if c in spans:
                    a, b = spans[c]
                    scores[who, a:b] = vectors[who] @ entries[a:b].T
            for query, row in zip(part["query_id"].to_numpy(), scores, strict=True):
                row[ids == query] = -np.inf
                place = _best(row, ids, k)
                out.append(pd.DataFrame({"query_id": query, "vec_id": ids[place], "score": row[place]}))
        return pd.concat(out)

    scored = probes.groupBy(*keys).cogroup(entries.groupBy(*keys))
    found = scored.applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    return top(found, k).select("query_id", "rank", "vec_id", "score")


def _depth(
    index: DataFrame,
    asked: DataFrame,
    books: list[np.ndarray],
    counts: np.ndarray,
    wanted: int,
    k: int,
) -> int:
    """Rows that a search has to meet to reach nearly all exact neighbours of the trials."""
    some = asked.where(drawn(F.col("vec_id"), 2 * TRIAL_QUERIES / wanted))
    trials = some.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIAL_QUERIES).toPandas()
    trials = trials.drop_duplicates("vec_id", ignore_index=True)
    if not len(trials):
        return int(counts.sum())
    truth = exact(index, trials, k, ["vec_id", "first", "second"]).collect()
    vectors = _matrix(trials["vector"])
    sums = [half @ book.T for half, book in zip(_halves(vectors), books, strict=True)]
    place = {query: n for n, query in enumerate(trials["vec_id"])}
    ahead = []
    for query, n in place.items():
        total = (sums[0][n][:, None] + sums[1][n]).ravel()
        order = np.argsort(-total, kind="stable")
        before = np.empty(len(order), np.int64)
        before[order] = np.cumsum(counts.ravel()[order]) - counts.ravel()[order]
        before = before.reshape(counts.shape)
        ahead += [int(before[r["first"], r["second"]]) for r in truth if r["query_id"] == query]
    return int(np.quantile(ahead, REACH, method="higher")) if ahead else int(counts.sum())
