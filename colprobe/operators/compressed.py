"""Approximate nearest vectors through an inverted file of compressed codes.

A vector is stored as its list and, for each part of its dimensions, the number of the
nearest of 256 values of what the list's centre leaves (the residual): one byte a part. A
query is compared with codes through one small table of its own, and only a short list
of the best is compared with the vectors themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.operators import neighbours
from colprobe.operators.neighbours import _distances, _lists_ahead, _matrix, _ranked, _result
from colprobe.session import stage

# Dimensions behind one byte of a code, and residuals that its values are fitted on.
WIDTH = 4
SAMPLE_ROWS = 20_000
VALUES = 256
ITERATIONS = 15
# Queries that share a block, codes that meet them in one task, and codes at a time.
QUERY_BLOCK = 4096
PART_ROWS = 1_000_000
CODES_AT_ONCE = 8192
# Codes of which the limit of a query's short list is foreseen, short rows in memory, and
# vectors that meet the pairs of a block of queries in one task.
FORESEEN = 16_384
SHORT_AT_ONCE = 4_000_000
VECTOR_ROWS = 100_000


class Codebook:
    """Values of each part of a residual, and the arithmetic on codes."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0, *[b.shape[1] for b in books]])

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        return [vectors[:, a:b] for a, b in zip(self.cuts, self.cuts[1:], strict=False)]

    def encode(self, vectors: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the part of the distance that does not depend on the query."""
        residual = vectors - self.centres[lists]
        codes = [_distances(p, b).argmin(axis=1) for p, b in zip(self.parts(residual), self.books, strict=True)]
        codes = np.stack(codes, axis=1).astype(np.uint8)
        return codes, (self.rebuilt(codes, lists) ** 2).sum(axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.hstack([b[codes[:, n]] for n, b in enumerate(self.books)])

    def tables(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with the values of each part, and with the centres."""
        products = [p @ b.T for p, b in zip(self.parts(queries), self.books, strict=True)]
        width = max(p.shape[1] for p in products)
        padded = [np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in products]
        return np.stack(padded, axis=1), queries @ self.centres.T

    def rebuilt(self, codes: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for; products with them are cheaper than many tables."""
        return self.centres[lists] + self.decode(codes)

    def near(self, tables, codes: np.ndarray, lists: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """Distances of queries to codes, less the queries' own squares."""
        products, centres = tables
        total = centres[:, lists]
        for n in range(codes.shape[1]):
            total = total + products[:, n, :][:, codes[:, n]]
        return offset - 2.0 * total


def _lloyd(points: np.ndarray, size: int) -> np.ndarray:
    start = np.unique(points, axis=0)  # in order, whatever that of arrival
    points = points[np.lexsort(points.T)]
    centres = start[np.linspace(0, len(start) - 1, min(size, len(start))).astype(int)]
    for _ in range(ITERATIONS):
        own = _distances(points, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def fit_codebook(listed: DataFrame, centres: np.ndarray, count: int, seed: int) -> Codebook:
    """Values of every part, each fitted in a task of its own on a bounded sample.

    ``listed`` has (id, vector, list).
    """
    width = centres.shape[1]
    cuts = list(range(0, width, WIDTH)) + [width]
    share = min(1.0, SAMPLE_ROWS / count)
    sample = listed if share >= 1 else listed.sample(share, seed)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            residual = _matrix(batch["vector"]) - centres[batch["list"].to_numpy()]
            for part, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                yield pd.DataFrame({"part": part, "values": residual[:, a:b].tolist()})

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        points = _matrix(group["values"])
        part = int(group["part"].iloc[0])
        return pd.DataFrame({"part": [part], "book": [_lloyd(points, VALUES).ravel().tolist()]})

    values = sample.select("vector", "list").mapInPandas(cut, "part int, values array<double>")
    fitted = values.groupBy("part").applyInPandas(fit, "part int, book array<double>")
    found = {r["part"]: np.array(r["book"]) for r in fitted.collect()}  # one row per part
    return Codebook(centres, [found[n].reshape(-1, b - a) for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])


def best_codes(book: Codebook, queries: np.ndarray, codes, lists, own, short: int):
    """(query, code, distance less the query's square) of the ``short`` nearest codes of each query.

    An even draw of the codes foresees how far the last of them is; where that was too
    near, all codes are ordered.
    """
    total = len(codes)

    def near(rows: np.ndarray, part) -> np.ndarray:
        return own[part] - 2.0 * queries[rows] @ book.rebuilt(codes[part], lists[part]).T

    step = -(-total // FORESEEN)
    drawn = slice(None, None, step)
    count = len(range(0, total, step))
    place = min(int(short / step * 1.3 + 4 * (short / step) ** 0.5) + 3, count) - 1
    found = []
    for low in range(0, len(queries), max(1, SHORT_AT_ONCE // max(short, CODES_AT_ONCE))):
        rows = np.arange(low, min(low + max(1, SHORT_AT_ONCE // max(short, CODES_AT_ONCE)), len(queries)))
        limit = np.full(len(rows), np.inf)
        if total > short and step > 1:
            limit = np.partition(near(rows, drawn), place, axis=1)[:, place]
        found.append(_within(near, rows, limit, total, short))
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _within(near, rows: np.ndarray, limit: np.ndarray, total: int, short: int):
    held = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    seen = 0
    for start in range(0, total, CODES_AT_ONCE):
        some = near(rows, slice(start, start + CODES_AT_ONCE))
        r, c = np.divmod(np.flatnonzero(some <= limit[:, None]), some.shape[1])
        held.append((r, c + start, some[r, c]))
        seen += len(r)
        if seen > 4 * short * len(rows):  # the limit lets through too much; the best so far remain
            held = [_first(held, short)]
            seen = len(held[0][0])
    r, c, distance = _first(held, short)
    few = np.flatnonzero(np.bincount(r, minlength=len(rows)) < min(short, total))
    if len(few) and np.isfinite(limit[few]).any():
        kept = ~np.isin(r, few)
        more = _within(near, rows[few], np.full(len(few), np.inf), total, short)
        return [np.concatenate(x) for x in zip((rows[r[kept]], c[kept], distance[kept]), more, strict=True)]
    return rows[r], c, distance


def _first(held, short: int):
    r, c, distance = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((c, distance, r))
    r, c, distance = r[order], c[order], distance[order]
    starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]][: len(r)])
    kept = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)])) < short
    return r[kept], c[kept], distance[kept]


def _codes(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), -1)
    return codes, batch["list"].to_numpy(), batch["own"].to_numpy()


def _short(queries, trials: DataFrame, coded: DataFrame, truth: DataFrame, shipped, reach: float) -> int:
    """Rows of a short list that holds ``reach`` of the exact neighbours of the trials."""
    wanted = truth.join(coded, "id").join(trials, "query_id").toPandas()  # trials times k rows
    if not len(wanted):
        return 1
    book = shipped.value

    def own_distance(row) -> float:
        tables = book.tables(np.array([row["vector"]], dtype=np.float64))
        codes = np.frombuffer(row["code"], np.uint8)[None, :]
        return float(book.near(tables, codes, np.array([row["list"]]), np.array([row["own"]]))[0, 0])

    asked = [(np.array(row["vector"], dtype=np.float64), own_distance(row)) for _, row in wanted.iterrows()]
    vectors, limits = np.array([a for a, _ in asked]), np.array([b for _, b in asked])

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        book, total = shipped.value, np.zeros(len(limits), np.int64)
        tables = book.tables(vectors)
        for batch in batches:
            for low in range(0, len(batch), CODES_AT_ONCE):
                near = book.near(tables, *_codes(batch.iloc[low : low + CODES_AT_ONCE]))
                total += (near <= limits[:, None]).sum(axis=1)
        yield pd.DataFrame({"n": np.arange(len(total)), "ahead": total})

    counted = coded.select("code", "list", "own").mapInPandas(ahead, "n int, ahead bigint")
    ranks = [r["ahead"] for r in counted.groupBy("n").agg(F.sum("ahead").alias("ahead")).collect()]
    return int(np.quantile(ranks, reach, method="higher"))


def top_k_compressed(
    queries: DataFrame, corpus: DataFrame, k: int = 5, reach: float = 0.96, seed: int = 7
) -> DataFrame:
    """(query_id, rank, id, distance, compared): approximate ``top_k`` by compressed codes.

    A block of queries visits the lists that any of its queries asks for, and compares
    codes only: a byte for WIDTH dimensions. The best codes of a query, as many as hold
    the share ``reach`` of the exact neighbours of a few queries, are compared with the
    vectors; ``compared`` is their number, at least ``k``, so a query gets
    ``min(k, corpus)`` rows if its lists hold them. Distances are exact; ties go to the
    smaller id. Lists are copied for the blocks that visit them, codes only. Empty inputs
    give no rows.
    """
    columns = ["query_id", "rank", "id", "distance", "compared"]
    spark, count = queries.sparkSession, corpus.count()
    if not count or queries.isEmpty():
        nothing = spark.createDataFrame([], _result(queries, corpus))
        return _ranked(nothing, k).withColumn("compared", F.lit(0)).select(*columns)
    centres = neighbours._fit_centres(corpus, count, seed)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series(_distances(_matrix(vectors), centres).argmin(axis=1).astype(np.int32))

    listed = stage(corpus.select("id", "vector", nearest("vector").alias("list")), "lists")
    counts = np.zeros(len(centres), np.int64)
    for row in listed.groupBy("list").count().collect():  # one row per list
        counts[row["list"]] = row["count"]
    shipped = spark.sparkContext.broadcast(fit_codebook(listed, centres, count, seed))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, own = shipped.value.encode(_matrix(batch["vector"]), batch["list"].to_numpy())
            yield pd.DataFrame(
                {"id": batch["id"], "list": batch["list"], "code": [c.tobytes() for c in codes], "own": own}
            )

    kind = dict(corpus.dtypes)["id"]
    coded = stage(listed.mapInPandas(encode, f"id {kind}, list int, code binary, own double"), "codes")
    trials = stage(queries.select("query_id", "vector").orderBy(F.xxhash64("query_id")).limit(neighbours.TRIAL_QUERIES), "trials")
    truth = stage(neighbours.top_k(trials, corpus, k).select("query_id", "id"), "truth")
    depth = max(neighbours.depth_of(trials, truth, listed, centres, counts, reach), k - 1)
    short = max(_short(queries, trials, coded, truth, shipped, reach), k)

    @F.pandas_udf("array<int>")
    def probed(vectors: pd.Series) -> pd.Series:
        order, ahead = _lists_ahead(_matrix(vectors), centres, counts)
        return pd.Series(
            [own[(before <= depth) & (counts[own] > 0)] for own, before in zip(order, ahead, strict=True)]
        )

    asked = stage(queries.select("query_id", "vector", probed("vector").alias("lists")), "asked")
    left, visits = neighbours.blocks_of_queries(asked, centres, QUERY_BLOCK)
    parts = -(-count // PART_ROWS)
    left = left.select("query_id", "vector", "i", neighbours._each(parts).alias("j"))
    right = coded.join(visits, "list").withColumn("j", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def compare(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "near": [], "i": []})
        ids, asked = c["id"].to_numpy(), q["query_id"].to_numpy()
        rows, at, near = best_codes(shipped.value, _matrix(q["vector"]), *_codes(c), short)
        return pd.DataFrame({"query_id": asked[rows], "id": ids[at], "near": near, "i": q["i"].iloc[0]})

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {kind}, near double, i int"
    cells = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(compare, kinds)
    if parts > 1 or not asked.groupBy("query_id").count().where("count > 1").isEmpty():
        best = W.partitionBy("query_id").orderBy("near", "id")
        cells = cells.withColumn("place", F.row_number().over(best)).where(F.col("place") <= short)
    pairs = stage(cells.select("query_id", "id", "i"), "short")
    return _ranked(_measured(pairs, queries, corpus, count, k), k).select(*columns)


def _measured(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, count: int, k: int) -> DataFrame:
    """(query_id, id, distance, compared): the ``k`` nearest of ``pairs`` (query_id, id, i).

    The pairs of a block ``i`` meet the vectors that any of them names, in parts of bounded
    size, so a vector is copied for blocks and not for pairs.
    """
    part = F.pmod(F.xxhash64("id"), F.lit(-(-count // VECTOR_ROWS))).cast("int").alias("j")
    pairs = pairs.where("query_id IS NOT NULL AND id IS NOT NULL").select("query_id", "id", "i", part)
    left = pairs.groupBy("query_id", "i", "j").agg(F.collect_list("id").alias("ids"))
    left = left.join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")
    named = pairs.select(F.col("i").alias("for_i"), F.col("j").alias("for_j"), "id").distinct()
    right = named.join(corpus.select("id", F.col("vector").alias("vector")), "id")

    def measure(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": [], "n": []})
        asked, vectors = _matrix(q["asked"]), _matrix(c["vector"])
        named = pd.DataFrame({"id": np.concatenate(q["ids"].tolist()), "row": np.repeat(np.arange(len(q)), q["ids"].map(len))})
        met = named.merge(pd.DataFrame({"id": c["id"], "at": np.arange(len(c))}), on="id")
        row, at, distance = met["row"].to_numpy(), met["at"].to_numpy(), np.empty(len(met))
        for low in range(0, len(met), neighbours.PAIRS_AT_ONCE):
            some = slice(low, low + neighbours.PAIRS_AT_ONCE)
            distance[some] = ((asked[row[some]] - vectors[at[some]]) ** 2).sum(axis=1)
        n = np.bincount(row, minlength=len(q))
        row, ids, distance = neighbours._keep_best((row, met["id"].to_numpy(), distance), k)
        first = np.r_[True, row[1:] != row[:-1]]  # a query's number of pairs stands once
        return pd.DataFrame(
            {"query_id": q["query_id"].to_numpy()[row], "id": ids, "distance": distance, "n": np.where(first, n[row], 0)}
        )

    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id {dict(corpus.dtypes)['id']}, distance double, n long"
    found = left.groupBy("i", "j").cogroup(right.groupBy("for_i", "for_j")).applyInPandas(measure, kinds)
    compared = F.sum("n").over(W.partitionBy("query_id")).cast("int")
    return found.withColumn("compared", compared).drop("n")
