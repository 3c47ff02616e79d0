import numpy as np
import pytest

from colprobe.llm import ann

SF_DIR = "/root/testdata/sf0.01"


def truth(ids, vectors, query, k):
    scores = vectors @ vectors[query]
    scores[ids == ids[query]] = -np.inf
    order = np.lexsort((ids, -scores))[:k]
    return [(int(ids[o]), float(scores[o])) for o in order if scores[o] > -np.inf]


def compare(spark, ids, vectors, rows, queries, k):
    found = ann.search_index(rows, rows.where(f"vec_id IN ({','.join(map(str, queries))})"), k).collect()
    by_query = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    hits = wanted = 0
    for query in queries:
        exact = truth(ids, vectors, int(np.flatnonzero(ids == query)[0]), k)
        got = by_query.get(query, [])
        assert [r for _, _, r in got] == list(range(1, len(exact) + 1))
        assert got == sorted(got, key=lambda g: (-g[1], g[0]))
        for ident, score, _ in got:
            own = vectors[np.flatnonzero(ids == ident)[0]] @ vectors[np.flatnonzero(ids == query)[0]]
            assert ident != query and score == pytest.approx(own, abs=1e-12)
        hits += len({i for i, _ in exact} & {i for i, _, _ in got})
        wanted += len(exact)
    return hits / max(wanted, 1)


def test_recall(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    frame = rows.toPandas()
    ids = frame["vec_id"].to_numpy()
    vectors = np.array([np.asarray(v, np.float64) for v in frame["embedding"]])
    queries = [int(i) for i in ids if i % 20 == 0]
    assert compare(spark, ids, vectors, rows, queries, 20) >= 0.9


def test_norms_and_copies(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 8)) * rng.gamma(2, size=(400, 1))
    vectors[100:250] = vectors[100]
    ids = np.arange(400)
    rows = spark.createDataFrame(
        [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)],
        "vec_id bigint, embedding array<double>",
    )
    assert compare(spark, ids, vectors, rows, [0, 20, 100, 120, 399], 20) >= 0.9


def test_odd_vectors(spark):
    rows = spark.createDataFrame(
        [
            (1, [1.0, 2.0]),
            (2, [2.0, 1.0]),
            (3, None),
            (4, [0.0, 0.0]),
            (5, [float("nan"), 1.0]),
            (6, [None, 1.0]),
            (7, [float("inf"), 1.0]),
            (8, []),
            (9, [1.0, 2.0]),
            (None, [1.0, 1.0]),
            (10, [1.0, 1.0, 1.0]),
        ],
        "vec_id bigint, embedding array<float>",
    )
    found = ann.search_index(rows, rows, 20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [
        (1, 9, 5.0),
        (1, 2, 4.0),
        (2, 1, 4.0),
        (2, 9, 4.0),
        (9, 1, 5.0),
        (9, 2, 4.0),
    ]
    assert ann.search_index(rows, rows.limit(0), 20).count() == 0
    assert ann.search_index(rows, rows.where("vec_id = 10"), 20).count() == 0  # too long
    assert ann.search_index(rows.limit(0), rows, 20).count() == 0


@pytest.mark.parametrize("copies", [2, 30])
def test_repeated_rows(spark, copies):
    """Repeated rows count once; the score of ids with several vectors is the largest."""
    rng = np.random.default_rng(4)
    ids = np.r_[np.arange(120), 0, 7, 7]  # 0 asks with two vectors, 7 is found by three
    vectors = rng.normal(size=(len(ids), 6))
    again = np.isin(ids, [0, 3, 20])  # queries and a candidate
    many = np.r_[np.arange(len(ids)), np.repeat(np.flatnonzero(again), copies - 1)]
    rows = spark.createDataFrame(
        [(int(ids[n]), [float(x) for x in vectors[n]]) for n in many],
        "vec_id bigint, embedding array<double>",
    )
    found = ann.search_index(rows, rows.where("vec_id % 20 = 0"), 10).collect()
    scores = vectors @ vectors.T
    hits = 0
    for query in range(0, 120, 20):
        own = [r for r in found if r["query_id"] == query]
        best = {int(i): scores[np.ix_(ids == query, ids == i)].max() for i in set(ids) - {query}}
        assert sorted(r["rank"] for r in own) == list(range(1, 11))
        assert len({r["vec_id"] for r in own}) == 10
        hits += len({r["vec_id"] for r in own} & set(sorted(best, key=lambda i: (-best[i], i))[:10]))
        for r in own:
            assert r["score"] <= best[r["vec_id"]] + 1e-12
    assert hits >= 54


def test_best_takes_every_id_once():
    scores, ids = np.array([9.0, 9.0, 9.0, 8.0, 7.0, 7.0, -np.inf]), np.array([5, 5, 5, 5, 2, 1, 0])
    assert ids[ann._best(scores, ids, 2)].tolist() == [5, 1]
    assert ids[ann._best(scores, ids, 9)].tolist() == [5, 1, 2]


def test_cells_come_by_falling_sum():
    rng = np.random.default_rng(1)
    first, second, counts = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 3, (9, 7))
    seen = list(ann.visit(first, second, counts, int(counts.sum()), 0))
    sums = [first[i] + second[j] for i, j in seen]
    assert sums == sorted(sums, reverse=True)
    assert sorted(seen) == [(i, j) for i in range(9) for j in range(7) if counts[i, j]]
