import numpy as np
import pytest
from pyspark.sql import functions as F

from colprobe.functions.types import fields_of
from colprobe.operators import outliers as mod


def counts(df):
    return {r["column_name"]: r["outlier_count"] for r in mod.outliers(df).collect()}


def test_properties(spark):
    df = spark.range(2000).selectExpr(
        "CASE WHEN id = 0 THEN 1e6 ELSE pmod(xxhash64(id), 1000) / 10.0 END AS spread",
        "1.0D AS constant",
        "CASE WHEN id = 0 THEN double('infinity') ELSE double(id) END AS infinite",
        "cast(NULL AS double) AS nothing",
        "concat('t', id) AS text",
        "id % 2 = 0 AS flag",
    )
    found = counts(df)
    assert 150 <= found["spread"] <= 220
    others = {c: n for c, n in found.items() if c not in ("spread", "flag")}
    assert set(others.values()) == {0}
    assert found == counts(df.repartition(5).orderBy("text"))


def test_both_ways_of_scoring_agree(spark, monkeypatch):
    df = spark.range(3000).selectExpr(
        "pmod(xxhash64(id), 50) AS few", "CASE WHEN id % 9 > 0 THEN sqrt(id) END AS many"
    )
    found = counts(df)
    for repeats in (0, 10**9):
        monkeypatch.setattr(mod, "REPEATS", repeats)
        assert counts(df) == found


def test_planted_extreme_is_isolated():
    rng = np.random.default_rng(1)
    points = np.sort(np.append(rng.normal(size=500), 1000.0))
    rng = np.random.default_rng(4)
    samples = [np.sort(rng.choice(points, 256, replace=False)) for _ in range(mod.TREES)]
    samples[0] = samples[0][:0]  # a tree may stay without points
    breaks, scores = mod.grow_forest(samples, 256, [42, 0])
    assert np.all(np.diff(breaks) >= 0)
    assert len(scores) == len(breaks) + 1
    step = np.searchsorted(breaks, points, side="left")
    assert scores[step][-1] == scores[step].max()
    assert np.all((scores > 0) & (scores <= 1))


def test_step_function_equals_tree_walk():
    points = np.sort(np.random.default_rng(3).uniform(size=64))
    splits, leaves = mod._grow_tree(points, np.random.default_rng(5))
    assert splits == sorted(splits)
    assert len(leaves) == len(splits) + 1
    sizes = np.diff(np.r_[0, np.searchsorted(points, splits, side="right"), 64])
    assert sizes.min() >= 1


def test_percentile_rule_against_numpy(spark):
    rng = np.random.default_rng(2)
    for n in (10, 11, 37, 200, 201):
        scores = rng.choice(np.round(rng.uniform(size=12), 3), size=n)
        values, freqs = np.unique(scores, return_counts=True)
        rows = [(0, float(v), int(f)) for v, f in zip(values, freqs, strict=True)]
        df = spark.createDataFrame(rows, "column_ix int, score double, freq long")
        found = mod._outlier_counts(df).first()["outlier_count"]
        assert found == int((-scores < np.percentile(-scores, 10)).sum()), n


def test_thinning_keeps_the_distribution():
    freq = np.array([1, 3, 50, 4000])
    p, draws = 0.02, 4000
    rng = np.random.default_rng(0)
    kept = 1 - (1 - p) ** freq.astype(float)
    total = np.zeros(len(freq))
    for i in range(draws):
        u = rng.uniform(size=len(freq))
        alive = u < kept
        copies = mod._copies(freq[alive], u[alive], p, rng.integers(0, 2**31, alive.sum()))
        total[alive] += copies
    assert total / draws == pytest.approx(freq * p, rel=0.15, abs=0.01)


def test_columns_of_all_sizes_follow_one_rule(spark):
    for rows in (200, 256, 300, 20000):
        df = spark.range(rows).select(
            (F.pmod(F.xxhash64("id"), F.lit(5000)) / 7.0).alias("x"), F.lit(3).alias("same")
        )
        found = counts(df)
        assert 0.07 * rows <= found["x"] <= 0.105 * rows
        assert found["same"] == 0


def test_exact_medians(spark, monkeypatch):
    df = spark.range(1001).selectExpr(
        "double(pmod(xxhash64(id), 97)) - 40 AS a",
        "CASE WHEN id % 3 > 0 THEN exp(double(id) / 50) END AS b",
        "CASE WHEN id = 7 THEN 2.5D END AS c",
    )
    fields = fields_of(df)
    stats = mod.column_stats(df, fields)
    expected = df.agg(*[F.median(c) for c in "abc"]).first()
    for accuracy in (10_000, 20):
        monkeypatch.setattr(mod, "MEDIAN_ACCURACY", accuracy)
        found = mod.exact_medians(mod._cells(df, fields), stats)
        assert [found[i] for i in range(3)] == pytest.approx(list(expected))


def test_medians_by_narrower_brackets(spark, monkeypatch):
    """No more cells than MEDIAN_ROWS are sorted by one task, whatever the column holds."""
    monkeypatch.setattr(mod, "MEDIAN_ROWS", 300)
    monkeypatch.setattr(mod, "MEDIAN_ACCURACY", 1000)
    seen, real = [], mod._with_brackets

    def watched(present, brackets):
        seen.append({ix: present.where(F.col("column_ix") == ix).where(
            (F.col("number") >= low) & (F.col("number") <= high)).select("number").distinct().count()
            for ix, (low, high) in brackets.items()})
        return real(present, brackets)

    monkeypatch.setattr(mod, "_with_brackets", watched)
    df = spark.range(60_000).selectExpr(
        "double(pmod(xxhash64(id), 1000003)) AS a",
        "CASE WHEN id % 3 > 0 THEN exp(double(id) / 900) END AS b",
        "CASE WHEN id % 2 = 0 THEN 5D ELSE double(id) END AS c",
        "double(id % 2) AS d",
    )
    fields = fields_of(df)
    stats = mod.column_stats(df, fields)
    found = mod.exact_medians(mod._cells(df, fields), stats)
    expected = df.agg(*[F.median(c) for c in "abcd"]).first()
    assert [found[i] for i in range(4)] == pytest.approx(list(expected))
    assert len(seen) > 1 and max(seen[-1].values()) <= 300


def test_medians_take_as_many_jobs_for_any_data(spark):
    def jobs(expression):
        df = spark.range(20_000).selectExpr(f"CASE WHEN id % 5 > 0 THEN {expression} END AS x")
        group = f"medians {expression}"
        spark.sparkContext.setJobGroup(group, group)
        prepared = mod.prepare(df)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert prepared.medians[0] == pytest.approx(df.agg(F.median("x")).first()[0])
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs("exp(double(id) / 50)") == jobs("double(id)")
