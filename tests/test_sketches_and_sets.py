"""Stored sketches of distinct values, and smallest sets of columns that tell rows apart."""

import random
from itertools import combinations

import pytest

from colprobe.functions.types import fields_of
from colprobe.operators import anonymity, sketches
from colprobe.session import new_path


def distinct(spark, path, df, *by):
    rows = sketches.united_counts(sketches.stored_sketches(spark, path), fields_of(df), *by).collect()
    return {tuple(r[b] for b in by) + (r["column_name"],): (r["total_count"], r["distinct_count"]) for r in rows}


def test_parts_unite_and_are_replaced(spark):
    def days(*shares):
        frames = [
            spark.range(start, start + n).selectExpr(f"'{day}' AS day", "id", "nullif(id % 7, 3) AS k")
            for day, start, n in shares
        ]
        df = frames[0]
        for frame in frames[1:]:
            df = df.unionByName(frame)
        return df

    path = new_path(spark, "sketches")
    first = days(("mon", 0, 1000), ("tue", 500, 1000), ("wed", 0, 10))
    sketches.store_sketches(first, "day", path)
    counts = distinct(spark, path, first)
    assert counts[("day",)] == (2010, 3)
    assert counts[("k",)] == (2010, 6)  # missing cells are rows, not values
    assert abs(counts[("id",)][1] - 1500) <= 60  # 500 values occur in both parts
    assert distinct(spark, path, first, "part")[("wed", "id")] == (10, 10)
    # one part changes; the others stay
    sketches.store_sketches(days(("wed", 5000, 2000)), "day", path)
    counts = distinct(spark, path, first)
    assert counts[("day",)] == (4000, 3)
    assert abs(counts[("id",)][1] - 3500) <= 140


def test_parts_without_a_name_and_columns_without_values(spark):
    df = spark.sql("SELECT CAST(NULL AS STRING) AS day, CAST(NULL AS DOUBLE) AS x UNION ALL SELECT 'a', double('NaN')")
    path = new_path(spark, "sketches")
    sketches.store_sketches(df, "day", path)
    assert distinct(spark, path, df) == {("day",): (2, 1), ("x",): (2, 0)}


def by_force(rows, names, k, largest):
    bad = {}
    for size in range(1, largest + 1):
        for chosen in combinations(range(len(names)), size):
            groups = {}
            for row in rows:
                key = tuple(row[i] for i in chosen)
                groups[key] = groups.get(key, 0) + 1
            if groups and min(groups.values()) < k:
                if not any(set(other) < set(chosen) for other in bad):
                    below = sum(n for n in groups.values() if n < k)
                    bad[chosen] = (", ".join(names[i] for i in chosen), size, min(groups.values()), below)
    return sorted(bad.values())


@pytest.mark.parametrize("k", [2, 4, 9])
def test_smallest_sets_by_force(spark, k):
    draw = random.Random(k)
    sizes = [2, 3, 4, 2, 3, 1]
    # names that clash with those the operator uses
    names = ["freq", "set_ix", "c0", "left_out", "a.b", "one"]
    rows = [
        tuple(None if draw.random() < 0.1 else draw.randrange(n) for n in sizes) for _ in range(300)
    ]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
    found = anonymity.identifying_sets(df, k, max_columns=4)
    assert sorted(map(tuple, found.collect())) == by_force(rows, names, k, 4)


def test_sets_of_small_tables(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert anonymity.identifying_sets(empty).count() == 0
    same = spark.range(6).selectExpr("1 AS a", "double('NaN') AS b", "array(1) AS c")
    assert anonymity.identifying_sets(same, k=5).count() == 0
    assert anonymity.identifying_sets(same, k=7).count() == 3
    with pytest.raises(ValueError):
        anonymity.identifying_sets(same, k=1)


def test_sets_without_a_column_are_counted_in_a_shorter_table(spark, monkeypatch):
    """Sets of columns with few values came from the whole table of combinations before."""
    df = spark.range(3000).selectExpr("id % 4 AS a", "id % 3 AS b", "id % 5 AS c", "id % 601 AS d").localCheckpoint()
    seen, real = [], anonymity._groups

    def counted(table, freq, sets, names, places):
        seen.append((table.count(), len(sets)))
        return real(table, freq, sets, names, places)

    monkeypatch.setattr(anonymity, "_groups", counted)
    found = {tuple(r) for r in anonymity.identifying_sets(df, 4, max_columns=3).collect()}
    assert (60, 3) in seen
    monkeypatch.setattr(anonymity, "SHORTER_TABLES", 0)
    assert found == {tuple(r) for r in anonymity.identifying_sets(df, 4, max_columns=3).collect()} and found
