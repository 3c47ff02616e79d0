"""Distinct counts that leave unique values where they are, against grouped counts."""

import pytest
from pyspark.sql import functions as F

from colprobe.functions.types import fields_of
from colprobe.operators import constraints, frequencies, repeats

SHARED = ["column_ix", "column_name", "total_count", "missing_count", "value_count", "distinct_count", "duplicate_count"]
LINES = "/root/testdata/sf0.01/lineitem.parquet"


def same(df):
    found = repeats.distinct_counts(df).select(SHARED).orderBy("column_ix").collect()
    grouped = frequencies.frequency_metrics(df).select(SHARED).orderBy("column_ix").collect()
    assert found == grouped


def odd(spark):
    return spark.range(5000).selectExpr(
        "id",
        "id % 3 AS `value`",  # names the operator uses itself
        "if(id % 3 = 0, 'hot', concat('v', id)) AS slot",
        "if(id % 7 = 0, NULL, concat(repeat('long', 40), id div 2)) AS `a.b`",
        "CASE WHEN id % 5 = 0 THEN double('NaN') WHEN id % 5 = 1 THEN -0.0D WHEN id % 5 = 2 THEN 0.0D ELSE id END AS x",
        "CAST(NULL AS string) AS none",
        "id % 2 = 0 AS flag",
        "array(id div 4) AS nested",
        "CAST(CAST(id div 3 AS string) AS binary) AS bytes",
        "timestamp_seconds(id div 2) AS at",
        "CAST(id AS decimal(20, 2)) AS price",
    )


def test_counts_of_all_kinds_of_columns(spark):
    same(odd(spark))


@pytest.mark.parametrize("limits", [{"CELLS_AT_ONCE": 1000, "LOG_RANGE": 4}, {"MOST_SLOTS": 3}])
def test_counts_do_not_depend_on_limits(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(repeats, name, value)
    same(odd(spark).select("id", "slot", "`a.b`"))


def test_slots_shared_by_chance_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(repeats, "slot_bits", lambda rows: (6, 2))
    same(odd(spark).select("id", "slot", "`a.b`"))


def test_small_tables(spark):
    same(odd(spark).where("id = 0"))
    empty = repeats.distinct_counts(odd(spark).where("false")).collect()
    assert [r["column_ix"] for r in empty] == list(range(11))
    assert all(tuple(r)[2:] == (0, 0, 0, 0, 0) for r in empty)
    assert tuple(repeats.duplicate_rows(odd(spark).where("false")).first()) == (0, 0)
    with pytest.raises(ValueError):
        repeats.distinct_counts(odd(spark), ["unknown"])


def test_whole_rows(spark):
    twice = odd(spark).unionAll(odd(spark).where("id < 100")).repartition(5)
    assert tuple(repeats.duplicate_rows(twice).first()) == (5100, 100)


def test_bits_grow_with_rows():
    for size in range(0, 43):
        bits, ranges = repeats.slot_bits(1 << size)
        assert bits <= 63 and ranges <= 16 and bits - ranges >= 8
        if size <= 41:
            assert 2 * size - bits <= repeats.LOG_CHANCE  # pairs that meet by chance


def test_unique_keys_stay_where_they_are(spark):
    """Under a twentieth of the rows of a unique key travel, as blocks or as candidates."""
    lines = spark.read.parquet(LINES)
    digest = frequencies.row_digest(fields_of(lines))  # (l_orderkey, l_linenumber) repeats there
    key = lines.select(F.expr(f"hex({digest})").alias("key"))
    rows = key.count()
    [(_, cells)] = frequencies.typed_cells(key, fields_of(key))
    assert key.distinct().count() == rows
    bits, ranges = repeats.slot_bits(rows)
    blocks = repeats.packed_slots(repeats._slotted(cells, bits), bits, ranges)
    [candidates] = repeats.repeat_candidates([cells], rows)
    assert blocks.count() + candidates.count() < rows / 20
    taken = blocks.agg(F.sum(F.length("seen") + F.length("repeated"))).first()[0]
    assert taken < 5 * rows
    same(key)


def test_unique_constraints_agree(spark):
    wanted = [{"column": c, "type": "unique", "value": ""} for c in ("id", "slot", "none")]
    grouped = constraints.apply_constraints(odd(spark), wanted).collect()
    assert constraints.apply_constraints(odd(spark), wanted, few_repeats=True).collect() == grouped
