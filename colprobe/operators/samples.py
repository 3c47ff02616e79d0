"""A few example values per column, the same whatever the partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.functions.types import Field, fields_of, per_field
from colprobe.operators.frequencies import COLUMNS_AT_ONCE, unfold

# Groups of hashes per wanted sample, for the bound.
_GROUPS = 4


def _hashed(df: DataFrame, fields: list[Field]) -> DataFrame:
    """(column_ix, value, hash, place) of the present cells; the place orders as the hash does."""
    parts = [
        unfold(df, "string", fields[start : start + COLUMNS_AT_ONCE], lambda f: f.cell)
        for start in range(0, len(fields), COLUMNS_AT_ONCE)
    ]
    cells = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL")
    cells = cells.withColumn("hash", F.md5("value"))
    return cells.withColumn("place", F.conv(F.left("hash", F.lit(15)), 16, 10).cast("bigint"))


def column_samples(df: DataFrame, size: int = 5, columns: list[str] | None = None) -> DataFrame:
    """Up to ``size`` distinct non-missing values per column, smallest MD5 first.

    A first pass takes the smallest hash within each of several hash groups, counted
    where the cells lie. The ``size``-th smallest of those is the hash of a real value,
    so at least ``size`` distinct values lie at or below it: filtering with it loses none
    of the wanted values and leaves a handful per column to de-duplicate and rank.
    Columns with too few occupied groups are not filtered; they have few distinct values,
    which the map-side de-duplication collapses. Wide tables are read in parts, each with
    columns of its own.
    """
    fields = fields_of(df, columns)
    cells = _hashed(df, fields)
    group = F.pmod(F.xxhash64("place"), F.lit(_GROUPS * size)).alias("group")
    minima = cells.groupBy("column_ix", group).agg(F.min("place").alias("place"))
    ordered = F.array_sort(F.collect_list("place"))  # at most as many as there are groups
    bounds = minima.groupBy("column_ix").agg(F.get(ordered, F.lit(size - 1)).alias("bound"))
    candidates = (
        cells.join(F.broadcast(bounds), "column_ix")  # one row per column
        .where(F.col("bound").isNull() | (F.col("place") <= F.col("bound")))
        .groupBy("column_ix", "hash", "value")
        .agg(F.lit(1).alias("seen"))
    )
    order = W.partitionBy("column_ix").orderBy("hash")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= size)
        .select(
            "column_ix",
            per_field(fields, lambda f: f.name).alias("column_name"),
            "rank",
            "value",
        )
    )


def sample_lists(df: DataFrame, size: int = 5) -> DataFrame:
    """One row per column that has values: its samples as an array."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "value")))
    return (
        column_samples(df, size)
        .groupBy("column_ix", "column_name")
        .agg(F.transform(ranked, lambda s: s["value"]).alias("samples"))
    )


