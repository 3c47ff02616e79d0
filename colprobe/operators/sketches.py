"""Distinct counts from sketches that are stored per part of a table and united later.

A table that grows by day (or any other part) is read once: its parts keep one sketch per
column, of at most 2^``LOG_BUCKETS`` buckets whatever they hold, and the count of the whole
follows from the sketches alone. Sketches of values that occur in several parts unite
without counting them twice. A part that changed is sketched again and takes the place of
its old sketches; other parts aren't touched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colprobe.functions.types import Field, fields_of, per_field
from colprobe.operators.frequencies import COLUMNS_AT_ONCE, hashed_cell

# 16 384 buckets: a standard error of 0.8 %.
LOG_BUCKETS = 14


def sketched(df: DataFrame, part: str, columns: list[str] | None = None) -> DataFrame:
    """(part, column_ix, rows, sketch), one row per part and column.

    ``part`` is a SQL expression; missing cells are in no sketch but count as rows. Each task
    sends one sketch per part and column that it met, never values.
    """
    fields = fields_of(df, columns)
    groups = [fields[i : i + COLUMNS_AT_ONCE] for i in range(0, len(fields), COLUMNS_AT_ONCE)]
    cells = []
    for members in groups:
        pairs = ", ".join(f"{f.ix}, {hashed_cell(f)}" for f in members)
        stack = f"stack({len(members)}, {pairs}) AS (column_ix, value)"
        cells.append(df.selectExpr(f"CAST({part} AS STRING) AS part", stack))
    return (
        reduce(DataFrame.unionByName, cells)
        .groupBy("part", "column_ix")
        .agg(F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg("value", LOG_BUCKETS).alias("sketch"))
    )


def store_sketches(df: DataFrame, part: str, path: str, columns: list[str] | None = None) -> None:
    """Write the sketches of the parts that ``df`` holds; each part has to be there whole."""
    rows = sketched(df, part, columns)
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("part").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    schema = "column_ix int, rows bigint, sketch binary, part string"
    return spark.read.schema(schema).parquet(path)


def united_counts(sketches: DataFrame, fields: list[Field], *by: str | Column) -> DataFrame:
    """(``by``, column_ix, column_name, total_count, distinct_count) of any choice of parts."""
    united = sketches.groupBy(*by, "column_ix").agg(
        F.sum("rows").alias("total_count"), F.hll_union_agg("sketch").alias("sketch")
    )
    return united.select(
        *by,
        "column_ix",
        per_field(fields, lambda f: f.name).alias("column_name"),
        "total_count",
        F.hll_sketch_estimate("sketch").alias("distinct_count"),
    )
