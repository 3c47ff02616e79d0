"""Declared column constraints, all checked in one pass over the table.

Every constraint becomes a conditional count (``unique`` reads the frequency table), so
a list of any length costs one scan and no shuffle of rows. Literals are parsed once on
the driver; constraints that cannot apply turn into constant failing rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colprobe.functions.dates import DEFAULT_FORMAT, IllegalFormat, follows
from colprobe.functions.types import Field, fields_of, in_passes
from colprobe.operators.frequencies import frequency_metrics
from colprobe.operators.privacy import share
from colprobe.operators.repeats import distinct_counts

# Error messages; those of counts follow the number of bad cells.
NO_COLUMN = "Column not found in dataset"
HAS_NULLS = "null values found"
HAS_COPIES = "duplicate values found"
NOT_NUMERIC = "Column is not numeric"
BELOW = "values below minimum"
ABOVE = "values above maximum"
NO_PATTERN = "No regex pattern provided"
BAD_PATTERN = "Invalid regex pattern"
NOT_STRING = "Column is not string type"
NO_MATCH = "values don't match pattern"
NO_LIST = "No list of values provided"
BAD_LIST = "Invalid list format or type mismatch"
NOT_LISTED = "values not in allowed list"
NO_DATE = "values don't match date format"
UNKNOWN_KIND = "Unknown constraint type"
BAD_MINIMUM = "Invalid minimum value"
BAD_MAXIMUM = "Invalid maximum value"

KINDS = (
    "not_null",
    "unique",
    "min_value",
    "max_value",
    "regex",
    "value_in_list",
    "date_format",
)


@dataclass(frozen=True)
class Check:
    """A constraint ready to run: a settled outcome, or a test of each cell."""

    ix: int
    column: str
    kind: str
    value: str | None
    field: Field | None = None
    settled: tuple[bool, str] | None = None
    test: Column | None = None
    complaint: str = ""


def compile_constraints(df: DataFrame, constraints: list[dict]) -> list[Check]:
    """Constraints without a column are dropped, the others keep their order."""
    by_name = {f.name: f for f in fields_of(df)}
    named = [c for c in constraints if c.get("column")]
    return [
        _compile(df.sparkSession, ix, by_name.get(c["column"]), c) for ix, c in enumerate(named)
    ]


def _compile(spark: SparkSession, ix: int, field: Field | None, constraint: dict) -> Check:
    column, kind = constraint["column"], constraint.get("type")
    value = constraint.get("value")

    def failed(message: str) -> Check:
        return Check(ix, column, kind, value, field, settled=(False, message))

    def tested(test: Column, complaint: str) -> Check:
        return Check(ix, column, kind, value, field, test=test, complaint=complaint)

    if field is None:
        return failed(NO_COLUMN)
    cell = field.clean()
    if kind == "not_null":
        return tested(cell.isNotNull(), HAS_NULLS)
    if kind == "unique":
        return Check(ix, column, kind, value, field, complaint=HAS_COPIES)
    if kind in ("min_value", "max_value"):
        low = kind == "min_value"
        try:
            bound = float(value) if value else 0.0
        except ValueError:
            return failed(BAD_MINIMUM if low else BAD_MAXIMUM)
        if not field.is_numeric:
            return failed(NOT_NUMERIC)
        number = field.number()
        test = number >= bound if low else number <= bound
        if math.isnan(bound):
            test = F.lit(False)
        return tested(test, BELOW if low else ABOVE)
    if kind == "regex":
        if not value:
            return failed(NO_PATTERN)
        try:
            re.compile(value)
        except re.error:
            return failed(BAD_PATTERN)
        if not field.is_string:
            return failed(NOT_STRING)
        return tested(_matches(spark, cell, value), NO_MATCH)
    if kind == "value_in_list":
        if not value:
            return failed(NO_LIST)
        allowed = [v.strip() for v in value.split(",")]
        if field.is_numeric:
            try:
                test = field.number().isin([float(v) for v in allowed])
            except ValueError:
                return failed(BAD_LIST)
        elif field.is_datetime:
            test = cell.isin([F.try_to_timestamp(F.lit(v)).cast(field.dtype) for v in allowed])
        else:
            test = cell.cast("string").isin(allowed)
        return tested(test, NOT_LISTED)
    if kind == "date_format":
        value = value or DEFAULT_FORMAT
        if field.is_datetime:
            return Check(ix, column, kind, value, field, settled=(True, ""))
        try:
            test = follows(cell.cast("string"), value)
        except IllegalFormat:
            test = F.lit(False)  # no text can follow a format that does not exist
        return tested(test, NO_DATE)
    return failed(UNKNOWN_KIND)


def _matches(spark: SparkSession, cell: Column, pattern: str) -> Column:
    """Whether a cell begins with a match of a Python pattern.

    Most patterns mean the same in Java and stay inside the JVM. One that Java cannot
    read would fail the whole job, so it is tried first, and is left to Python, in
    batches, if it must be.
    """
    java = pattern.replace("(?P<", "(?<")
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java).replace(r"\Z", r"\z")
    anchored = f"^(?:{java})"
    try:
        spark.range(1).select(F.lit("").rlike(anchored)).collect()
    except PySparkException:

        @F.pandas_udf("boolean")
        def begins(cells: pd.Series) -> pd.Series:
            match = re.compile(pattern).match
            return cells.map(lambda c: None if c is None else match(c) is not None).astype(object)

        return begins(cell)
    return cell.rlike(anchored)


def _row(check: Check, good: Column, rate: Column, bad: Column) -> Column:
    passed = rate == 1.0
    message = F.concat(bad.cast("string"), F.lit(f" {check.complaint}"))
    return _result(check, passed, F.when(passed, F.lit("")).otherwise(message), rate)


def _result(check: Check, passed: Column, error: Column, rate: Column) -> Column:
    return F.struct(
        F.lit(check.ix).alias("constraint_ix"),
        F.lit(check.column).alias("column"),
        F.lit(check.kind).cast("string").alias("type"),
        F.lit(check.value).cast("string").alias("value"),
        passed.alias("passed"),
        error.alias("error"),
        rate.alias("pass_rate"),
    )


def apply_constraints(
    df: DataFrame, constraints: list[dict], few_repeats: bool = False
) -> DataFrame:
    """One row per constraint, numbered in the given order.

    ``few_repeats`` checks ``unique`` without shuffling values that occur once; the results are
    the same, and large tables with keys take less traffic for two more reads.
    """
    checks = compile_constraints(df, constraints)
    if not checks:
        return _empty_result(df.sparkSession)
    settled = [c for c in checks if c.settled is not None]
    scanned = [c for c in checks if c.test is not None]
    parts = []
    if settled:
        rows = [
            _result(c, F.lit(c.settled[0]), F.lit(c.settled[1]), F.lit(float(c.settled[0])))
            for c in settled
        ]
        parts.append(df.sparkSession.range(1).select(F.inline(F.array(*rows))))
    if scanned:
        parts += [_scanned_rows(df, part) for part in in_passes(scanned, lambda check: 2)]
    distinct = [c for c in checks if c.kind == "unique" and c.settled is None]
    if distinct:
        parts.append(_unique_rows(df, distinct, few_repeats))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.orderBy("constraint_ix")


def _scanned_rows(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Checks that count good cells, in one aggregation."""
    aggregates = [F.count(F.lit(1)).alias("n")]
    for field in {c.field.ix: c.field for c in checks}.values():
        aggregates.append(F.count(field.clean()).alias(f"v{field.ix}"))
    aggregates += [F.count_if(c.test).alias(f"good{c.ix}") for c in checks]
    rows = []
    for check in checks:
        whole = F.col("n") if check.kind == "not_null" else F.col(f"v{check.field.ix}")
        good = F.col(f"good{check.ix}")
        rows.append(_row(check, good, share(good, whole, empty=1.0), whole - good))
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def _unique_rows(df: DataFrame, checks: list[Check], few_repeats: bool) -> DataFrame:
    counted = distinct_counts if few_repeats else frequency_metrics
    metrics = counted(df, sorted({c.field.name for c in checks}))
    same = F.col("distinct_count") == F.col("value_count")
    rate = F.when(same, F.lit(1.0)).otherwise(F.lit(0.0))
    bad = F.col("value_count") - F.col("distinct_count")
    rows = [
        F.when(
            F.col("column_ix") == c.field.ix, _row(c, F.col("distinct_count"), rate, bad)
        )
        for c in checks
    ]
    return metrics.select(F.inline(F.array_compact(F.array(*rows))))


def _empty_result(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [],
        "constraint_ix int, column string, type string, value string, passed boolean, "
        "error string, pass_rate double",
    )


def constraint_summary(results: DataFrame) -> DataFrame:
    """One row: passed, failed, total and the share passed (1.0 without constraints)."""
    counts = results.agg(
        F.count_if("passed").alias("pass_count"),
        F.count_if(~F.col("passed")).alias("fail_count"),
        F.count(F.lit(1)).alias("total_count"),
    )
    score = share(F.col("pass_count"), F.col("total_count"), empty=1.0)
    return counts.withColumn("overall_score", score)


def constraint_table(results: DataFrame) -> DataFrame:
    """The results as shown to a reader."""
    return results.select(
        "column",
        F.initcap(F.replace(F.col("type"), F.lit("_"), F.lit(" "))).alias("constraint_type"),
        "value",
        F.when(F.col("passed"), F.lit("✓ Passed")).otherwise(F.lit("✗ Failed")).alias("status"),
        F.format_string("%.1f%%", F.col("pass_rate") * 100).alias("pass_rate"),
        "error",
    )
