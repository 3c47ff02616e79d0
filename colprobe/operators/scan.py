"""The fused scan: every per-cell test of every column in one pass, without a shuffle.

Pattern hits, empty strings, letter case, fractional and infinite numbers and missing
cells are all conditional counts, so they share one aggregation that reduces each input
partition to a single row. Wide schemas are cut into passes over disjoint column sets:
each pass reads only its own columns, and the aggregate stays small enough for code
generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.functions.patterns import PATTERNS, holds_personal_data, matches
from colprobe.functions.types import FRACTIONAL, Field, fields_of, in_passes, sql_text

ALL_MEASURES = ("patterns", "empty", "case", "number")

# Result columns next to the counts that every column has.
_COUNTS = (
    *PATTERNS,
    "empty_count",
    "lowercase_count",
    "uppercase_count",
    "integer_count",
    "infinite_count",
)


def _tests(field: Field, measures: tuple[str, ...]) -> dict[str, str]:
    """SQL tests of one cell, by the name of the count they feed."""
    cell = field.cell
    tests: dict[str, str] = {}
    if field.is_string:
        if "patterns" in measures:
            tests |= {name: holds_personal_data(cell, name) for name in PATTERNS}
        if "empty" in measures:
            tests["empty_count"] = f"coalesce({cell}, '') = ''"
        if "case" in measures:
            # cased letters exist, and all of them are lower (upper) case
            tests["lowercase_count"] = f"lower({cell}) = {cell} AND upper({cell}) <> {cell}"
            tests["uppercase_count"] = f"upper({cell}) = {cell} AND lower({cell}) <> {cell}"
    elif field.is_numeric and not field.is_integral and "number" in measures:
        tests["integer_count"] = f"({cell}) % 1 = 0"
        if isinstance(field.dtype, FRACTIONAL):
            tests["infinite_count"] = f"abs({cell}) = double('infinity')"
    return tests


def scan_columns(
    df: DataFrame,
    columns: list[str] | None = None,
    measures: tuple[str, ...] = ALL_MEASURES,
) -> DataFrame:
    """One row per column: totals, missing cells and the requested counts.

    Counts that do not apply to a column's type class, or were not asked for, are NULL.
    """
    planned = [(f, _tests(f, measures)) for f in fields_of(df, columns)]
    if not planned:
        raise ValueError("no column to scan")
    passes = in_passes(planned, lambda item: len(item[1]) + 1)
    return reduce(DataFrame.unionByName, [_one_pass(df, part) for part in passes])


def _one_pass(df: DataFrame, planned: list[tuple[Field, dict]]) -> DataFrame:
    aggregates = ["count(1) AS n"]
    rows = []
    for field, tests in planned:
        ix = field.ix
        aggregates.append(f"count({field.cell}) AS v{ix}")
        aggregates += [f"count_if({test}) AS {name}_{ix}" for name, test in tests.items()]
        counts = {
            name: f"{name}_{ix}" if name in tests else "CAST(NULL AS BIGINT)" for name in _COUNTS
        }
        if field.is_integral:
            counts["integer_count"] = f"v{ix}"
        if field.is_numeric and not isinstance(field.dtype, FRACTIONAL):
            counts["infinite_count"] = "0L"
        parts = {
            "column_ix": str(ix),
            "column_name": sql_text(field.name),
            "type_class": sql_text(field.type_class),
            "total_count": "n",
            "missing_count": f"n - v{ix}",
            "value_count": f"v{ix}",
            **counts,
        }
        rows.append("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")")
    counted = df.agg(*[F.expr(a) for a in aggregates])
    return counted.selectExpr(f"inline(array({', '.join(rows)}))")


def pattern_match_count(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """One row: cells of ``column`` (as text) in which ``pattern`` is found."""
    (field,) = fields_of(df, [column])
    return df.agg(F.count_if(matches(field.clean().cast("string"), pattern)).alias("match_count"))
