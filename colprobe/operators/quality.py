"""Six data-quality dimensions per column and for the whole table.

Per-cell counts come from the fused scan, value statistics from the frequency table;
both have one row per column, so every step after them is tiny. The accuracy dimension
needs an outlier model (``operators.outliers``) and enters as one more column table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprobe.functions.types import Field, fields_of, per_field
from colprobe.operators.frequencies import duplicate_rows, frequency_metrics
from colprobe.operators.privacy import share
from colprobe.operators.scan import scan_columns

# Weights of the overall score, in dimension order.
WEIGHTS = {
    "completeness": 0.25,
    "accuracy": 0.20,
    "validity": 0.15,
    "uniqueness": 0.15,
    "integrity": 0.10,
    "consistency": 0.15,
}
# Weights of the legacy quality score.
LEGACY_WEIGHTS = {"missing": 0.5, "outlier": 0.3, "consistency": 0.2}
# A column name holding one of these marks a likely identifier.
ID_MARKS = ("id", "key", "code", "num", "uuid")
ID_RATIO = 0.9


# --- expressions over a column table -------------------------------------------


def missing_share() -> Column:
    return share(F.col("missing_count"), F.col("total_count"))


def completeness_columns(counts: DataFrame) -> DataFrame:
    return counts.withColumn("missing_percentage", missing_share()).withColumn(
        "completeness_score", 1 - F.col("missing_percentage")
    )


def _as_string(strict_strings: bool) -> Column:
    """Whether a column is treated as text; strictly, only when no cell is missing."""
    textual = F.col("type_class") == "string"
    return textual & (F.col("missing_count") == 0) if strict_strings else textual


def validity_columns(scanned: DataFrame, strict_strings: bool = False) -> DataFrame:
    numeric = F.col("type_class") == "numeric"
    textual = _as_string(strict_strings)
    infinite, empty = F.col("infinite_count"), F.col("empty_count")
    return scanned.withColumns(
        {
            "invalid_count": F.when(numeric, infinite).when(textual, empty).otherwise(F.lit(0)),
            "validity_score": F.when(numeric, 1 - share(infinite, F.col("value_count")))
            .when(textual, 1 - share(empty, F.col("total_count")))
            .otherwise(F.lit(1.0)),
        }
    )


def uniqueness_columns(metrics: DataFrame) -> DataFrame:
    values = F.col("value_count")
    return metrics.withColumns(
        {
            "unique_percentage": share(F.col("distinct_count"), values, empty=1.0),
            "uniqueness_score": 1 - share(F.col("duplicate_count"), values),
        }
    )


def looks_like_id(field: Field) -> bool:
    return any(mark in field.name.lower() for mark in ID_MARKS)


def integrity_columns(metrics: DataFrame, fields: list[Field]) -> DataFrame:
    ratio = share(F.col("distinct_count"), F.col("value_count"))
    named = per_field(fields, looks_like_id)
    return metrics.withColumns(
        {
            "is_potential_id": named,
            "unique_ratio": ratio,
            "null_count": F.col("missing_count"),
            "integrity_score": 1 - missing_share(),
            "counts_as_id": named | (ratio > ID_RATIO),
        }
    )


def consistency_columns(scanned: DataFrame, strict_strings: bool = False) -> DataFrame:
    values = F.col("value_count")
    lower, upper = F.col("lowercase_count"), F.col("uppercase_count")
    textual, numeric = _as_string(strict_strings), F.col("type_class") == "numeric"
    mixed = values - lower - upper
    fractional = values - F.col("integer_count")
    return scanned.withColumns(
        {
            "lowercase_count": F.when(textual, lower),
            "uppercase_count": F.when(textual, upper),
            "mixed_case_count": F.when(textual, mixed),
            "integer_count": F.when(numeric, F.col("integer_count")),
            "float_count": F.when(numeric, fractional),
            "case_consistency_score": F.when(
                textual, share(F.greatest(lower, upper, mixed), values, empty=1.0)
            ).otherwise(F.lit(1.0)),
            "format_consistency_score": F.when(
                numeric, share(F.greatest(F.col("integer_count"), fractional), values, empty=1.0)
            ).otherwise(F.lit(1.0)),
        }
    )


def type_columns(metrics: DataFrame, fields: list[Field]) -> DataFrame:
    """Declared and inferred type; a numeric column without fractions is an integer."""
    whole = F.col("integer_count") == F.col("value_count")
    fixed = per_field(
        fields,
        lambda f: "boolean" if f.is_boolean else "datetime" if f.is_datetime else "string",
    )
    numeric = per_field(fields, lambda f: f.is_numeric and not f.is_boolean)
    return metrics.withColumns(
        {
            "dtype": per_field(fields, lambda f: f.dtype.simpleString()),
            "inferred_type": F.when(numeric, F.when(whole, "integer").otherwise("float")).otherwise(
                fixed
            ),
            "unique_values": F.col("distinct_count"),
            "unique_percentage_of_rows": share(F.col("distinct_count"), F.col("total_count")),
        }
    )


# --- single dimensions ------------------------------------------------------------


def missing_values(df: DataFrame) -> DataFrame:
    return completeness_columns(scan_columns(df, measures=())).select(
        "column_name", "missing_count", "missing_percentage"
    )


def completeness(df: DataFrame) -> DataFrame:
    return completeness_columns(scan_columns(df, measures=())).select(
        "column_name", "missing_count", "missing_percentage", "completeness_score"
    )


def completeness_overall(df: DataFrame) -> DataFrame:
    totals = scan_columns(df, measures=()).agg(
        F.sum("total_count").alias("total_cells"),
        F.sum("value_count").alias("non_missing_cells"),
        F.sum("missing_count").alias("missing_cells"),
    )
    score = share(F.col("non_missing_cells"), F.col("total_cells"), empty=1.0)
    return totals.withColumn("overall_score", score)


def data_types(df: DataFrame) -> DataFrame:
    fields = fields_of(df)
    integers = scan_columns(df, measures=("number",)).select("column_ix", "integer_count")
    metrics = frequency_metrics(df).join(F.broadcast(integers), "column_ix")
    return type_columns(metrics, fields).select(
        "column_name",
        "dtype",
        "inferred_type",
        "unique_values",
        F.col("unique_percentage_of_rows").alias("unique_percentage"),
    )


def validity(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    scanned = scan_columns(df, measures=("empty", "number"))
    return validity_columns(scanned, strict_strings).select(
        "column_name", "invalid_count", "validity_score"
    )


def uniqueness(df: DataFrame) -> DataFrame:
    return uniqueness_columns(frequency_metrics(df)).select(
        "column_name", "duplicate_count", "unique_percentage", "uniqueness_score"
    )


def integrity(df: DataFrame) -> DataFrame:
    return integrity_columns(frequency_metrics(df), fields_of(df)).select(
        "column_name", "is_potential_id", "unique_ratio", "null_count", "integrity_score"
    )


def consistency(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    scanned = scan_columns(df, measures=("case", "number"))
    return consistency_columns(scanned, strict_strings).select(
        "column_name",
        "case_consistency_score",
        "format_consistency_score",
        "lowercase_count",
        "uppercase_count",
        "mixed_case_count",
        "integer_count",
        "float_count",
    )


def consistency_legacy(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    """Older case score: the larger of the lower and upper shares, mixed case left out."""
    scanned = consistency_columns(scan_columns(df, measures=("case",)), strict_strings)
    clear = F.greatest("lowercase_count", "uppercase_count")
    zero = F.lit(0).cast("bigint")
    return scanned.select(
        "column_name",
        F.when(clear.isNotNull(), share(clear, F.col("value_count"), empty=1.0))
        .otherwise(F.lit(1.0))
        .alias("case_consistency_score"),
        F.coalesce("lowercase_count", zero).alias("lowercase_count"),
        F.coalesce("uppercase_count", zero).alias("uppercase_count"),
        F.coalesce("mixed_case_count", zero).alias("mixed_case_count"),
    )


# --- whole table ------------------------------------------------------------------


def validity_score() -> Column:
    return F.coalesce(F.avg("validity_score"), F.lit(1.0))


def integrity_score() -> Column:
    """Likely identifiers weigh 0.7 and the other columns 0.3, when both kinds exist."""
    ids = F.avg(F.when(F.col("counts_as_id"), F.col("integrity_score")))
    others = F.avg(F.when(~F.col("counts_as_id"), F.col("integrity_score")))
    return F.coalesce(ids * 0.7 + others * 0.3, ids, others, F.lit(1.0))


def consistency_score() -> Column:
    both = F.sum("case_consistency_score") + F.sum("format_consistency_score")
    return F.coalesce(both / (2 * F.count("column_ix")), F.lit(1.0))


def validity_overall(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    scanned = scan_columns(df, measures=("empty", "number"))
    return validity_columns(scanned, strict_strings).agg(validity_score().alias("overall_score"))


def consistency_overall(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    scanned = scan_columns(df, measures=("case", "number"))
    return consistency_columns(scanned, strict_strings).agg(
        consistency_score().alias("overall_score")
    )


def integrity_overall(df: DataFrame) -> DataFrame:
    rows = integrity_columns(frequency_metrics(df), fields_of(df))
    hits = F.collect_list(F.when(F.col("counts_as_id"), F.struct("column_ix", "column_name")))
    return rows.agg(
        F.array_join(F.transform(F.array_sort(hits), lambda c: c["column_name"]), ", ").alias(
            "potential_id_columns"
        ),
        integrity_score().alias("overall_score"),
    )


def with_row_level(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Column rows plus the one row of ``duplicate_rows``, ready for one aggregation."""
    return columns.unionByName(duplicates, allowMissingColumns=True)


def _row_uniqueness() -> Column:
    return 1 - share(F.max("duplicate_rows"), F.max("row_count"))


def _uniqueness_score() -> Column:
    total = F.coalesce(F.sum("uniqueness_score"), F.lit(0.0)) + _row_uniqueness()
    return total / (F.count("column_ix") + 1)


def uniqueness_overall(df: DataFrame) -> DataFrame:
    rows = with_row_level(uniqueness_columns(frequency_metrics(df)), duplicate_rows(df))
    return rows.agg(
        F.max("duplicate_rows").alias("duplicate_rows"),
        _row_uniqueness().alias("row_uniqueness_score"),
        _uniqueness_score().alias("overall_score"),
    )


def per_cell_counts(scanned: DataFrame) -> DataFrame:
    """The scan without what the frequency metrics hold too; one row per column."""
    return scanned.drop("column_name", "total_count", "missing_count", "value_count")


def with_quality(
    joined: DataFrame,
    fields: list[Field],
    accuracy: DataFrame | None = None,
    strict_strings: bool = False,
) -> DataFrame:
    """All quality measures of rows holding both frequency metrics and scan counts.

    ``accuracy`` is an outlier table by ``column_ix``; without it every column is taken
    to be accurate.
    """
    rows = type_columns(joined, fields)
    rows = consistency_columns(validity_columns(rows, strict_strings), strict_strings)
    rows = integrity_columns(uniqueness_columns(completeness_columns(rows)), fields)
    if accuracy is None:
        return rows.withColumns(
            {
                "outlier_count": F.lit(0).cast("bigint"),
                "outlier_percentage": F.lit(0.0),
                "accuracy_score": F.lit(1.0),
            }
        )
    scores = accuracy.select("column_ix", "outlier_count", "outlier_percentage", "accuracy_score")
    return rows.join(F.broadcast(scores), "column_ix")  # one row per column


def summary_aggregates() -> list[Column]:
    """Dimension scores, as aggregates over column rows and the row-level row."""
    cells = F.sum("value_count") / F.nullif(F.sum("total_count"), F.lit(0))
    return [
        F.coalesce(cells, F.lit(1.0)).alias("completeness"),
        F.coalesce(F.avg("accuracy_score"), F.lit(1.0)).alias("accuracy"),
        validity_score().alias("validity"),
        _uniqueness_score().alias("uniqueness"),
        integrity_score().alias("integrity"),
        consistency_score().alias("consistency"),
        F.max("row_count").alias("num_rows"),
        F.max("duplicate_rows").alias("duplicate_rows"),
    ]


def with_overall(scores: DataFrame) -> DataFrame:
    overall = sum((F.lit(w) * F.col(name) for name, w in WEIGHTS.items()), F.lit(0.0))
    return scores.withColumn("overall_quality_score", overall)


def quality_summary(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row: the six dimension scores and their weighted sum."""
    return with_overall(with_row_level(columns, duplicates).agg(*summary_aggregates()))


def quality_legacy(columns: DataFrame) -> DataFrame:
    """One row: the older three-part score over the same column table."""
    parts = columns.agg(
        (1 - F.coalesce(F.avg("missing_percentage"), F.lit(0.0))).alias("missing_score"),
        (1 - F.coalesce(F.avg("outlier_percentage"), F.lit(0.0))).alias("outlier_score"),
        consistency_score().alias("consistency_score"),
    )
    overall = sum((F.lit(w) * F.col(f"{n}_score") for n, w in LEGACY_WEIGHTS.items()), F.lit(0.0))
    return parts.withColumn("overall_quality_score", overall)


def dimension_scores(summary: DataFrame) -> DataFrame:
    """Six rows: (dimension, score)."""
    rows = [
        F.struct(F.lit(name.title()).alias("dimension"), F.col(name).alias("score"))
        for name in WEIGHTS
    ]
    return summary.select(F.inline(F.array(*rows)))


def column_quality_table(columns: DataFrame) -> DataFrame:
    """The column table as shown to a reader: ten text columns."""

    def two(name: str) -> Column:
        return F.format_string("%.2f", F.col(name))

    def percent(name: str) -> Column:
        return F.format_string("%.1f%%", F.col(name) * 100)

    return columns.select(
        "column_name",
        F.col("inferred_type").alias("data_type"),
        two("completeness_score").alias("completeness"),
        percent("missing_percentage").alias("missing_percent"),
        two("accuracy_score").alias("accuracy"),
        two("validity_score").alias("validity"),
        two("uniqueness_score").alias("uniqueness"),
        percent("unique_percentage").alias("unique_percent"),
        F.concat(
            two("integrity_score"),
            F.when(F.col("is_potential_id"), F.lit(" (ID)")).otherwise(F.lit("")),
        ).alias("integrity"),
        two("case_consistency_score").alias("consistency"),
    )
