"""Whole-table profiles: what a data owner asks for in one go.

A ``TableProfile`` counts value frequencies once and derives every frequency metric and
the outlier model from them; the fused scan adds the per-cell counts. Everything else
works on one row per column.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colprobe.functions.types import fields_of
from colprobe.operators import assess, privacy, quality
from colprobe.operators.constraints import apply_constraints, constraint_summary
from colprobe.operators.frequencies import (
    duplicate_rows,
    frequency_counts,
    frequency_metrics,
    metrics_from_counts,
)
from colprobe.operators.outliers import outliers, prepare, survivor
from colprobe.operators.samples import sample_lists
from colprobe.operators.scan import scan_columns
from colprobe.session import stage


# Columns of the overall row that make up the privacy section of a report.
PRIVATE = (
    "overall_privacy_score",
    "overall_privacy_factor",
    "avg_shannon_entropy",
    "avg_hartley_measure",
    "high_risk_columns",
    "medium_risk_columns",
    "low_risk_columns",
    "high_risk_count",
    "medium_risk_count",
    "low_risk_count",
)


class TableProfile:
    """Privacy and quality of one table.

    ``with_accuracy=False`` leaves the outlier model out and takes every column to be
    accurate; nothing is then written and all results are lazy plans. Values of
    ``unique_columns`` are known to differ from row to row, which saves shuffling them.
    """

    def __init__(
        self,
        df: DataFrame,
        with_accuracy: bool = True,
        strict_strings: bool = False,
        unique_columns: tuple[str, ...] = (),
    ):
        self.df = df
        self.unique_columns = unique_columns
        self.with_accuracy = with_accuracy
        self.strict_strings = strict_strings
        self.fields = fields_of(df)

    @cached_property
    def columns(self) -> DataFrame:
        """Every measure of every column, from one scan and one frequency table.

        With the outlier model, one shuffle of the value frequencies yields the metrics
        and the samples the forests grow from; only these and the finished table, one row
        per column, are written.
        """
        if not self.with_accuracy:
            metrics = frequency_metrics(self.df, unique_columns=self.unique_columns)
            return self._columns(metrics, None)
        prepared = prepare(self.df)
        counts = frequency_counts(self.df, unique_columns=self.unique_columns)
        metrics = stage(metrics_from_counts(counts, self.fields, survivor(prepared)), "metrics")
        sample = metrics.select("column_ix", F.explode("sample").alias("drawn"))
        accuracy = outliers(self.df, prepared, sample)
        return stage(self._columns(metrics.drop("sample"), accuracy), "columns")

    def _columns(self, metrics: DataFrame, accuracy: DataFrame | None) -> DataFrame:
        counts = quality.per_cell_counts(scan_columns(self.df))
        joined = metrics.join(F.broadcast(counts), "column_ix")  # one row per column
        private = privacy.with_privacy(joined, self.strict_strings)
        # the quality dimension of the same name measures duplicates instead
        private = private.withColumnRenamed("uniqueness_score", "risk_uniqueness_score")
        return quality.with_quality(private, self.fields, accuracy, self.strict_strings)

    @cached_property
    def row_level(self) -> DataFrame:
        if not self.with_accuracy:
            return duplicate_rows(self.df)
        # a column without repeats and gaps rules out repeated rows: no need to shuffle them
        all_differ = F.col("distinct_count") == F.col("total_count")
        keys = self.columns.where(all_differ).select(
            F.col("total_count").alias("row_count"),
            F.lit(0).cast("bigint").alias("duplicate_rows"),
        )
        key = keys.limit(1)
        return stage(duplicate_rows(self.df), "duplicates") if key.isEmpty() else key

    def overall(self) -> DataFrame:
        """One row: the privacy and the quality summary, in one aggregation."""
        rows = quality.with_row_level(self.columns, self.row_level)
        return quality.with_overall(
            rows.agg(*privacy.summary_aggregates(), *quality.summary_aggregates())
        )

    def privacy_summary(self) -> DataFrame:
        return privacy.privacy_summary(self.columns)

    def quality_summary(self) -> DataFrame:
        return quality.quality_summary(self.columns, self.row_level)

    def quality_legacy(self) -> DataFrame:
        return quality.quality_legacy(self.columns)

    def assessment(self, name: str) -> DataFrame:
        scores = self.overall().select(
            F.lit(name).alias("dataset"), "overall_privacy_score", "overall_quality_score"
        )
        return assess.assess(scores)

    def report_row(self) -> DataFrame:
        """One row with everything a written report quotes."""
        row = assess.assess(self.overall())
        return row.withColumns(
            {
                "num_columns": F.lit(len(self.df.columns)),
                "column_names": F.lit(", ".join(self.df.columns)),
            }
        ).select(
            "num_rows",
            "num_columns",
            "column_names",
            "overall_privacy_score",
            "overall_quality_score",
            "high_risk_count",
            "medium_risk_count",
            "low_risk_count",
            F.col("completeness").alias("completeness_score"),
            F.col("accuracy").alias("accuracy_score"),
            F.col("consistency").alias("consistency_score"),
            F.col("uniqueness").alias("uniqueness_score"),
            F.col("validity").alias("validity_score"),
            "privacy_level",
            "quality_level",
            "recommendation",
        )

    def json_report(
        self, name: str, timestamp: str, constraints: list[dict] | None = None
    ) -> DataFrame:
        """One row: the nested report document as (report) JSON text."""

        samples = sample_lists(self.df).drop("column_name")
        columns = self.columns.join(samples, "column_ix", "left")
        # as many entries as the schema has columns
        listed = F.array_sort(F.collect_list(F.struct("column_ix", F.struct(*columns.columns))))
        rows = self.overall().unionByName(
            columns.agg(F.transform(listed, lambda c: c["col2"]).alias("columns")),
            allowMissingColumns=True,
        )
        if constraints:
            results = constraint_summary(apply_constraints(self.df, constraints))
            rows = rows.unionByName(
                results.select(F.struct("*").alias("constraints")), allowMissingColumns=True
            )
        # each row fills other columns
        document = rows.agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns])
        private = [c for c in PRIVATE if c in document.columns]
        sound = [*quality.WEIGHTS, "overall_quality_score", "duplicate_rows"]
        dataset = F.struct(
            F.lit(name).alias("name"),
            "num_rows",
            F.lit(len(self.fields)).alias("num_columns"),
            F.array(*[F.lit(f.name) for f in self.fields]).alias("columns"),
        )
        body = [
            F.lit("Data Privacy and Quality Analysis").alias("report_type"),
            F.lit(timestamp).alias("timestamp"),
            dataset.alias("dataset"),
            F.struct(*private).alias("privacy_analysis"),
            F.struct(*sound).alias("quality_analysis"),
            F.col("columns"),
            *([F.col("constraints")] if constraints else []),
        ]
        return document.select(F.to_json(F.struct(*body)).alias("report"))


def write_report(report: DataFrame, path: str, fmt: str) -> None:
    """Store a report as ``json`` (one document per line), ``parquet`` or a ``table``."""
    if fmt == "json":
        report.select("report").write.mode("overwrite").text(path)
    elif fmt == "parquet":
        report.write.mode("overwrite").parquet(path)
    elif fmt == "table":
        report.write.mode("overwrite").saveAsTable(path)
    else:
        raise ValueError(f"unsupported report format: {fmt}")
