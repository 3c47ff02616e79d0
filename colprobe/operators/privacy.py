"""Privacy risk of columns and datasets.

Column tables have one row per column and are therefore never larger than the schema is
wide; joining two of them broadcasts one side for that reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.functions.patterns import PATTERNS
from colprobe.functions.types import fields_of
from colprobe.operators.frequencies import frequency_metrics
from colprobe.operators.scan import scan_columns

# Weights of the risk score and the share of missing cells above which
# a column is left out.
UNIQUENESS_WEIGHT = 0.7
SENSITIVE_WEIGHT = 0.3
MOSTLY_MISSING = 0.5

# Level names, description and action per level.
RISK_LEVELS = {
    "High Risk": (
        "Your data contains sensitive information that needs protection.",
        "Apply masking or anonymization to high-risk fields before sharing.",
    ),
    "Medium Risk": (
        "Your data has some privacy concerns to address.",
        "Review medium-risk fields and consider privacy-enhancing techniques.",
    ),
    "Low Risk": (
        "Your data appears to have good privacy protection.",
        "Continue with your current anonymization approach.",
    ),
}

# Advice per risk level, in order.
ADVICE = {
    "High Risk": [
        "Apply data masking or tokenization to personally identifiable information",
        "Consider aggregating or generalizing sensitive fields",
        "Remove unique identifiers or replace with category values",
        "Implement k-anonymity to prevent re-identification",
        "Obtain explicit consent before sharing this dataset",
    ],
    "Medium Risk": [
        "Review and transform high-risk fields to reduce identifiability",
        "Consider data generalization techniques (e.g., age ranges instead of exact ages)",
        "Document privacy measures taken for data sharing compliance",
        "Implement access controls when sharing this dataset",
    ],
    "Low Risk": [
        "Document the privacy-preserving measures already in place",
        "Maintain current anonymization levels in future updates",
        "Consider periodic re-assessment if data structure changes",
    ],
}


def share(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """``part / whole``, or ``empty`` for nothing at all."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def mostly_missing() -> Column:
    return share(F.col("missing_count"), F.col("total_count")) > MOSTLY_MISSING


def names_where(condition: Column) -> Column:
    """Aggregate: names of the columns meeting a condition, in schema order, as text."""
    hits = F.collect_list(F.when(condition, F.struct("column_ix", "column_name")))
    return F.array_join(F.transform(F.array_sort(hits), lambda c: c["column_name"]), ", ")


# --- uniqueness ---------------------------------------------------------------


def uniqueness_score() -> Column:
    return F.least(F.lit(1.0), share(F.col("distinct_count"), F.col("total_count")))


def uniqueness_risk(df: DataFrame) -> DataFrame:
    return frequency_metrics(df).select(
        "column_ix", "column_name", uniqueness_score().alias("uniqueness_score")
    )


# --- personal data --------------------------------------------------------------


def pii_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cells matched per pattern, for each string column."""
    texts = [f.name for f in fields_of(df, columns) if f.is_string]
    return scan_columns(df, texts, measures=("patterns",)).select(
        "column_ix", "column_name", "total_count", *PATTERNS
    )


def with_sensitivity(scanned: DataFrame, strict_strings: bool = False) -> DataFrame:
    """Add the sensitive-data score and the list of pattern names found.

    A cell counts once per pattern it matches. ``strict_strings`` ignores string columns
    that have missing cells.
    """
    usable = F.col("missing_count") == 0 if strict_strings else F.lit(True)
    hits = {name: F.when(usable, F.coalesce(F.col(name), F.lit(0))).otherwise(0) for name in PATTERNS}
    total_hits = sum(hits.values(), F.lit(0))
    found = F.array_compact(F.array(*[F.when(n > 0, F.lit(name)) for name, n in hits.items()]))
    score = F.least(F.lit(1.0), share(total_hits, F.col("total_count")))
    return scanned.withColumns(
        {
            "sensitive_data_score": F.when(mostly_missing(), F.lit(0.0)).otherwise(score),
            "sensitivity_type": F.when(
                mostly_missing() | (F.size(found) == 0), F.lit("None")
            ).otherwise(F.array_join(found, ", ")),
        }
    )


def sensitivity(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    scanned = scan_columns(df, measures=("patterns",))
    return with_sensitivity(scanned, strict_strings).select(
        "column_ix", "column_name", "sensitive_data_score", "sensitivity_type"
    )


# --- information measures ---------------------------------------------------------


def hartley(log_base: float = 10) -> Column:
    distinct = F.col("distinct_count")
    return F.when(distinct > 1, F.log(float(log_base), distinct)).otherwise(F.lit(0.0))


def privacy_factor(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return frequency_metrics(df, columns).select("column_ix", "column_name", "privacy_factor")


def shannon_entropy(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    return frequency_metrics(df, columns).select("column_ix", "column_name", "shannon_entropy")


def hartley_measure(
    df: DataFrame, columns: list[str] | None = None, log_base: float = 10
) -> DataFrame:
    return frequency_metrics(df, columns).select(
        "column_ix", "column_name", hartley(log_base).alias("hartley_measure")
    )


def with_entropy(metrics: DataFrame) -> DataFrame:
    """The three information measures of a metrics table, mostly missing columns neutral."""
    skip = mostly_missing()
    return metrics.withColumns(
        {
            "hartley_measure": F.when(skip, F.lit(0.0)).otherwise(hartley()),
            "privacy_factor": F.when(skip, F.lit(1.0)).otherwise(F.col("privacy_factor")),
            "shannon_entropy": F.when(skip, F.lit(0.0)).otherwise(F.col("shannon_entropy")),
        }
    )


def entropy_profile(df: DataFrame) -> DataFrame:
    return with_entropy(frequency_metrics(df)).select(
        "column_ix", "column_name", "privacy_factor", "shannon_entropy", "hartley_measure"
    )


def cumulative_factor(profile: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """One row: product of the columns' privacy factors; unknown names are ignored."""
    if selected is not None:
        profile = profile.where(F.col("column_name").isin(list(selected)))
    product = F.coalesce(F.product("privacy_factor"), F.lit(1.0))
    return profile.agg(product.alias("overall_privacy_factor"))


def entropy_summary(profile: DataFrame) -> DataFrame:
    """One row: cumulative factor, averages and the factor buckets."""
    factor = F.col("privacy_factor")
    return profile.agg(
        F.coalesce(F.product("privacy_factor"), F.lit(1.0)).alias("overall_privacy_factor"),
        F.coalesce(F.avg("privacy_factor"), F.lit(0.0)).alias("avg_privacy_factor"),
        F.coalesce(F.avg("shannon_entropy"), F.lit(0.0)).alias("avg_shannon_entropy"),
        F.coalesce(F.avg("hartley_measure"), F.lit(0.0)).alias("avg_hartley_measure"),
        names_where(factor < 0.3).alias("high_risk_columns"),
        names_where((factor >= 0.3) & (factor < 0.7)).alias("medium_risk_columns"),
        names_where(factor >= 0.7).alias("low_risk_columns"),
    )


def factor_buckets(profile: DataFrame) -> DataFrame:
    return entropy_summary(profile).select(
        "high_risk_columns", "medium_risk_columns", "low_risk_columns"
    )


# --- combined risk ----------------------------------------------------------------


def with_risk(metrics: DataFrame) -> DataFrame:
    """Add uniqueness and the weighted risk score to joined frequency and scan metrics."""
    unique = F.when(mostly_missing(), F.lit(0.0)).otherwise(uniqueness_score())
    risk = F.lit(UNIQUENESS_WEIGHT) * F.col("uniqueness_score") + F.lit(SENSITIVE_WEIGHT) * F.col(
        "sensitive_data_score"
    )
    return metrics.withColumn("uniqueness_score", unique).withColumn("privacy_risk_score", risk)


def privacy_profile(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    """Risk and information measures of every column, one row each."""
    return profile_from(frequency_metrics(df), scan_columns(df, measures=("patterns",)), strict_strings)


def profile_from(
    metrics: DataFrame, scanned: DataFrame, strict_strings: bool = False
) -> DataFrame:
    hits = scanned.drop("column_name", "type_class", "total_count", "missing_count", "value_count")
    joined = metrics.join(F.broadcast(hits), "column_ix")  # one row per column
    return with_privacy(joined, strict_strings).select(
        "column_ix",
        "column_name",
        "privacy_risk_score",
        "uniqueness_score",
        "sensitive_data_score",
        "sensitivity_type",
        "privacy_factor",
        "shannon_entropy",
        "hartley_measure",
    )


def with_privacy(joined: DataFrame, strict_strings: bool = False) -> DataFrame:
    """All privacy measures of rows holding both frequency metrics and scan counts."""
    return with_risk(with_entropy(with_sensitivity(joined, strict_strings)))


def privacy_risk(df: DataFrame, strict_strings: bool = False) -> DataFrame:
    return privacy_profile(df, strict_strings).select(
        "column_ix",
        "column_name",
        "privacy_risk_score",
        "uniqueness_score",
        "sensitive_data_score",
        "sensitivity_type",
    )


def risk_category(score: Column) -> Column:
    return (
        F.when(score > 0.7, F.lit("High Risk"))
        .when(score > 0.3, F.lit("Medium Risk"))
        .otherwise(F.lit("Low Risk"))
    )


def privacy_summary(profile: DataFrame) -> DataFrame:
    """One row for the dataset: mean risk, information averages and risk buckets."""
    return profile.agg(*summary_aggregates())


def summary_aggregates() -> list[Column]:
    risk = F.col("privacy_risk_score")
    return [
        F.coalesce(F.avg("privacy_risk_score"), F.lit(0.0)).alias("overall_privacy_score"),
        F.coalesce(F.product("privacy_factor"), F.lit(1.0)).alias("overall_privacy_factor"),
        F.coalesce(F.avg("shannon_entropy"), F.lit(0.0)).alias("avg_shannon_entropy"),
        F.coalesce(F.avg("hartley_measure"), F.lit(0.0)).alias("avg_hartley_measure"),
        names_where(risk > 0.7).alias("high_risk_columns"),
        names_where((risk > 0.3) & (risk <= 0.7)).alias("medium_risk_columns"),
        names_where(risk <= 0.3).alias("low_risk_columns"),
        F.count("column_ix").alias("total_columns"),
        F.count_if(risk > 0.7).alias("high_risk_count"),
        F.count_if((risk > 0.3) & (risk <= 0.7)).alias("medium_risk_count"),
        F.count_if(risk <= 0.3).alias("low_risk_count"),
    ]


def with_risk_category(profile: DataFrame) -> DataFrame:
    return profile.withColumn("risk_category", risk_category(F.col("privacy_risk_score")))


def dataset_risk_level(summary: DataFrame) -> DataFrame:
    """One row: level, description and recommended action for the dataset."""
    level = F.col("risk_level")

    def text(position: int) -> Column:
        chosen = F.lit(RISK_LEVELS["Low Risk"][position])
        for name in ("Medium Risk", "High Risk"):
            chosen = F.when(level == name, F.lit(RISK_LEVELS[name][position])).otherwise(chosen)
        return chosen

    return summary.withColumn("risk_level", risk_category(F.col("overall_privacy_score"))).select(
        "overall_privacy_score",
        "risk_level",
        text(0).alias("risk_description"),
        text(1).alias("risk_action"),
    )


def risk_distribution(summary: DataFrame) -> DataFrame:
    """Three rows: columns per level and their percentage of all columns."""
    total = F.col("total_columns")
    levels = [("High Risk", "high"), ("Medium Risk", "medium"), ("Low Risk", "low")]
    rows = [
        F.struct(
            F.lit(level).alias("risk_category"),
            F.col(f"{key}_risk_count").alias("column_count"),
            (share(F.col(f"{key}_risk_count"), total) * 100).alias("column_percent"),
        )
        for level, key in levels
    ]
    return summary.select(F.inline(F.array(*rows)))


def risk_advice(df_with_level: DataFrame) -> DataFrame:
    """Unfold the advice items for each row's ``risk_level``."""
    level = F.col("risk_level")
    items = F.array(*[F.lit(text) for text in ADVICE["Low Risk"]])
    for name in ("Medium Risk", "High Risk"):
        items = F.when(level == name, F.array(*[F.lit(t) for t in ADVICE[name]])).otherwise(items)
    return df_with_level.select("risk_level", F.posexplode(items).alias("ord", "advice")).select(
        "risk_level", (F.col("ord") + 1).alias("ord"), "advice"
    )


def ranked_columns(profile: DataFrame, *metrics: str) -> DataFrame:
    """(metric, rank, column_name, score): columns by each metric, largest first.

    Scores equal to nine places tie, since the last bits of a sum depend on its order;
    ties keep schema order. A window holds one row per column.
    """
    pairs = [piece for m in metrics for piece in (F.lit(m), F.col(m))]
    scores = F.stack(F.lit(len(metrics)), *pairs).alias("metric", "score")
    order = W.partitionBy("metric").orderBy(F.desc(F.round("score", 9)), F.asc("column_ix"))
    return profile.select("column_ix", "column_name", scores).select(
        "metric", F.row_number().over(order).alias("rank"), "column_name", "score"
    )


def high_risk_columns(profile: DataFrame) -> DataFrame:
    return profile.where(F.col("privacy_risk_score") > 0.7).select(
        "column_name", "privacy_risk_score", "sensitivity_type"
    )
