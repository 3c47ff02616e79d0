"""Decision tables over the privacy and quality summaries, and the report row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of the combined recommendation.
RISKY_AND_POOR = (
    "This dataset presents significant privacy risks and poor data quality. "
    "Consider substantial revisions before sharing."
)
RISKY_BUT_GOOD = (
    "While the data quality is good, the high privacy risk requires mitigation measures "
    "before sharing."
)
SAFE_BUT_POOR = (
    "The data has low privacy risk but poor quality. Focus on improving data quality "
    "before sharing."
)
SAFE_AND_GOOD = (
    "This dataset has both low privacy risk and good quality, making it suitable for "
    "sharing with minimal changes."
)
IN_BETWEEN = (
    "Consider addressing both privacy and quality aspects before sharing this dataset."
)


def level(score: Column, low: str, middle: str, high: str) -> Column:
    """Below 0.4, below 0.7, or above."""
    return F.when(score < 0.4, F.lit(low)).when(score < 0.7, F.lit(middle)).otherwise(F.lit(high))


def privacy_level(score: Column) -> Column:
    return level(score, "low", "medium", "high")


def quality_level(score: Column) -> Column:
    return level(score, "poor", "moderate", "good")


def combined_recommendation(privacy: Column, quality: Column) -> Column:
    risky, safe = privacy > 0.7, privacy < 0.4
    good, poor = quality > 0.7, quality < 0.4
    return (
        F.when(risky & poor, F.lit(RISKY_AND_POOR))
        .when(risky & good, F.lit(RISKY_BUT_GOOD))
        .when(safe & poor, F.lit(SAFE_BUT_POOR))
        .when(safe & good, F.lit(SAFE_AND_GOOD))
        .otherwise(F.lit(IN_BETWEEN))
    )


def assess(scores: DataFrame) -> DataFrame:
    """Add levels and the recommendation to rows with both overall scores."""
    privacy, quality = F.col("overall_privacy_score"), F.col("overall_quality_score")
    return scores.withColumns(
        {
            "privacy_level": privacy_level(privacy),
            "quality_level": quality_level(quality),
            "recommendation": combined_recommendation(privacy, quality),
        }
    )
