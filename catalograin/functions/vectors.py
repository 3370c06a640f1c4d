"""Vector similarity and its grading, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Relevance grades: a floor, and how far below the best score. (Fixed values.)
HIGH_FLOOR, HIGH_GAP = 0.35, 0.08
MEDIUM_FLOOR, MEDIUM_GAP = 0.25, 0.18


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    """Cosine similarity with a fixed vector; null without a vector or for one of zeros."""
    fixed = F.array(*(F.lit(float(x)) for x in query))
    length = F.sqrt(dot(vector, vector)) * F.sqrt(F.lit(sum(float(x) ** 2 for x in query)))
    return F.when(length > 0, dot(vector, fixed) / length)


def relevance(score: Column, best: Column) -> Column:
    """`high`, `medium` or `low`, relative to the best score and above fixed floors; no score is low."""
    return (
        F.when(score >= F.greatest(F.lit(HIGH_FLOOR), best - HIGH_GAP), "high")
        .when(score >= F.greatest(F.lit(MEDIUM_FLOOR), best - MEDIUM_GAP), "medium")
        .otherwise("low")
    )


def relevance_within(score: Column, *groups: str) -> Column:
    """Relevance with the best score of each group's rows."""
    return relevance(score, F.max(score).over(Window.partitionBy(*groups)))
