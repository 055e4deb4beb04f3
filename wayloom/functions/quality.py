"""Scores as column expressions: saturating logs, shrinkage, weighted means of the signals that are there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PRIOR, REVIEW_CAP, NOTABILITY_CAP, EDITORIAL = 2.5, 1e3, 3e2, 3.5
WEIGHTS = {"places": 1.0, "editorial": 0.6, "notability": 0.6, "component": 0.8}
FLOOR, TOP = 3.0, 5.0


def log_share(n: Column, cap: float) -> Column:
    """clamp01(log10(1 + n) / log10(1 + cap))"""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.log10(F.lit(1.0) + n) / F.log10(F.lit(1.0) + F.lit(cap))))


def places_score(rating: Column, reviews: Column) -> Column:
    """A rating drawn to the prior by how few reviews it has; null outside 0..5."""
    return F.when(rating.between(0, 5), F.lit(PRIOR) + (rating - F.lit(PRIOR)) * log_share(reviews, REVIEW_CAP))


def notability_score(count: Column) -> Column:
    return F.when(count.isNotNull(), F.lit(2.5) + F.lit(2.0) * log_share(count, NOTABILITY_CAP))


def weighted_mean(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the values that aren't null, clamped to 0..5; null if none is there."""
    total = weight = None
    for value, w in parts:
        t, u = F.coalesce(value, F.lit(0.0)) * F.lit(w), F.when(value.isNull(), F.lit(0.0)).otherwise(F.lit(w))
        total, weight = (t, u) if total is None else (total + t, weight + u)
    any_ = F.coalesce(*[v for v, _ in parts]).isNotNull()
    return F.when(any_, F.least(F.lit(TOP), F.greatest(F.lit(0.0), total / weight)))


def final_quality(rating: Column, reviews: Column, notability: Column, editorial: Column) -> Column:
    return weighted_mean([
        (places_score(rating, reviews), WEIGHTS["places"]),
        (F.when(editorial, F.lit(EDITORIAL)), WEIGHTS["editorial"]),
        (notability_score(notability), WEIGHTS["notability"]),
    ])


def valid_quality(q: Column) -> Column:
    """The quality if it lies in 0..5 and is a number, else null."""
    return F.when(q.between(0, TOP) & ~F.isnan(q), q)
