"""Similarity, calibrated score and tier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Similarities closer than this are one rank, ordered by id. Single-precision
# vectors carry fewer digits than this, so only noise in the sums is removed.
RANK_DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine within [-1, 1]; null for a zero vector or unequal lengths."""
    ratio = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))
    # least() and greatest() skip nulls, so null has to be kept by hand.
    return F.when(ratio.isNotNull(), bounded)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def unrounded_score(similarity: Column) -> Column:
    scaled = (similarity - 0.2) / 0.6 * 100
    return F.least(F.greatest(scaled, F.lit(0.0)), F.lit(100.0))


def match_score(similarity: Column) -> Column:
    """0 to 100 with one decimal."""
    return F.round(unrounded_score(similarity), 1)


def confidence_tier(similarity: Column) -> Column:
    """Tier of the score before rounding, so 69.98 shows as 70.0 yet stays Moderate."""
    score = unrounded_score(similarity)
    return (
        F.when(score >= 70, "High Match")
        .when(score >= 40, "Moderate Match")
        .otherwise("Low Match")
    )
