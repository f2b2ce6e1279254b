"""Vector helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    """Euclidean length, never below 1e-12."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    length = F.sqrt(squares)
    return F.when(length == 0, F.lit(1e-12)).otherwise(length)


def l2_normalize(vector: Column) -> Column:
    """Vector of length one; the zero vector stays zero."""
    length = norm(vector)
    return F.transform(vector, lambda x: x.cast("double") / length)


def hybrid_score(vector_score: Column, lexical_score: Column, lexical_weight: float = 0.15) -> Column:
    """Weighted sum of vector and lexical score."""
    return F.lit(1.0 - lexical_weight) * vector_score + F.lit(lexical_weight) * lexical_score
