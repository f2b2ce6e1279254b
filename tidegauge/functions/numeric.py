"""Scalar number helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def number(column: str | Column) -> Column:
    """Double value with NaN and unreadable text turned into null."""
    value = F.col(f"`{column}`") if isinstance(column, str) else column
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


def clip_int(value: Column, low: int, high: int) -> Column:
    """Round half to even, then clamp into [low, high]."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.rint(value))).cast("int")


def clip_float(value: Column, low: float, high: float | None = None) -> Column:
    """Clamp to a lower and, if given, an upper bound."""
    clipped = F.greatest(value.cast("double"), F.lit(float(low)))
    return clipped if high is None else F.least(clipped, F.lit(float(high)))


def threshold_class(probability: Column, threshold: float | Column) -> Column:
    """1 when the probability reaches the threshold (inclusive), else 0."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (probability >= limit).cast("int")


def clamp_score(value: Column, low: int = 1, high: int = 5) -> Column:
    """Score text or number truncated toward zero and clamped; unreadable gives ``low``."""
    parsed = F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))
    truncated = F.when(parsed < 0, F.ceil(parsed)).otherwise(F.floor(parsed))
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(truncated, F.lit(low)))).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))
