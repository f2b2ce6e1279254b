"""Feature formulas as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Category orders and defaults of the encoder.
CARD_ORDER = ["SILVER", "GOLD", "PLATINUM", "DIAMOND"]
GENDER_ORDER = ["Female", "Male"]
COUNTRY_ORDER = ["France", "Germany", "Spain"]


def balance_per_product(balance: Column, products: Column) -> Column:
    """Balance over the number of products, zero products counted as one."""
    return balance / F.when(products == 0, F.lit(1)).otherwise(products)


def points_per_salary(points: Column, salary: Column) -> Column:
    """Points over salary plus one."""
    return points / (salary + F.lit(1.0))


def ordinal(value: Column, order: Sequence[str]) -> Column:
    """Zero-based place in the order; unknown and null give -1."""
    place = F.array_position(F.array(*[F.lit(v) for v in order]), value) - F.lit(1)
    return F.coalesce(place, F.lit(-1)).cast("double")


def one_hot(value: Column, categories: Sequence[str], prefix: str) -> dict[str, Column]:
    """0/1 columns for all categories but the first; unknown gives all zeros."""
    return {
        f"{prefix}{name}": F.coalesce((value == name).cast("double"), F.lit(0.0))
        for name in list(categories)[1:]
    }


def standardize(value: Column, mean: float | Column, deviation: float | Column) -> Column:
    """Centre and scale; a zero deviation counts as one."""
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    deviation = deviation if isinstance(deviation, Column) else F.lit(float(deviation))
    return (value.cast("double") - mean) / F.when(deviation == 0, F.lit(1.0)).otherwise(deviation)


def mapped_code(value: Column, codes: dict[str, int]) -> Column:
    """Code from a lookup; unmapped gives null."""
    pairs = [F.lit(x) for item in codes.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value).cast("double")
