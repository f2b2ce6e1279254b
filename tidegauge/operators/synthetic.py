"""Bootstrap batches of any size and drift presets, as functions of row number and seed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.hashing import choice, integer_draw, normal, uniform
from tidegauge.functions.numeric import clip_float, clip_int
from tidegauge.operators.ranking import dense_index

DRAW = "draw_id"


def bootstrap(base: DataFrame, order_by: list[Column], n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows drawn with replacement; ``draw_id`` numbers them from 0.

    The drawn positions are joined to the densely indexed base, so the result
    does not depend on how either side is partitioned.
    """
    spark = base.sparkSession
    indexed = dense_index(base, order_by, "_position")
    size = base.count()
    if size == 0:
        raise ValueError("nothing to draw from")
    draws = spark.range(n).select(
        F.col("id").alias(DRAW),
        F.floor(uniform(F.col("id"), seed, "bootstrap") * F.lit(size)).cast("long").alias("_position"),
    )
    return draws.join(indexed, "_position").drop("_position")


# N(mean, deviation) in [low, high], integer ranges and weighted
# choices per scenario. A 'mixture' is a choice plus normal noise.
Preset = dict[str, tuple]
PRESETS: dict[str, Preset] = {
    "baseline_like": {},
    "age_drift": {
        "Age": ("int_normal", 72, 8, 58, 92),
        "Tenure": ("integers", 0, 3),
        "Geography": ("choice", [("Germany", 2 / 3), ("Spain", 1 / 3)]),
    },
    "wealth_drift": {
        "Balance": ("normal", 135_000, 25_000, 20_000, None),
        "EstimatedSalary": ("normal", 165_000, 30_000, 30_000, None),
        "Card Type": ("choice", [("GOLD", 1 / 3), ("PLATINUM", 1 / 3), ("DIAMOND", 1 / 3)]),
        "Point Earned": ("int_normal", 780, 120, 300, 1000),
    },
    "high_risk_prediction_drift": {
        "CreditScore": ("int_normal", 390, 45, 300, 560),
        "Age": ("int_normal", 67, 9, 45, 92),
        "Tenure": ("integers", 0, 2),
        "Balance": ("normal", 12_000, 9_000, 0, None),
        "NumOfProducts": ("choice", [(1, 0.7), (4, 0.3)]),
        "IsActiveMember": ("choice", [(0, 1.0)]),
        "EstimatedSalary": ("normal", 32_000, 12_000, 1_000, None),
        "Card Type": ("choice", [("SILVER", 0.5), ("GOLD", 0.5)]),
        "Point Earned": ("int_normal", 180, 55, 0, 400),
    },
    "mixed_extreme_drift": {
        "CreditScore": ("int_normal", 430, 110, 300, 850),
        "Age": ("int_normal", 74, 11, 30, 95),
        "Balance": ("mixture", [(0.0, 0.55), (180_000.0, 0.45)], 8_000, 0, None),
        "NumOfProducts": ("choice", [(1, 0.2), (3, 0.35), (4, 0.45)]),
        "IsActiveMember": ("choice", [(0, 0.8), (1, 0.2)]),
        "EstimatedSalary": ("mixture", [(18_000.0, 0.6), (190_000.0, 0.4)], 9_000, 1_000, None),
        "Geography": ("choice", [("Germany", 0.7), ("Spain", 0.3)]),
        "Card Type": ("choice", [("SILVER", 0.6), ("DIAMOND", 0.4)]),
        "Point Earned": ("int_mixture", [(90.0, 0.65), (920.0, 0.35)], 30, 0, 1000),
    },
}
SCENARIOS = list(PRESETS)
BATCH_ROWS = 60


def _value(row: Column, seed: int, name: str, rule: tuple) -> Column:
    kind, *args = rule
    makers: dict[str, Callable[..., Column]] = {
        "normal": lambda m, s, lo, hi: clip_float(normal(row, seed, name, m, s), lo, hi),
        "int_normal": lambda m, s, lo, hi: clip_int(normal(row, seed, name, m, s), lo, hi),
        "integers": lambda lo, hi: integer_draw(row, seed, name, lo, hi),
        "choice": lambda options: choice(row, seed, name, options),
        "mixture": lambda options, s, lo, hi: clip_float(
            choice(row, seed, name, options) + normal(row, seed, name + ":noise", 0, s), lo, hi
        ),
        "int_mixture": lambda options, s, lo, hi: clip_int(
            choice(row, seed, name, options) + normal(row, seed, name + ":noise", 0, s), lo, hi
        ),
    }
    return makers[kind](*args)


def perturb(batch: DataFrame, scenario: str, seed: int = 42, row_id: str = DRAW) -> DataFrame:
    """Overwrite the columns of a scenario; their types and all other columns stay."""
    if scenario not in PRESETS:
        raise ValueError(f"unknown scenario {scenario!r}; known: {', '.join(SCENARIOS)}")
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    changed = {
        name: _value(F.col(row_id), seed, f"{scenario}:{name}", rule).cast(kinds[name])
        for name, rule in PRESETS[scenario].items()
    }
    return batch.withColumns(changed) if changed else batch


def scenario_batch(
    base: DataFrame, order_by: list[Column], scenario: str, n: int = BATCH_ROWS, seed: int = 42
) -> DataFrame:
    """Bootstrap and perturb; each scenario draws with its own seed."""
    own = seed + SCENARIOS.index(scenario) if scenario in SCENARIOS else seed
    return perturb(bootstrap(base, order_by, n, own), scenario, own)


def prediction_batch(
    base: DataFrame, order_by: list[Column], n: int, drift: bool, seed: int = 42
) -> DataFrame:
    """Inputs of the prediction generator: like the base, or the extreme mixture."""
    scenario = "mixed_extreme_drift" if drift else "baseline_like"
    return perturb(bootstrap(base, order_by, n, seed), scenario, seed)
