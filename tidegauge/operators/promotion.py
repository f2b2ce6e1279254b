"""Champion against challengers: deltas, weighted score, guardrails, decision."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

SINGLE, GENERAL, GUARDED = (
    "criteria_best_single_metric",
    "criteria_best_general",
    "criteria_guardrails_plus_score",
)


@dataclass(frozen=True)
class Policy:
    """The default promotion policy."""

    criteria: str = GUARDED
    primary_metric: str = "auc"
    minimum_improvement: float = 0.005
    weights: dict[str, float] = field(
        default_factory=lambda: {"recall": 0.35, "precision": 0.25, "f1": 0.25, "auc": 0.15}
    )
    guardrails: dict[str, float] = field(default_factory=lambda: {"recall": -0.02, "precision": -0.02})

    def __post_init__(self):
        if self.criteria not in (SINGLE, GENERAL, GUARDED):
            raise ValueError(f"unknown promotion criteria {self.criteria!r}")
        if not self.weights:
            raise ValueError("metric weights must not be empty")
        negative = {k: v for k, v in self.weights.items() if v < 0}
        if negative:
            raise ValueError(f"metric weights must not be negative: {negative}")
        if not any(v > 0 for v in self.weights.values()):
            raise ValueError("at least one positive weight is needed")

    @classmethod
    def from_rules(cls, rules: dict | None) -> Policy:
        """Policy from a rule mapping; a lone primary metric selects the single-metric criterion."""
        rules = dict(rules or {})
        lone = "primary_metric" in rules and not {"metric_weights", "metric_guardrails"} & rules.keys()
        given = {
            "criteria": str(rules.get("criteria", SINGLE if lone else GUARDED)),
            "primary_metric": str(rules.get("primary_metric", "auc")),
            "minimum_improvement": float(rules.get("minimum_improvement", 0.005)),
        }
        if rules.get("metric_weights"):
            given["weights"] = {str(k): float(v) for k, v in rules["metric_weights"].items()}
        if rules.get("metric_guardrails") is not None:
            given["guardrails"] = {str(k): float(v) for k, v in rules["metric_guardrails"].items()}
        return cls(**given)


def metric_deltas(metrics: DataFrame, champion: str) -> DataFrame:
    """Challenger minus champion for the metrics both have."""
    mine = metrics.where(F.col("model") == champion).select("metric", F.col("value").alias("champion_value"))
    theirs = metrics.where(F.col("model") != champion).select(
        F.col("model").alias("challenger"), "metric", F.col("value").alias("challenger_value")
    )
    return theirs.join(mine, "metric").withColumn(
        "delta", F.col("challenger_value") - F.col("champion_value")
    )


def _lookup(values: dict[str, float]) -> Column:
    name = F.col("metric")
    found = F.lit(None).cast("double")
    for metric, value in values.items():
        found = F.when(name == metric, F.lit(float(value))).otherwise(found)
    return found


def weighted_scores(metrics: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of each model's metrics, with the weighted metrics it lacks."""
    positive = {k: v for k, v in weights.items() if v > 0}
    weight = _lookup(positive)
    wanted = F.array(*[F.lit(k) for k in sorted(positive)])
    return metrics.groupBy("model").agg(
        (F.sum(F.col("value") * weight) / F.lit(float(sum(positive.values())))).alias("weighted_score"),
        F.array_except(wanted, F.collect_set("metric")).alias("missing_metrics"),
    )


def decide_promotion(metrics: DataFrame, champion: str, policy: Policy = Policy()) -> DataFrame:
    """One auditable decision per challenger, for any number of challengers at once.

    A challenger that lacks a needed metric gets status 'invalid' and the names
    of what is missing, so that one incomplete model does not stop the others.
    """
    positive = {k: v for k, v in policy.weights.items() if v > 0}
    total = float(sum(positive.values()))
    weight, floor = _lookup(positive), _lookup(policy.guardrails)
    needed = F.array(
        *[F.lit(m) for m in sorted({policy.primary_metric, *positive, *policy.guardrails})]
    )
    deltas = metric_deltas(metrics, champion)
    passed = F.col("delta") >= floor
    primary = F.col("metric") == policy.primary_metric

    def only_primary(column: str):
        return F.max(F.when(primary, F.col(column)))

    summary = deltas.groupBy("challenger").agg(
        only_primary("champion_value").alias("champion_primary"),
        only_primary("challenger_value").alias("challenger_primary"),
        only_primary("delta").alias("primary_delta"),
        (F.sum(F.col("champion_value") * weight) / total).alias("champion_score"),
        (F.sum(F.col("challenger_value") * weight) / total).alias("challenger_score"),
        F.coalesce(F.bool_and(F.when(floor.isNotNull(), passed)), F.lit(True)).alias("guardrails_passed"),
        F.map_from_entries(
            F.array_sort(
                F.collect_list(
                    F.when(
                        floor.isNotNull(),
                        F.struct(
                            F.col("metric"),
                            F.struct(
                                floor.alias("minimum_delta"),
                                F.col("delta").alias("observed_delta"),
                                passed.alias("passed"),
                            ),
                        ),
                    )
                )
            )
        ).alias("guardrail_results"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "delta")))).alias("metric_deltas"),
        F.array_except(needed, F.collect_set("metric")).alias("missing_metrics"),
    )
    scored = summary.withColumn("score_delta", F.col("challenger_score") - F.col("champion_score"))
    gain = F.col("primary_delta") if policy.criteria == SINGLE else F.col("score_delta")
    enough = gain >= F.lit(policy.minimum_improvement)
    guarded = F.col("guardrails_passed") if policy.criteria == GUARDED else F.lit(True)
    complete = F.size("missing_metrics") == 0

    # Reason codes.
    if policy.criteria == SINGLE:
        name = policy.primary_metric
        reason = F.when(enough, f"challenger_{name}_delta_meets_threshold").otherwise(
            f"challenger_{name}_delta_below_threshold"
        )
    elif policy.criteria == GENERAL:
        reason = F.when(enough, "challenger_weighted_score_delta_meets_threshold").otherwise(
            "challenger_weighted_score_delta_below_threshold"
        )
    else:
        reason = (
            F.when(~guarded, "challenger_failed_metric_guardrails")
            .when(enough, "challenger_guardrails_passed_and_score_delta_meets_threshold")
            .otherwise("challenger_guardrails_passed_but_score_delta_below_threshold")
        )
    eligible = complete & guarded & enough
    return scored.withColumns(
        {
            "champion": F.lit(champion),
            "criteria": F.lit(policy.criteria),
            "eligible_for_promotion": F.coalesce(eligible, F.lit(False)),
            "status": F.when(~complete, "invalid").when(eligible, "eligible").otherwise("rejected"),
            "recommended_action": F.when(eligible, "manual_review_for_promotion").otherwise(
                "retain_current_champion"
            ),
            "reason": F.when(complete, reason).otherwise("metrics_missing"),
        }
    )
