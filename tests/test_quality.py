import random

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import metrics, promotion

LABELS, SCORES = [1, 0, 1, 0, 0], [0.95, 0.30, 0.90, 0.20, 0.10]


def scored(spark, labels, scores):
    rows = [(i, y, float(s)) for i, (y, s) in enumerate(zip(labels, scores))]
    return spark.createDataFrame(rows, "id int, label int, score double")


def test_top_fraction_metrics(spark):
    row = metrics.top_fraction_metrics(scored(spark, LABELS, SCORES), recall_fraction=0.2, precision_fraction=0.2).first()
    assert (row["recall_at_top_k"], row["precision_at_top_k"]) == (0.5, 1.0)


def test_top_fraction_edge_cases(spark):
    none = metrics.top_fraction_metrics(scored(spark, [0, 0, 0], [0.1, 0.2, 0.3]), recall_fraction=0.4).first()
    assert (none["recall_at_top_k"], none["precision_at_top_k"]) == (0.0, 0.0)
    one = metrics.top_fraction_metrics(scored(spark, [0, 1, 0], [0.1, 0.9, 0.3]), precision_fraction=0.01).first()
    assert one["precision_at_top_k"] == 1.0
    empty = metrics.top_fraction_metrics(scored(spark, [], [])).first()
    assert empty is None or (empty["recall_at_top_k"], empty["precision_at_top_k"]) == (0.0, 0.0)
    for fraction in (0.0, 1.5):
        with pytest.raises(ValueError):
            metrics.top_fraction_metrics(scored(spark, LABELS, SCORES), recall_fraction=fraction)


def test_auc_with_ties_equals_pair_counting(spark):
    rng = random.Random(2)
    rows = [(m, i, rng.randint(0, 1), round(rng.random(), 1)) for m in ("a", "b", "c") for i in range(120)]
    data = spark.createDataFrame(rows, "model string, id int, label int, score double")
    got = {r["model"]: r["auc"] for r in metrics.auc(data, ["model"]).collect()}
    for m in ("a", "b", "c"):
        pos = [s for k, _, y, s in rows if k == m and y]
        neg = [s for k, _, y, s in rows if k == m and not y]
        pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
        assert got[m] == pytest.approx(pairs / (len(pos) * len(neg)))


def test_threshold_metrics_without_predictions(spark):
    row = metrics.threshold_metrics(scored(spark, [1, 0], [0.1, 0.2])).first()
    assert (row["accuracy"], row["precision"], row["recall"], row["f1"]) == (0.5, 0.0, 0.0, 0.0)


def model_rows(spark, **models):
    names = ("auc", "f1", "precision", "recall")
    rows = [(m, n, v) for m, values in models.items() for n, v in zip(names, values)]
    return spark.createDataFrame(rows, "model string, metric string, value double")


WEIGHTS = {"recall": 0.4, "precision": 0.2, "f1": 0.2, "auc": 0.2}
CASES = [
    ((0.87, 0.64, 0.63, 0.64), (0.88, 0.65, 0.63, 0.64), {"primary_metric": "auc", "minimum_improvement": 0.005}, "eligible", "challenger_auc_delta_meets_threshold"),
    ((0.87, 0.64, 0.62, 0.61), (0.89, 0.69, 0.67, 0.70), {"criteria": "criteria_best_general", "metric_weights": WEIGHTS, "minimum_improvement": 0.01}, "eligible", "challenger_weighted_score_delta_meets_threshold"),
    ((0.87, 0.64, 0.63, 0.64), (0.90, 0.70, 0.65, 0.58), {"criteria": "criteria_guardrails_plus_score", "metric_guardrails": {"recall": -0.02}}, "rejected", "challenger_failed_metric_guardrails"),
    ((0.87, 0.64, 0.63, 0.64), (0.872, 0.65, 0.63, 0.64), {"primary_metric": "auc", "minimum_improvement": 0.005}, "rejected", "challenger_auc_delta_below_threshold"),
]


@pytest.mark.parametrize("champion,challenger,rules,status,reason", CASES)
def test_promotion_cases(spark, champion, challenger, rules, status, reason):
    data = model_rows(spark, old=champion, new=challenger)
    row = promotion.decide_promotion(data, "old", promotion.Policy.from_rules(rules)).first()
    assert (row["challenger"], row["status"], row["reason"]) == ("new", status, reason)


def test_many_challengers_and_missing_metrics(spark):
    data = model_rows(spark, old=(0.8, 0.6, 0.6, 0.6), up=(0.9, 0.7, 0.7, 0.7), down=(0.7, 0.5, 0.5, 0.5))
    data = data.unionByName(spark.createDataFrame([("half", "auc", 0.99)], data.schema))
    got = {r["challenger"]: r["status"] for r in promotion.decide_promotion(data, "old").collect()}
    assert got == {"up": "eligible", "down": "rejected", "half": "invalid"}


def test_policy_errors():
    for rules in ({"criteria": "other"}, {"metric_weights": {"auc": -1.0}}, {"metric_weights": {"auc": 0.0}}):
        with pytest.raises(ValueError):
            promotion.Policy.from_rules(rules)


def test_best_and_comparison(spark):
    data = model_rows(spark, a=(0.8, 0.6, 0.5, 0.4), b=(0.8, 0.5, 0.6, 0.4))
    best = {(r["metric"], r["model"]) for r in metrics.best_per_metric(data).collect()}
    assert best == {("auc", "a"), ("auc", "b"), ("f1", "a"), ("precision", "b"), ("recall", "a"), ("recall", "b")}
    assert metrics.comparison(data, ["a", "b"]).where(F.col("metric") == "f1").first()["a"] == 0.6


def test_means_skip_nan(spark):
    data = spark.createDataFrame([(0.5, 1.0), (float("nan"), 0.0)], "x double, y double")
    got = {r["metric"]: (r["mean"], r["n_valid"], r["n_nan"]) for r in metrics.mean_scores(data, ["x", "y"]).collect()}
    assert got == {"x": (0.5, 1, 1), "y": (0.5, 2, 0)}
