"""Model quality and promotion over the fixed scores of the derived customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.catalog.base import (
    SCORE_WEIGHTS,
    long_scores,
    long_scores_sql,
    register,
    table,
)
from tidegauge.operators import metrics, promotion

_SCORES = long_scores_sql()
_THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7]

_CONFUSION_SQL = """conf AS (
  SELECT model, count(*) FILTER (score >= 0.5::DOUBLE AND label = 1) AS tp, count(*) FILTER (score >= 0.5::DOUBLE AND label = 0) AS fp,
         count(*) FILTER (score < 0.5::DOUBLE AND label = 1) AS fn, count(*) FILTER (score < 0.5::DOUBLE AND label = 0) AS tn
  FROM scores GROUP BY model),
rate AS (SELECT model, (tp + tn)::DOUBLE / (tp + fp + fn + tn) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision",
                coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM conf)"""
_AUC_SQL = """bins AS (SELECT model, score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scores GROUP BY ALL),
below AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM bins),
roc AS (SELECT model, sum(pos * (nb + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)) AS auc FROM below GROUP BY model)"""
_TOP_SQL = """placed AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, "CustomerId") AS rn,
         count(*) OVER (PARTITION BY model) AS n, sum(label) OVER (PARTITION BY model) AS p FROM scores),
tops AS (SELECT model, any_value(n) AS n, CAST(any_value(p) AS BIGINT) AS positives,
                sum(CASE WHEN label = 1 AND rn <= greatest(1, ceil(n * 0.25::DOUBLE)) THEN 1 ELSE 0 END)::DOUBLE / any_value(p) AS recall_at_top_k,
                sum(CASE WHEN label = 1 AND rn <= greatest(1, ceil(n * 0.2::DOUBLE)) THEN 1 ELSE 0 END)::DOUBLE
                  / greatest(1, ceil(any_value(n) * 0.2::DOUBLE)) AS precision_at_top_k
         FROM placed GROUP BY model)"""
_ALL_SQL = f"""{_SCORES}, {_CONFUSION_SQL}, {_AUC_SQL}, {_TOP_SQL},
wide AS (SELECT * FROM rate JOIN roc USING (model) JOIN tops USING (model)),
metric AS (
  SELECT model, 'accuracy' AS metric, accuracy AS value FROM wide UNION ALL SELECT model, 'auc', auc FROM wide
  UNION ALL SELECT model, 'f1', f1 FROM wide UNION ALL SELECT model, 'precision', "precision" FROM wide
  UNION ALL SELECT model, 'recall', recall FROM wide UNION ALL SELECT model, 'recall_at_top_k', recall_at_top_k FROM wide
  UNION ALL SELECT model, 'precision_at_top_k', precision_at_top_k FROM wide)"""


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return long_scores(spark, folder).withColumnRenamed("CustomerId", "id")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.evaluate(_scores(spark, folder))


def _six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@register(
    "confusion_metrics",
    f"""WITH {_SCORES}, {_CONFUSION_SQL}
SELECT model, 0.5::DOUBLE AS threshold, tp, fp, fn, tn, round(accuracy, 6) AS accuracy, round("precision", 6) AS "precision",
       round(recall, 6) AS recall, round(f1, 6) AS f1 FROM conf JOIN rate USING (model)""",
)
def confusion_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.threshold_metrics(_scores(spark, folder), keys=["model"])
    return _six(found, "accuracy", "precision", "recall", "f1")


@register(
    "threshold_sweep",
    f"""WITH {_SCORES}, ts AS (SELECT unnest([{", ".join(f"{t}::DOUBLE" for t in _THRESHOLDS)}]) AS threshold),
conf AS (SELECT model, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
                count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn
         FROM scores CROSS JOIN ts GROUP BY ALL)
SELECT *, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS "precision",
       round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1
FROM conf""",
)
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.threshold_metrics(_scores(spark, folder), _THRESHOLDS, ["model"])
    return _six(found, "accuracy", "precision", "recall", "f1")


@register("auc_exact", f"WITH {_SCORES}, {_AUC_SQL} SELECT model, round(auc, 6) AS auc FROM roc")
def auc_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _six(metrics.auc(_scores(spark, folder), ["model"]), "auc")


@register(
    "top_fraction_metrics",
    f"""WITH {_SCORES}, {_TOP_SQL}
SELECT model, n, positives, round(recall_at_top_k, 6) AS recall_at_top_k, round(precision_at_top_k, 6) AS precision_at_top_k FROM tops""",
)
def top_fraction_metrics(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.top_fraction_metrics(_scores(spark, folder), ["model"])
    return _six(found, "recall_at_top_k", "precision_at_top_k")


@register(
    "precision_at_top_length",
    """WITH joined AS (SELECT doc_id, quality AS label, n_chars AS score FROM labels JOIN documents USING (doc_id)),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rn, count(*) OVER () AS n, sum(label) OVER () AS p FROM joined)
SELECT any_value(n) AS n, CAST(any_value(p) AS BIGINT) AS positives,
       round(count(*) FILTER (label = 1 AND rn <= greatest(1, ceil(n * 0.25::DOUBLE)))::DOUBLE / any_value(p), 6) AS recall_at_top_k,
       round(count(*) FILTER (label = 1 AND rn <= greatest(1, ceil(n * 0.2::DOUBLE)))::DOUBLE / greatest(1, ceil(any_value(n) * 0.2::DOUBLE)), 6) AS precision_at_top_k
FROM placed""",
)
def precision_at_top_length(spark: SparkSession, folder: str) -> DataFrame:
    """Text length as a score for the quality label: one ranking without any key."""
    joined = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    found = metrics.top_fraction_metrics(
        joined, label="quality", score="n_chars", row_id="doc_id"
    )
    return _six(found, "recall_at_top_k", "precision_at_top_k")


@register("model_metrics", f"WITH {_ALL_SQL} SELECT model, metric, round(value, 6) AS value FROM metric")
def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _six(_metrics(spark, folder), "value")


@register(
    "model_comparison",
    f"""WITH {_ALL_SQL} SELECT metric, round(max(value) FILTER (model = 'champion'), 6) AS champion,
       round(max(value) FILTER (model = 'challenger'), 6) AS challenger, round(max(value) FILTER (model = 'third'), 6) AS third
FROM metric GROUP BY metric""",
)
def model_comparison(spark: SparkSession, folder: str) -> DataFrame:
    found = metrics.comparison(_metrics(spark, folder), list(SCORE_WEIGHTS))
    return _six(found, *SCORE_WEIGHTS)


@register(
    "best_model",
    f"""WITH {_ALL_SQL}, best AS (SELECT *, max(value) OVER (PARTITION BY metric) AS top FROM metric)
SELECT metric, model, round(value, 6) AS value FROM best WHERE abs(value - top) < 1e-6""",
)
def best_model(spark: SparkSession, folder: str) -> DataFrame:
    return _six(metrics.best_per_metric(_metrics(spark, folder)), "value")


_DELTA_SQL = """deltas AS (
  SELECT b.model AS challenger, b.metric, a.value AS champion_value, b.value AS challenger_value, b.value - a.value AS delta
  FROM metric a JOIN metric b USING (metric) WHERE a.model = 'champion' AND b.model <> 'champion')"""


@register(
    "metric_deltas",
    f"""WITH {_ALL_SQL}, {_DELTA_SQL}
SELECT challenger, metric, round(champion_value, 6) AS champion_value, round(challenger_value, 6) AS challenger_value,
       round(delta, 6) AS delta FROM deltas""",
)
def metric_deltas(spark: SparkSession, folder: str) -> DataFrame:
    found = promotion.metric_deltas(_metrics(spark, folder), "champion")
    return _six(found.select("challenger", "metric", "champion_value", "challenger_value", "delta"),
                "champion_value", "challenger_value", "delta")


_WEIGHTS_SQL = "weights AS (SELECT * FROM (VALUES ('recall', 0.35::DOUBLE), ('precision', 0.25::DOUBLE), ('f1', 0.25::DOUBLE), ('auc', 0.15::DOUBLE)) AS t(metric, w))"


@register(
    "weighted_score",
    f"""WITH {_ALL_SQL}, {_WEIGHTS_SQL}
SELECT model, round(sum(value * w) / sum(w), 6) AS weighted_score FROM metric JOIN weights USING (metric) GROUP BY model""",
)
def weighted_score(spark: SparkSession, folder: str) -> DataFrame:
    found = promotion.weighted_scores(_metrics(spark, folder), promotion.Policy().weights)
    return _six(found, "weighted_score").select("model", "weighted_score")


@register(
    "promotion_decision",
    f"""WITH {_ALL_SQL}, {_DELTA_SQL}, {_WEIGHTS_SQL},
summary AS (
  SELECT challenger, sum(challenger_value * w) / sum(w) - sum(champion_value * w) / sum(w) AS score_delta,
         bool_and(CASE WHEN metric IN ('recall', 'precision') THEN delta >= -0.02::DOUBLE ELSE TRUE END) AS passed
  FROM deltas JOIN weights USING (metric) GROUP BY challenger)
SELECT 'champion' AS champion, challenger, 'criteria_guardrails_plus_score' AS criteria,
       CASE WHEN passed AND score_delta >= 0.005::DOUBLE THEN 'eligible' ELSE 'rejected' END AS status,
       CASE WHEN NOT passed THEN 'challenger_failed_metric_guardrails'
            WHEN score_delta >= 0.005::DOUBLE THEN 'challenger_guardrails_passed_and_score_delta_meets_threshold'
            ELSE 'challenger_guardrails_passed_but_score_delta_below_threshold' END AS reason,
       CASE WHEN passed AND score_delta >= 0.005::DOUBLE THEN 'manual_review_for_promotion' ELSE 'retain_current_champion' END AS recommended_action,
       passed AS guardrails_passed, round(score_delta, 6) AS score_delta
FROM summary""",
)
def promotion_decision(spark: SparkSession, folder: str) -> DataFrame:
    found = promotion.decide_promotion(_metrics(spark, folder), "champion")
    return _six(found, "score_delta").select(
        "champion", "challenger", "criteria", "status", "reason", "recommended_action",
        "guardrails_passed", "score_delta",
    )
