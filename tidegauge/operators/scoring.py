"""Model catalogue, training, batch scoring, inference records and scenarios."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge import schemas
from tidegauge.functions import text as tx
from tidegauge.functions.numeric import threshold_class
from tidegauge.operators import boosting, contracts, featurestore
from tidegauge.operators.forest import Forest
from tidegauge.session import spread

NEG_POS_RATIO = "__neg_pos_ratio__"


@dataclass(frozen=True)
class Experiment:
    """One model to train."""

    name: str
    algorithm: str
    version: str = "0.0.0"
    params: Mapping[str, object] = field(default_factory=dict)
    threshold: float = 0.5


# How parameter names of the experiment files map onto the estimators.
_BOOSTED = {"n_estimators": "rounds", "learning_rate": "rate", "max_depth": "depth", "subsample": "row_share",
            "random_state": "seed"}
_NAMES = {
    "gradient_boosting": {**_BOOSTED, "min_samples_leaf": "least_leaf_rows", "min_samples_split": "least_split_rows",
                          "max_features": "split_features"},
    "xgboost": {**_BOOSTED, "colsample_bytree": "tree_features", "min_child_weight": "least_hessian",
                "gamma": "least_gain", "reg_alpha": "l1", "reg_lambda": "l2", "max_bin": "max_bin",
                "base_score": "base_score"},
    "random_forest": {"n_estimators": "numTrees", "max_depth": "maxDepth", "min_samples_leaf": "minInstancesPerNode",
                      "random_state": "seed", "max_features": "featureSubsetStrategy", "bootstrap": "bootstrap"},
    "logistic_regression": {"max_iter": "maxIter", "C": "regParam", "penalty": "elasticNetParam"},
}
# What a boosted model starts from; others start from the estimator's own defaults.
_DEFAULTS = {
    "gradient_boosting": boosting.Rules(rate=0.1, depth=3, newton=False, l2=0.0, least_hessian=0.0),
    "xgboost": boosting.Rules(),
}
_ESTIMATORS = {"random_forest": Forest, "logistic_regression": LogisticRegression}
_WEIGHTS = {"class_weight", "scale_pos_weight"}

# Parameters that change how the original libraries run and not what they learn.
_WITHOUT_EFFECT = {
    "gradient_boosting": {"verbose"},
    "xgboost": {"n_jobs", "eval_metric", "use_label_encoder", "verbosity"},
    "random_forest": {"n_jobs", "verbose"},
    "logistic_regression": {"n_jobs", "solver", "random_state", "verbose"},
}
# Parameters that are taken with these values only.
_ONLY = {
    "gradient_boosting": {"loss": {"log_loss"}},
    "xgboost": {"objective": {"binary:logistic"}, "tree_method": {"auto", "hist", "approx"}, "booster": {"gbtree"}},
    "random_forest": {"min_samples_split": {2}, "criterion": {"gini"}},
    "logistic_regression": {},
}


def build_classifier(
    algorithm: str, params: Mapping[str, object], weighted: bool = False, rows: int | None = None,
    features: int = len(schemas.FEATURES),
):
    """Estimator by name; a parameter that would be left out of the model is an error.

    ``rows`` is the number of training rows, which the strength ``C`` of a logistic regression is relative to.
    """
    if algorithm not in _NAMES:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(sorted(_NAMES))}")
    names, only = _NAMES[algorithm], _ONLY[algorithm]
    unknown = sorted(set(params) - set(names) - _WEIGHTS - _WITHOUT_EFFECT[algorithm] - set(only))
    if unknown:
        raise ValueError(f"unknown parameters of {algorithm}: {', '.join(unknown)}")
    for name, values in only.items():
        if params.get(name) is not None and params[name] not in values:
            raise ValueError(f"{name}={params[name]!r} of {algorithm} is not supported")
    known = {names[k]: v for k, v in params.items() if k in names and v is not None}
    if algorithm in _DEFAULTS:
        if "split_features" in known:
            known["split_features"] = _features_per_split(known["split_features"], features)
        rules = replace(_DEFAULTS[algorithm], **known)
        return boosting.NewtonBoosting("_features", "_label", rules, "_weight" if weighted else None)
    if algorithm == "random_forest" and "max_features" in params:
        chosen = params["max_features"]
        known["featureSubsetStrategy"] = "all" if chosen is None else str(_features_per_split(chosen, features))
    if algorithm == "logistic_regression":
        penalty = params.get("penalty", "l2")
        if penalty not in ("l1", "l2", None):
            raise ValueError(f"penalty={penalty!r} of {algorithm} is not supported")
        known["elasticNetParam"] = 1.0 if penalty == "l1" else 0.0
        if penalty is None:
            known["regParam"] = 0.0
        elif "C" in params or "penalty" in params:
            if rows is None:
                raise ValueError("the strength of a penalty needs the number of rows")
            known["regParam"] = 1.0 / (float(params.get("C", 1.0)) * rows)
    if weighted:
        known["weightCol"] = "_weight"
    return _ESTIMATORS[algorithm](featuresCol="_features", labelCol="_label", **known)


def _features_per_split(chosen: object, features: int) -> int:
    """Number of features tried at a split: a number, a share, ``sqrt`` or ``log2``."""
    if chosen == "sqrt":
        return max(1, math.isqrt(features))
    if chosen == "log2":
        return max(1, int(math.log2(features)))
    if isinstance(chosen, float):
        return max(1, int(chosen * features))
    return int(chosen)


def load_scorer(path: str) -> PipelineModel:
    """A pipeline that was saved after training, ready to score without its training data."""
    return PipelineModel.load(path)


def class_weights(df: DataFrame, label: str, params: Mapping[str, object]) -> Column | None:
    """Row weight asked for by the parameters, from one count of the classes."""
    balanced = params.get("class_weight") == "balanced"
    positive = params.get("scale_pos_weight")
    if not balanced and positive is None:
        return None
    if not balanced and positive != NEG_POS_RATIO:
        return F.when(F.col(label) == 1, F.lit(float(positive))).otherwise(F.lit(1.0))
    counts = df.agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    ).first()
    p, n = counts["p"], counts["n"]
    if balanced:
        total = p + n
        return F.when(F.col(label) == 1, F.lit(total / (2.0 * max(p, 1)))).otherwise(
            F.lit(total / (2.0 * max(n, 1)))
        )
    return F.when(F.col(label) == 1, F.lit(n / max(p, 1))).otherwise(F.lit(1.0))


def train(
    df: DataFrame, experiment: Experiment, features: Sequence[str] = schemas.FEATURES, label: str = schemas.TARGET,
    tasks: int | None = None,
) -> PipelineModel:
    """Fit one experiment on encoded rows; a boosted model uses as many cores as ``tasks`` if told, else all."""
    weight = class_weights(df, label, experiment.params)
    rows = df.withColumn("_label", F.col(label).cast("double"))
    if weight is not None:
        rows = rows.withColumn("_weight", weight)
    assembler = VectorAssembler(inputCols=list(features), outputCol="_features")
    params = {k: v for k, v in experiment.params.items() if k not in _WEIGHTS}
    count = df.count() if {"C", "penalty"} & set(params) else None
    classifier = build_classifier(experiment.algorithm, params, weight is not None, count, len(features))
    if isinstance(classifier, boosting.NewtonBoosting):
        classifier.tasks = tasks
    # a table of few files is read by as few tasks; the passes of a training over it use all cores
    return Pipeline(stages=[assembler, classifier]).fit(spread(rows))


def score(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``churn_probability`` and ``churn_prediction``; other columns stay."""
    probability = vector_to_array("probability").getItem(1)
    return (
        model.transform(df)
        .withColumn("churn_probability", probability)
        .withColumn("churn_prediction", threshold_class(F.col("churn_probability"), threshold))
        .drop("_features", "rawPrediction", "probability", "prediction")
    )


def feature_importance(model: PipelineModel, df: DataFrame, features: Sequence[str] = schemas.FEATURES) -> DataFrame:
    """Importance per feature of a tree model, greatest first."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(values[i])) for i, name in enumerate(features)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")


def inference_records(
    scored: DataFrame,
    experiment: Experiment,
    created_at: str,
    feature_source: str,
    features: Sequence[str] = schemas.FEATURES,
    customer_id: str | None = None,
) -> DataFrame:
    """Scored rows in the layout of the inference log."""
    key = F.col(customer_id) if customer_id else F.lit(None)
    return scored.select(
        F.lit(created_at).alias("timestamp"),
        F.lit(schemas.MONITORING_CONTRACT).alias("monitoring_contract"),
        F.lit(experiment.name).alias("model_name"),
        F.lit(experiment.version).alias("model_version"),
        F.lit(float(experiment.threshold)).alias("threshold"),
        F.col("churn_probability").cast("double").alias("churn_probability"),
        F.col("churn_prediction").cast("int").alias("churn_prediction"),
        F.lit(feature_source).alias("feature_source"),
        key.cast("long").alias("customer_id"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in features],
    )


def batch_manifest(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, mean probability and positive rate of a scored batch."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg("churn_probability").alias("mean_probability"),
        F.avg(F.col("churn_prediction").cast("double")).alias("positive_rate"),
    )


def predict_raw(requests: DataFrame, encoder, model: PipelineModel, experiment: Experiment) -> DataFrame:
    """Raw requests scored in one plan; faulty rows keep their error text."""
    checked = contracts.validate_requests(requests)
    good = encoder.keeping("index").transform(checked.where(F.col("status") == "ok"))
    scored = score(model, good, experiment.threshold).select(
        "index", F.lit("ok").alias("status"), "churn_probability", "churn_prediction",
        F.lit(None).cast("string").alias("error"),
    )
    return _with_errors(scored, checked)


def predict_lookup(
    requests: DataFrame, online: DataFrame, model: PipelineModel, experiment: Experiment,
    features: Sequence[str] = schemas.FEATURES,
) -> DataFrame:
    """Lookup requests scored on their latest features; unknown customers keep an error."""
    checked = contracts.validate_lookups(requests).select("index", "customer_id", "status", "error")
    found = featurestore.lookup(
        checked.where(F.col("status") == "ok").drop("status", "error"), online, features
    )
    scored = score(model, found.where(F.col("status") == "ok"), experiment.threshold).select(
        "index", "status", "churn_probability", "churn_prediction", F.lit(None).cast("string").alias("error")
    )
    return _with_errors(_with_errors(scored, found), checked)


def _with_errors(scored: DataFrame, checked: DataFrame) -> DataFrame:
    failed = checked.where(F.col("status") == "error").select("index", "status", "error")
    return scored.unionByName(failed, allowMissingColumns=True)


# --- scenarios --------------------------------------------------------------


def comparison_payloads(df: DataFrame, text: str) -> DataFrame:
    """Read request payloads out of messages: ``baseline``, and ``improved`` if two are compared.

    Later sources win: defaults, hints of the whole message, hints of the half.
    The second half builds on the first when it speaks of the same customer.
    """
    first, second = tx.comparison_halves(F.col(text))
    halves = df.withColumns({"_first": first, "_second": second})
    parts = {"_whole": text, "_one": "_first", "_two": "_second"}
    # each message is flattened once and each attribute read once, in columns of their own: many expressions name them
    flat = halves.withColumns({name: tx.flat_message(F.col(source)) for name, source in parts.items()})
    known = flat.withColumns(
        {name: F.struct(*[c.alias(n) for n, c in tx.flat_attributes(F.col(name)).items()]) for name in parts}
    )
    whole, one, two = ({n: F.col(name)[n] for n in known.schema[name].dataType.names} for name in parts)
    inherits = tx.same_customer(F.col("_second"))

    def payload(pick) -> Column:
        return F.struct(*[pick(name, F.lit(v)).alias(name) for name, v in tx.REQUEST_DEFAULTS.items()])

    def baseline(name: str, default: Column) -> Column:
        if name not in whole:
            return default
        return F.coalesce(one[name], whole[name], default)

    def improved(name: str, default: Column) -> Column:
        if name not in whole:
            return default
        return F.coalesce(two[name], F.when(inherits, one[name]), whole[name], default)

    return known.withColumns(
        {
            "baseline": payload(baseline),
            "improved": F.when(F.col("_second").isNotNull(), payload(improved)),
            "description": tx.short_text(F.col(text), 180),
        }
    ).drop("_first", "_second", *parts)


def compare_scenarios(rows: DataFrame) -> DataFrame:
    """Baseline against improved probability per scenario; equal ones count as improved.

    Input: ``(scenario_id, role, probability)`` with roles baseline and improved.
    """

    def of(role: str) -> Column:
        return F.max(F.when(F.col("role") == role, F.col("probability")))

    pairs = rows.groupBy("scenario_id").agg(of("baseline").alias("baseline"), of("improved").alias("improved"))
    return pairs.withColumns(
        {
            "probability_delta": F.round(F.col("improved") - F.col("baseline"), 6),
            "better": F.when(F.col("baseline") < F.col("improved"), "baseline_scenario").otherwise(
                "improved_scenario"
            ),
        }
    )
