"""Jobs over customer tables: featurize, export, drift, retraining, prediction logs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schemas
from tidegauge.functions.dates import iso_with_offset
from tidegauge.operators import (
    boosting,
    cleaning,
    contracts,
    drift,
    featurestore,
    metrics,
    promotion,
    scoring,
    synthetic,
)
from tidegauge.operators.encoder import ChurnEncoder, ChurnEncoderModel
from tidegauge.session import through_table
from tidegauge.sources import sinks


def run_time(spark: SparkSession) -> str:
    """Now, in the project's zone."""
    return spark.range(1).select(iso_with_offset(F.current_timestamp())).first()[0]


@dataclass(frozen=True)
class FeatureSet:
    encoder: ChurnEncoderModel
    train: DataFrame
    test: DataFrame
    interim: DataFrame


def featurize(raw: DataFrame, output: str | None = None, fraction: float = 0.2, seed: int = 42) -> FeatureSet:
    """Check, minimise, clean, split and encode raw customers; write everything if asked.

    The split is drawn on the row contents, since identifiers are gone by then and
    duplicates have been removed. The encoder is fitted on training rows only.
    """
    contracts.require_contract(raw, schemas.RAW_CUSTOMERS, contracts.RAW_RULES)
    minimal = contracts.require_no_identifiers(contracts.drop_identifiers(raw))
    interim = through_table(cleaning.clean(minimal), "interim")
    contracts.require_contract(interim, schemas.INTERIM_CUSTOMERS, contracts.INTERIM_RULES)
    names = sorted(interim.columns)
    keyed = interim.withColumn(
        "_row", F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in names]).cast("binary"))
    )
    split = cleaning.stratified_split(keyed, schemas.TARGET, "_row", fraction, seed).drop("_row")
    train_rows, test_rows = split.where(F.col("split") == "train"), split.where(F.col("split") == "test")
    encoder = ChurnEncoder(passthrough=[schemas.TARGET]).fit(train_rows)

    def modelled(rows: DataFrame) -> DataFrame:
        return encoder.transform(rows).select(*[F.col(f"`{c}`") for c in schemas.FEATURES], schemas.TARGET)

    result = FeatureSet(encoder, modelled(train_rows), modelled(test_rows), interim)
    if output:
        sinks.write_table(interim, f"{output}/interim")
        sinks.write_table(result.train, f"{output}/train")
        sinks.write_table(result.test, f"{output}/test")
        sinks.write_feature_list(raw.sparkSession, schemas.FEATURES, f"{output}/feature_columns")
        encoder.write().overwrite().save(f"{output}/encoder")
    return result


def export_features(raw: DataFrame, encoder: ChurnEncoderModel, output: str | None = None) -> DataFrame:
    """Offline feature table: duplicates go before the identifiers, times follow the row number."""
    clean = cleaning.clean(raw)
    keep = encoder.keeping("RowNumber", "CustomerId")
    encoded = keep.transform(clean).withColumnRenamed("CustomerId", "customer_id")
    timed = featurestore.with_event_times(encoded, [F.col("RowNumber"), F.col("customer_id")])
    export = featurestore.feature_export(timed)
    if output:
        sinks.write_table(export, output)
        return raw.sparkSession.read.schema(export.schema).parquet(output)
    return export


# --- drift ------------------------------------------------------------------


@dataclass(frozen=True)
class DriftRun:
    psi: DataFrame
    metrics: DataFrame
    request: DataFrame


def retrain_requests(
    decision: DataFrame, model_path: str, config_path: str, created_at: str,
    policy: promotion.Policy, trigger_mode: str = "auto_train_manual_promote", request_id: str | None = None,
) -> DataFrame:
    """One auditable request row when retraining is recommended, none otherwise."""
    rules = F.struct(
        F.lit(policy.criteria).alias("criteria"),
        F.lit(policy.primary_metric).alias("primary_metric"),
        F.lit(policy.minimum_improvement).alias("minimum_improvement"),
        F.create_map(*[F.lit(x) for kv in policy.weights.items() for x in kv]).alias("metric_weights"),
        F.create_map(*[F.lit(x) for kv in policy.guardrails.items() for x in kv])
        .cast("map<string,double>").alias("metric_guardrails"),
    )
    return decision.where(F.col("retraining_recommended")).select(
        F.lit(request_id or str(uuid.uuid4())).alias("request_id"),
        F.lit("requested").alias("status"),
        F.lit("critical_data_or_prediction_drift").alias("reason"),
        F.lit(model_path).alias("model_path"),
        F.lit(config_path).alias("training_config_path"),
        F.lit(trigger_mode).alias("trigger_mode"),
        F.lit(created_at).alias("created_at"),
        F.lit("manual_approval_required").alias("promotion_policy"),
        rules.alias("promotion_rules"),
        F.col("status").alias("drift_status"),
        "max_feature_psi", "prediction_psi", "drifted_features", "reference_row_count", "current_row_count",
    )


def monitor_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] = schemas.FEATURES,
    model=None,
    output: str | None = None,
    created_at: str | None = None,
    minimum: int = drift.MINIMUM_ROWS,
    policy: promotion.Policy = promotion.Policy(primary_metric="recall"),
    encoder: ChurnEncoderModel | None = None,
) -> DriftRun:
    """Compare two tables, decide, and record metrics, history and a retrain request.

    Prediction drift is taken when the current rows carry probabilities; the
    reference is scored with ``model`` unless it carries them too.
    """
    spark = reference.sparkSession
    created_at = created_at or run_time(spark)
    score_name = "churn_probability"
    before = contracts.resolve_features(reference, features, encoder)
    after = contracts.resolve_features(current, features, encoder)
    psi = drift.feature_psi(before, after, list(features))
    prediction = None
    if score_name in current.columns:
        scored = reference if score_name in reference.columns else None
        if scored is None and model is not None:
            scored = scoring.score(model, before)
        if scored is not None:
            prediction = drift.numeric_psi(
                scored.select(score_name), current.select(score_name), [score_name]
            ).select(F.col("psi").alias("prediction_psi"))
    n_reference, n_current = reference.count(), current.count()
    decision = drift.apply_minimum_sample(drift.decide(psi, prediction), F.lit(n_current), minimum)
    payload = drift.metrics_payload(decision, F.lit(n_reference), F.lit(n_current), created_at)
    request = retrain_requests(payload, "models/current", "current", created_at, policy)
    if output:
        sinks.write_table(psi.orderBy(F.col("psi").desc(), "feature"), f"{output}/feature_psi")
        sinks.write_latest_with_history(payload, f"{output}/metrics", f"{output}/runs")
        payload = spark.read.schema(payload.schema).json(f"{output}/metrics")
        sinks.write_json(request, f"{output}/retrain_request")
        request = spark.read.schema(request.schema).json(f"{output}/retrain_request")
    return DriftRun(psi, payload, request)


# --- training ---------------------------------------------------------------


def score_test(model, test: DataFrame, experiment: scoring.Experiment, features: Sequence[str], label: str) -> DataFrame:
    """``(model, id, label, score)`` of the test rows, stored once."""
    keyed = test.withColumn("_id", F.xxhash64(*[F.col(f"`{c}`") for c in features]))
    scored = scoring.score(model, keyed, experiment.threshold).select(
        F.lit(experiment.name).alias("model"), F.col("_id").alias("id"),
        F.col(label).alias("label"), F.col("churn_probability").alias("score"),
    )
    return through_table(scored, "scored")


def train_and_evaluate(
    train: DataFrame, test: DataFrame, experiment: scoring.Experiment,
    features: Sequence[str] = schemas.FEATURES, label: str = schemas.TARGET, output: str | None = None,
):
    """Fit one experiment and return the model with its metric rows."""
    model = scoring.train(train, experiment, features, label)
    found = metrics.evaluate(score_test(model, test, experiment, features, label), threshold=experiment.threshold)
    if output:
        model.write().overwrite().save(f"{output}/{experiment.name}")
        sinks.append_history(with_versions(found, [experiment]), f"{output}/metrics")
    return model, found


def with_versions(found: DataFrame, experiments: Sequence[scoring.Experiment]) -> DataFrame:
    """Metric rows with the version and algorithm of their models."""
    def of(field: str):
        return F.create_map(*[F.lit(x) for e in experiments for x in (e.name, getattr(e, field))])[F.col("model")]

    return found.withColumns({"model_version": of("version"), "algorithm": of("algorithm")})


# Bytes of training rows in a partition, rows that are worth one of their own, and experiments trained at once.
_TRAIN_BYTES = 64 << 20
_TRAIN_ROWS = 20_000
SIDE_BY_SIDE = 8


def sized(df: DataFrame) -> DataFrame:
    """As many partitions as the rows' bytes need, and all cores once rows are many: the many short jobs of a training
    on few rows have few tasks, and no training on many rows leaves cores idle."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(rows * len(df.columns) * 8 / _TRAIN_BYTES), min(cores, rows // _TRAIN_ROWS))
    return df.coalesce(parts) if df.rdd.getNumPartitions() > parts else df.repartition(parts)


def shared_cores(experiments: Sequence[scoring.Experiment], side_by_side: int, cores: int) -> dict[str, int]:
    """Cores of each boosted experiment that is trained beside others, by its share of all levels to be grown.

    Each level is a short job, most of which is the start of its tasks: trainings on few cores each grow more levels a
    second than trainings that all spread over all cores.
    """
    levels = {}
    for e in experiments:
        built = scoring.build_classifier(e.algorithm, {k: v for k, v in e.params.items() if k not in ("class_weight", "scale_pos_weight")}, rows=1)
        if isinstance(built, boosting.NewtonBoosting):
            levels[e.name] = built.getMaxIter() * built.getMaxDepth()
    if min(side_by_side, len(levels)) < 2:
        return {name: cores for name in levels}
    return {name: max(1, round(cores * own / sum(levels.values()))) for name, own in levels.items()}


def sweep(
    train: DataFrame, test: DataFrame, experiments: Sequence[scoring.Experiment],
    features: Sequence[str] = schemas.FEATURES, label: str = schemas.TARGET, output: str | None = None,
    side_by_side: int = SIDE_BY_SIDE,
) -> DataFrame:
    """Metric rows of several experiments over the same training rows.

    The rows are cached once. Each experiment is driven by a thread of its own, in a scheduler pool of its name, as the
    jobs of one training are short and leave most of a cluster idle. Stored scores are evaluated together.
    """
    if not experiments:
        raise ValueError("no experiment given")
    spark = train.sparkSession
    rows = sized(through_table(train, "train")).persist()
    held_out = through_table(test, "test")
    tasks = shared_cores(experiments, side_by_side, spark.sparkContext.defaultParallelism)

    def one(experiment: scoring.Experiment) -> DataFrame:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", experiment.name)
        model = scoring.train(rows, experiment, features, label, tasks.get(experiment.name))
        if output:
            model.write().overwrite().save(f"{output}/{experiment.name}")
        return score_test(model, held_out, experiment, features, label)

    try:
        with ThreadPoolExecutor(side_by_side) as pool:
            futures = [pool.submit(inheritable_thread_target(spark)(one), e) for e in experiments]
            scores = [future.result() for future in futures]
    finally:
        rows.unpersist()
    results = None
    for threshold in sorted({e.threshold for e in experiments}):
        same = [s for e, s in zip(experiments, scores) if e.threshold == threshold]
        found = metrics.evaluate(reduce(DataFrame.unionByName, same), threshold=threshold)
        results = found if results is None else results.unionByName(found)
    if output:
        sinks.append_history(with_versions(results, experiments), f"{output}/metrics")
        sinks.write_table(reduce(DataFrame.unionByName, scores), f"{output}/scores")
    return results


def challenger_of(experiment: scoring.Experiment, request_id: str) -> scoring.Experiment:
    """The experiment renamed for a retrain request."""
    suffix = request_id.split("-")[0]
    return scoring.Experiment(
        f"{experiment.name}_challenger_{suffix}", experiment.algorithm,
        f"{experiment.version}-challenger-{suffix}", experiment.params, experiment.threshold,
    )


def retrain_and_decide(
    request: Mapping[str, object], experiment: scoring.Experiment, train: DataFrame, test: DataFrame,
    champion_metrics: DataFrame, champion: str, output: str,
    features: Sequence[str] = schemas.FEATURES, label: str = schemas.TARGET, created_at: str | None = None,
) -> DataFrame:
    """Train the challenger of a request, compare it with the champion, record the outcome.

    A failure is recorded with its reason and raised again. Nothing is promoted.
    """
    spark = train.sparkSession
    started = created_at or run_time(spark)
    request_id = str(request["request_id"])
    challenger = challenger_of(experiment, request_id)

    def record(status: str, reason: str | None) -> None:
        row = [(request_id, status, started, challenger.name, challenger.version, reason)]
        layout = "request_id string, status string, started_at string, experiment string, model_version string, failure_reason string"
        sinks.append_history(spark.createDataFrame(row, layout), f"{output}/runs")

    record("running", None)
    try:
        _, found = train_and_evaluate(train, test, challenger, features, label, f"{output}/models")
        policy = promotion.Policy.from_rules(request.get("promotion_rules"))
        both = champion_metrics.select("model", "metric", "value").unionByName(
            found.select("model", "metric", "value")
        )
        decision = promotion.decide_promotion(both, champion, policy).withColumn(
            "request_id", F.lit(request_id)
        )
        sinks.write_latest_with_history(decision, f"{output}/decision", f"{output}/decisions")
    except Exception as error:
        record("failed", str(error))
        raise
    record("completed", None)
    return spark.read.schema(decision.schema).json(f"{output}/decision")


# --- synthetic batches ------------------------------------------------------


def scored_scenarios(
    base: DataFrame, order_by: str, encoder: ChurnEncoderModel, model, experiment: scoring.Experiment,
    rows: int = synthetic.BATCH_ROWS, seed: int = 42, scenarios: Sequence[str] = tuple(synthetic.SCENARIOS),
) -> DataFrame:
    """Every drift scenario drawn, encoded and scored: features, probability, ``scenario_name``."""
    keep = encoder.keeping(synthetic.DRAW, "scenario_name")
    whole = None
    for scenario in scenarios:
        batch = synthetic.scenario_batch(base, [F.col(order_by)], scenario, rows, seed)
        named = batch.withColumn("scenario_name", F.lit(scenario))
        whole = named if whole is None else whole.unionByName(named)
    return scoring.score(model, keep.transform(whole), experiment.threshold)


def prediction_log(
    base: DataFrame, order_by: str, encoder: ChurnEncoderModel, model, experiment: scoring.Experiment,
    rows: int, drifted: bool, created_at: str, seed: int = 42, output: str | None = None,
) -> DataFrame:
    """A generated inference log, with or without drift."""
    batch = synthetic.prediction_batch(base, [F.col(order_by)], rows, drifted, seed)
    scored = scoring.score(model, encoder.transform(batch), experiment.threshold)
    records = scoring.inference_records(scored, experiment, created_at, "synthetic_transformed_batch")
    if output:
        sinks.write_json(records, output)
    return records


def scenario_suite(
    scenarios: DataFrame, encoder: ChurnEncoderModel, model, experiment: scoring.Experiment
) -> DataFrame:
    """Named scenarios validated and scored in one pass."""
    checked = contracts.validate_requests(scenarios)
    keep = encoder.keeping("scenario_name")
    good = keep.transform(checked.where(F.col("status") == "ok"))
    return scoring.score(model, good, experiment.threshold).select(
        "scenario_name", "churn_probability", "churn_prediction",
        F.lit(experiment.threshold).alias("threshold"), F.lit(experiment.name).alias("model_name"),
    )
