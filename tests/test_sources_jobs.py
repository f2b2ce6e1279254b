import json

import pytest
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.catalog.jobs import LOGISTIC
from tidegauge.operators import drift, featurestore, scoring, synthetic
from tidegauge.operators.encoder import ChurnEncoder
from tidegauge.plans import customers as jobs
from tidegauge.sources import sinks, tables
from tidegauge.streaming import logs


def test_load_dataset_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.load_dataset(spark, str(tmp_path / "none.parquet"))
    with pytest.raises(tables.SourceError):
        tables.load_dataset(spark, str(tmp_path / "a.xlsx"))
    (tmp_path / "empty.jsonl").write_text("")
    with pytest.raises(tables.SourceError, match="empty"):
        tables.load_dataset(spark, str(tmp_path / "empty.jsonl"))


def test_bad_json_lines_name_their_line(spark, tmp_path):
    good = json.dumps({"model_name": "m", "Age": 1.0})
    path = tmp_path / "log.jsonl"
    for text, line in ((good + "\n\n" + good + good + "\n", 3), ("[1]\n", 1)):
        path.write_text(text)
        with pytest.raises(tables.SourceError, match=f"line {line}:"):
            tables.load_dataset(spark, str(path))
    path.write_text(good + "\n\n" + good)
    assert tables.load_dataset(spark, str(path)).count() == 2
    path.write_text("\n \n")
    with pytest.raises(tables.SourceError, match="no records"):
        tables.load_dataset(spark, str(path))


def test_golden_set_and_scenarios(spark, tmp_path):
    path = tmp_path / "golden.json"
    item = {"id": "g1", "question": " O que e PSI? ", "contexts": [" a "], "metadata": {"category": "drift"}}
    path.write_text(json.dumps({"schema_version": 1, "items": [item]}))
    row = tables.read_golden_set(spark, str(path)).first()
    assert (row["query"], row["category"], row["contexts"], row["expected_answer"]) == ("O que e PSI?", "drift", ["a"], "")
    for items in ([], [{"id": "g2", "question": ""}]):
        path.write_text(json.dumps({"items": items}))
        with pytest.raises(ValueError):
            tables.read_golden_set(spark, str(path))
    scenarios = [{"name": "high", "payload": {"Age": 92, "Card Type": "SILVER"}}, {"name": "low", "payload": {"Age": 40}}]
    for body in (scenarios, {"scenarios": scenarios}):
        path.write_text(json.dumps(body))
        got = tables.read_scenarios(spark, str(path)).orderBy("scenario_name").collect()
        assert [(r["scenario_name"], r["Age"]) for r in got] == [("high", 92), ("low", 40)]


def test_feature_list_keeps_its_order(spark, tmp_path):
    sinks.write_feature_list(spark, schemas.FEATURES, str(tmp_path / "f"))
    assert tables.read_feature_list(spark, str(tmp_path / "f")) == schemas.FEATURES


def test_drift_job_writes_metrics_request_and_history(spark, tmp_path):
    def side(ages):
        rows = [(float(a), 100.0) for a in ages]
        return spark.createDataFrame(rows, "Age double, Balance double")

    for _ in range(2):
        run = jobs.monitor_drift(
            side(range(30, 40)), side(range(70, 80)), ["Age", "Balance"], output=str(tmp_path / "d"), minimum=10
        )
    row = run.metrics.first()
    assert (row["status"], row["drifted_features"], row["current_row_count"]) == ("critical", ["Age"], 10)
    assert row["feature_psi"]["Balance"] == 0.0 and row["prediction_psi"] is None
    request = run.request.first()
    assert (request["status"], request["drift_status"]) == ("requested", "critical")
    assert request["promotion_rules"]["primary_metric"] == "recall"
    assert spark.read.json(str(tmp_path / "d" / "runs")).count() == 2
    few = jobs.monitor_drift(side(range(30, 40)), side(range(70, 74)), ["Age", "Balance"], minimum=30)
    assert few.metrics.first()["status"] == "insufficient_data" and few.request.count() == 0


def test_featurize_export_train_and_score(spark, raw, tmp_path):
    made = jobs.featurize(raw, str(tmp_path / "out"))
    assert made.train.count() + made.test.count() == 10 and made.test.count() == 2
    assert made.train.columns == [*schemas.FEATURES, "Exited"]
    assert spark.read.parquet(str(tmp_path / "out" / "train")).count() == made.train.count()
    export = jobs.export_features(raw, made.encoder, str(tmp_path / "export"))
    assert export.columns == schemas.FEATURE_EXPORT.names and export.count() == 10
    model, found = jobs.train_and_evaluate(made.train, made.test, LOGISTIC)
    assert {r["metric"] for r in found.collect()} >= {"auc", "recall_at_top_k"}
    requests = spark.createDataFrame([(0, 100), (1, 999)], "index int, customer_id long")
    got = {r["index"]: r["status"] for r in scoring.predict_lookup(requests, featurestore.latest_features(export), model, LOGISTIC).collect()}
    assert got == {0: "ok", 1: "error"}
    suite = spark.createDataFrame([("high", 92, 350), ("low", 40, 850)], "scenario_name string, Age long, CreditScore long")
    assert jobs.scenario_suite(suite, made.encoder, model, LOGISTIC).count() == 2
    log = jobs.prediction_log(raw, "CustomerId", made.encoder, model, LOGISTIC, 30, True, "t", output=str(tmp_path / "log"))
    assert log.columns == schemas.INFERENCE_LOG.names
    assert spark.read.schema(schemas.INFERENCE_LOG).json(str(tmp_path / "log")).count() == 30


def test_failed_retraining_is_recorded(spark, raw, tmp_path):
    made = jobs.featurize(raw)
    champion = spark.createDataFrame([("old", "auc", 0.5)], "model string, metric string, value double")
    broken = scoring.Experiment("x", "no_such_algorithm")
    with pytest.raises(ValueError):
        jobs.retrain_and_decide({"request_id": "a-b"}, broken, made.train, made.test, champion, "old", str(tmp_path / "r"))
    runs = {r["status"] for r in spark.read.json(str(tmp_path / "r" / "runs")).collect()}
    assert runs == {"running", "failed"}


def test_scenarios_shift_and_stay_in_bounds(spark, raw):
    base = raw.select("CustomerId", *schemas.REQUEST_COLUMNS)
    mean = base.agg(F.avg("Age")).first()[0]
    for scenario in synthetic.SCENARIOS:
        batch = synthetic.scenario_batch(base, [F.col("CustomerId")], scenario, 60)
        assert batch.count() == 60 and dict(batch.dtypes)["Age"] == "bigint"
        row = batch.agg(F.avg("Age").alias("m"), F.min("Age").alias("lo"), F.max("Age").alias("hi"), F.min("Balance").alias("b")).first()
        assert row["b"] >= 0
        if scenario == "age_drift":
            assert row["m"] > mean and row["lo"] >= 58 and row["hi"] <= 92
    one = synthetic.scenario_batch(base, [F.col("CustomerId")], "mixed_extreme_drift", 60).orderBy("draw_id").collect()
    two = synthetic.scenario_batch(base.repartition(3), [F.col("CustomerId")], "mixed_extreme_drift", 60).orderBy("draw_id").collect()
    assert [r.asDict() for r in one] == [r.asDict() for r in two]


def test_inference_log_stream_sets_faulty_records_aside(spark, tmp_path):
    record = {"timestamp": "2024-01-01T10:00:00-03:00", "monitoring_contract": schemas.MONITORING_CONTRACT,
              **{f: 1.0 for f in schemas.FEATURES}}
    lines = [json.dumps(record), json.dumps({**record, "monitoring_contract": "old"}), "{broken",
             json.dumps({k: v for k, v in record.items() if k != "Age"})]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.json").write_text("\n".join(lines))
    accept = logs.per_batch_table(str(tmp_path / "good"))
    logs.run_available(
        logs.inference_log(spark, str(tmp_path / "log")), logs.split_faults(str(tmp_path / "bad"), accept),
        checkpoint=str(tmp_path / "state"),
    )
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    faults = {r["fault"] for r in spark.read.json(str(tmp_path / "bad")).collect()}
    assert faults == {"other_contract", "invalid_json", "missing_feature"}


def test_stream_drift_waits_for_enough_rows(spark, tmp_path):
    reference = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    edges = drift.fit_edges(reference, None, ["x"])
    source = tmp_path / "in"
    handler = logs.drift_decisions(drift.count_values(reference, edges, []), str(tmp_path / "out"), 30)
    for n in (20, 40):
        spark.createDataFrame([(float(80 + i % 20),) for i in range(n)], "x double").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("x double").parquet(str(source))
        logs.run_available(logs.bin_counts(stream, edges, "v1"), handler, "complete", str(tmp_path / "state"))
    got = {r["batch_id"]: (r["status"], r["current_row_count"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: ("insufficient_data", 20), 1: ("critical", 60)}


def test_compaction_keeps_the_state(spark, tmp_path):
    write = logs.refresh_online(str(tmp_path / "o"), ["k"], ["t"])
    for i, rows in enumerate(([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (2, 0, "late")])):
        write(spark.createDataFrame(rows, "k int, t int, v string"), i)
    logs.compact_online(spark, str(tmp_path / "o"), str(tmp_path / "n"), ["k"], ["t"])
    for path in ("o", "n"):
        state = logs.read_online(spark, str(tmp_path / path), ["k"], ["t"])
        assert {r["k"]: r["v"] for r in state.collect()} == {1: "c", 2: "b"}


def test_encoder_fit_uses_training_rows_only(raw):
    part = raw.where("Age < 40")
    model = ChurnEncoder().fit(part)
    assert model.parameters(raw.sparkSession).where("feature = 'Age'").first()["mean"] == part.agg(F.avg("Age")).first()[0]


def test_queries_train_what_the_reference_trains(monkeypatch):
    """The experiment that reaches the training, of each query that trains; nothing is trained here."""
    from types import SimpleNamespace

    from tidegauge.catalog import REGISTRY, jobs as queries

    class Reached(Exception):
        pass

    def reached(rows, experiment, *rest):
        raise Reached(experiment)

    same = lambda frame, label: frame
    for module in (queries, jobs):
        monkeypatch.setattr(module, "through_table", same)
    monkeypatch.setattr(queries, "_feature_set", lambda spark, folder: (None, SimpleNamespace(train=None, test=None)))
    monkeypatch.setattr(queries, "scratch_path", lambda spark, label: label)
    monkeypatch.setattr(scoring, "train", reached)
    served = {"n_estimators": 300, "learning_rate": 0.04, "max_depth": 4, "min_samples_leaf": 8, "subsample": 0.9,
              "random_state": 42}
    for name in ("train_metrics", "retrain_decision", "batch_predict_raw", "batch_predict_lookup",
                 "synthetic_prediction_log"):
        with pytest.raises(Reached) as found:
            REGISTRY[name].run(None, "")
        assert found.value.args[0].params == served, name
    with pytest.raises(Reached) as found:
        REGISTRY["feature_importance"].run(None, "")
    assert (found.value.args[0].params["n_estimators"], found.value.args[0].params["max_depth"]) == (200, 15)
    def swept_over(train, test, experiments, output):
        raise Reached(experiments)

    monkeypatch.setattr(jobs, "sweep", swept_over)
    with pytest.raises(Reached) as found:
        REGISTRY["experiment_sweep"].run(None, "")
    swept = found.value.args[0]
    assert [(e.params["n_estimators"], e.params["max_depth"]) for e in swept] == [
        (250, 3), (400, 3), (350, 2), (300, 4), (100, 10), (200, 15), (300, 8), (300, 8),
    ]


def test_sweep_side_by_side_equals_one_by_one(spark, raw, tmp_path):
    made = jobs.featurize(raw)
    small = {"n_estimators": 4, "max_depth": 2, "random_state": 3}
    experiments = [
        scoring.Experiment("newton", "xgboost", "1", {**small, "scale_pos_weight": scoring.NEG_POS_RATIO}),
        scoring.Experiment("boosted", "gradient_boosting", "2", small, threshold=0.3),
        scoring.Experiment("forest", "random_forest", "3", {**small, "class_weight": "balanced"}),
    ]
    found = jobs.sweep(made.train, made.test, experiments, output=str(tmp_path / "s"))
    each = {}
    for e in experiments:
        _, rows = jobs.train_and_evaluate(made.train.coalesce(1), made.test, e)
        each |= {(r.model, r.metric): r.value for r in rows.collect()}
    assert {(r.model, r.metric): r.value for r in found.collect()} == pytest.approx(each)
    stored = spark.read.parquet(str(tmp_path / "s" / "scores"))
    assert stored.count() == 3 * made.test.count()
    history = spark.read.json(str(tmp_path / "s" / "metrics"))
    assert {(r.model, r.model_version, r.algorithm) for r in history.collect()} == {
        (e.name, e.version, e.algorithm) for e in experiments}
    with pytest.raises(ValueError):
        jobs.sweep(made.train, made.test, [])
