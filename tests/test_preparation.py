import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.functions import dates, hashing, numeric
from tidegauge.operators import cleaning, contracts
from tidegauge.operators.encoder import ChurnEncoder, ChurnEncoderModel, LeakageDropper, LeakageFilter, enrich, rename_prefix


def test_raw_contract_holds_and_reports_breaches(spark, raw):
    contracts.require_contract(raw, schemas.RAW_CUSTOMERS, contracts.RAW_RULES)
    broken = raw.withColumn("Age", F.when(F.col("Age") == 30, 17).otherwise(F.col("Age")))
    broken = broken.withColumn("Geography", F.when(F.col("Age") == 40, None).otherwise(F.col("Geography")))
    report = {
        (r["column"], r["rule"]): r["n_violations"]
        for r in contracts.contract_report(broken, schemas.RAW_CUSTOMERS, contracts.RAW_RULES).collect()
        if r["n_violations"]
    }
    assert report == {("Age", "in_range"): 1, ("Geography", "not_null"): 1}
    with pytest.raises(contracts.ContractError):
        contracts.require_contract(broken, schemas.RAW_CUSTOMERS, contracts.RAW_RULES)


def test_contract_sees_types_and_absent_columns(raw):
    other = raw.withColumn("Age", F.col("Age").cast("double")).drop("Tenure")
    found = {
        (r["column"], r["rule"])
        for r in contracts.contract_report(other, schemas.RAW_CUSTOMERS, contracts.RAW_RULES).collect()
        if r["n_violations"]
    }
    assert found == {("Age", "dtype"), ("Tenure", "dtype")}


def test_identifiers(raw):
    with pytest.raises(contracts.ContractError, match="CustomerId"):
        contracts.require_no_identifiers(raw)
    minimal = contracts.drop_identifiers(raw.drop("Surname"))
    assert contracts.require_no_identifiers(minimal).columns == schemas.INTERIM_CUSTOMERS.names
    assert contracts.governed_columns(raw).first()["in_use"]
    with pytest.raises(KeyError, match="Absent"):
        contracts.require_columns(raw, ["Age", "Absent"])


def test_clean_removes_duplicates_and_missing_rows(spark):
    data = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, float("nan")), (4, 2.0)], "a int, b double")
    assert sorted(r["a"] for r in cleaning.clean(data).collect()) == [1, 4]
    assert cleaning.clean_report(data).first().asDict() == {
        "rows_in": 5, "duplicates_removed": 1, "missing_removed": 2, "rows_out": 2,
    }


def test_ratios_encoding_and_order(spark, interim):
    assert enrich(interim).first()["BalancePerProduct"] == 1000.0
    model = ChurnEncoder(passthrough=["Exited"]).fit(interim)
    out = model.transform(LeakageDropper(columns=["Complain"]).transform(interim))
    assert out.columns == ["Exited", *schemas.FEATURES]
    stats = out.agg(F.avg("Age").alias("m"), F.stddev_pop("Age").alias("s")).first()
    assert stats["m"] == pytest.approx(0.0, abs=1e-12) and stats["s"] == pytest.approx(1.0)
    cards = {r[0] for r in out.select("Card Type").collect()}
    assert cards == {0.0, 1.0, 2.0, 3.0}
    unknown = interim.limit(1).withColumns({"Card Type": F.lit("TIN"), "Geography": F.lit("Peru"), "Gender": F.lit(None)})
    row = model.transform(unknown).first()
    assert (row["Card Type"], row["Gender"], row["Geo_Germany"], row["Geo_Spain"]) == (-1.0, -1.0, 0.0, 0.0)


def test_constant_columns_scale_to_zero(interim):
    flat = interim.withColumn("Age", F.lit(40).cast("long"))
    assert ChurnEncoder().fit(flat).transform(flat).first()["Age"] == 0.0


def test_encoder_is_saved_and_read_back(spark, interim, tmp_path):
    model = ChurnEncoder().fit(interim)
    model.write().overwrite().save(str(tmp_path / "encoder"))
    again = ChurnEncoderModel.load(str(tmp_path / "encoder"))
    assert again.transform(interim).collect() == model.transform(interim).collect()
    pipeline = PipelineModel(stages=[LeakageDropper(), model])
    pipeline.write().overwrite().save(str(tmp_path / "pipeline"))
    assert PipelineModel.load(str(tmp_path / "pipeline")).transform(interim).count() == 10


def test_prefix_rename_and_missing_leakage(interim):
    renamed = rename_prefix(interim.withColumn("Geography_Spain", F.lit(1)))
    assert "Geo_Spain" in renamed.columns and "Geography" in renamed.columns
    assert LeakageDropper().missing(interim.drop("Complain")) == ["Complain"]


def test_feature_matrix_resolution(spark, interim):
    model = ChurnEncoder().fit(interim)
    encoded = model.transform(interim)
    assert contracts.resolve_features(encoded, schemas.FEATURES).columns == schemas.FEATURES
    with pytest.raises(contracts.ContractError, match="part"):
        contracts.resolve_features(encoded.select("Age", "Balance"), schemas.FEATURES)
    hole = encoded.withColumn("Age", F.when(F.col("Age") > 0, F.col("Age")))
    with pytest.raises(contracts.ContractError, match="rows lack"):
        contracts.resolve_features(hole, schemas.FEATURES)


def test_request_validation_fills_defaults_and_joins_errors(spark):
    rows = [(0, 40, None, "France", None), (1, 17, -1.0, "Mars", "A B")]
    data = spark.createDataFrame(rows, "index int, Age int, Balance double, Geography string, model_name string")
    ok, bad = contracts.validate_requests(data).orderBy("index").collect()
    assert (ok["status"], ok["error"], ok["Balance"], ok["Card Type"], ok["model_name"]) == (
        "ok", None, 0.0, "SILVER", "current",
    )
    assert bad["status"] == "error"
    assert bad["error"].split("; ")[0].startswith("Geography: ") and len(bad["errors"]) == 4
    summary = contracts.batch_summary(contracts.validate_requests(data)).first()
    assert summary.asDict() == {"total": 2, "success": 1, "errors": 1}


def test_split_is_stratified_exact_and_stable(spark):
    data = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1003)], "id long, y int")
    split = cleaning.stratified_split(data, "y", "id")
    got = {(r["y"], r["split"]): r["n"] for r in split.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    for y in (0, 1):
        n = sum(1 for i in range(1003) if int(i % 10 == 0) == y)
        assert got[(y, "test")] == math.ceil(0.2 * n)
    tests = {r["id"] for r in split.where("split = 'test'").collect()}
    again = cleaning.stratified_split(data.repartition(9), "y", "id")
    assert tests == {r["id"] for r in again.where("split = 'test'").collect()}
    assert tests != {r["id"] for r in cleaning.stratified_split(data, "y", "id", seed=7).where("split = 'test'").collect()}
    with pytest.raises(ValueError):
        cleaning.stratified_split(data, "absent", "id")


def test_imbalance_with_no_positive(spark):
    data = spark.createDataFrame([(0,), (0,)], "y int")
    assert cleaning.imbalance_ratio(data, "y").first()["neg_pos_ratio"] == 2.0


def test_md5_modulo_equals_big_integers(spark):
    import hashlib

    data = spark.createDataFrame([(str(i),) for i in range(200)], "s string")
    for modulus in (2, 365, 1_000_003):
        got = data.select("s", hashing.md5_mod(F.col("s"), modulus).alias("m")).collect()
        assert all(r["m"] == int(hashlib.md5(r["s"].encode()).hexdigest(), 16) % modulus for r in got)


def test_customer_since_and_snapshots(spark):
    data = spark.createDataFrame([(101, 2, 1), (202, 0, 2), (303, 5, 3), (404, None, 4)], "id long, tenure int, row long")
    got = data.select(
        dates.customer_since(F.col("id"), F.col("tenure"), jitter_days=0).alias("since"),
        dates.snapshot_date(F.col("row"), cycle_days=2).alias("snap"),
    ).collect()
    assert [r["since"] for r in got] == ["2022-12-31", "2024-12-31", "2019-12-31", "2024-12-31"]
    assert [r["snap"] for r in got] == ["2024-01-01", "2024-01-02", "2024-01-01", "2024-01-02"]
    leap = spark.range(1).select(dates.customer_since(F.lit(1), F.lit(1), "2024-02-29", 0)).first()[0]
    assert leap == "2023-02-28"


def test_clips_round_half_to_even(spark):
    data = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (99.0,)], "x double")
    assert [r[0] for r in data.select(numeric.clip_int(F.col("x"), 0, 10)).collect()] == [0, 2, 2, 10]
    assert [r[0] for r in data.select(numeric.clip_float(F.col("x"), 1.0)).collect()] == [1.0, 1.5, 2.5, 99.0]


def test_score_clamp(spark):
    data = spark.createDataFrame([("4.9",), ("-3",), ("x",), (None,), ("9",), ("nan",)], "s string")
    assert [r[0] for r in data.select(numeric.clamp_score(F.col("s"))).collect()] == [4, 1, 1, 1, 5, 1]


def test_iso_time_carries_the_offset(spark):
    got = spark.range(1).select(dates.iso_with_offset(F.lit("2024-03-01 02:00:00").cast("timestamp"))).first()[0]
    assert got == "2024-02-29T23:00:00-03:00"


def test_split_of_very_many_classes(spark):
    rows = spark.range(6000).selectExpr("id", "id % 1500 as y")
    found = cleaning.stratified_split(rows, "y", "id", 0.3).groupBy("y").agg(
        F.count_if(F.col("split") == "test").alias("t"), F.count("*").alias("n")
    ).collect()
    assert len(found) == 1500 and all(r["n"] == 4 and r["t"] == 2 for r in found)


def test_split_keeps_a_class_of_nulls(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, null, 1) as y")
    found = {r["y"]: r["n"] for r in cleaning.stratified_split(rows, "y", "id").where("split = 'test'")
             .groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert found == {None: 10, 1: 10}


def test_unknown_parameter_is_an_error():
    from tidegauge.operators import scoring

    with pytest.raises(ValueError, match="n_estimater"):
        scoring.build_classifier("random_forest", {"n_estimater": 10})
    scoring.build_classifier("xgboost", {"n_estimators": 10, "colsample_bytree": 0.8})


def test_every_reference_experiment_can_be_built(spark):
    """The parameters of the eight experiment files, copied; no file is read."""
    from tidegauge.operators import scoring

    boosted = {"learning_rate": 0.05, "max_depth": 3, "min_samples_leaf": 10, "subsample": 0.9, "random_state": 42}
    forest = {"max_depth": 10, "random_state": 42, "class_weight": "balanced"}
    files = [
        ("gradient_boosting", {**boosted, "n_estimators": 250}),
        ("gradient_boosting", {**boosted, "n_estimators": 400, "learning_rate": 0.03}),
        ("gradient_boosting", {**boosted, "n_estimators": 350, "learning_rate": 0.03, "max_depth": 2,
                               "min_samples_leaf": 15, "subsample": 0.85}),
        ("gradient_boosting", {**boosted, "n_estimators": 300, "learning_rate": 0.04, "max_depth": 4,
                               "min_samples_leaf": 8}),
        ("random_forest", {**forest, "n_estimators": 100}),
        ("random_forest", {**forest, "n_estimators": 200, "max_depth": 15, "min_samples_leaf": 5}),
        ("random_forest", {**forest, "n_estimators": 300, "max_depth": 8, "min_samples_leaf": 10}),
        ("xgboost", {"n_estimators": 300, "max_depth": 8, "learning_rate": 0.05, "random_state": 42,
                     "scale_pos_weight": "__neg_pos_ratio__", "eval_metric": "auc", "verbosity": 0}),
    ]
    for algorithm, params in files:
        built = scoring.build_classifier(algorithm, params)
        rounds = built.getNumTrees() if algorithm == "random_forest" else built.getMaxIter()
        assert (rounds, built.getMaxDepth()) == (params["n_estimators"], params["max_depth"])


def test_split_is_the_same_by_broadcast_or_by_salted_classes(spark, monkeypatch):
    rows = spark.range(900).selectExpr("id", "if(id % 3 = 0, 'busy', concat('c', id % 40)) as y").repartition(4)
    sent = {tuple(r) for r in cleaning.stratified_split(rows, "y", "id").collect()}
    plan = cleaning.stratified_split(rows, "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    monkeypatch.setattr(cleaning, "_SENT_CLASSES", 0)
    assert {tuple(r) for r in cleaning.stratified_split(rows, "y", "id").collect()} == sent
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    test = {}
    for _, y, split in sent:
        test[y] = test.get(y, 0) + (split == "test")
    assert test == {y: -(-n // 5) for y, n in counts.items()}


def test_leakage_filter_remembers_the_training_columns(interim, tmp_path):
    from pyspark.ml import Pipeline

    train = interim.withColumn("Hint", F.lit(1))
    with pytest.warns(UserWarning, match="Absent"):
        dropper = LeakageFilter(columns=["Hint", "Absent"]).fit(train)
    later = train.withColumn("Absent", F.lit(2))
    assert set(dropper.transform(later).columns) == set(interim.columns) | {"Absent"}
    assert dropper.transform(interim).columns == interim.columns
    model = Pipeline(stages=[LeakageFilter(), ChurnEncoder()]).fit(interim)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(interim)
    assert again.collect() == model.transform(interim).collect()
