"""Whole jobs, sources and sinks, models and synthetic batches over the derived customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegauge import schemas
from tidegauge.catalog.base import raw_customers, raw_customers_sql, register, table
from tidegauge.catalog.drift import _psi_sql
from tidegauge.catalog.preparation import _BASE_FEATURES, _rounded, _scaled_sql
from tidegauge.operators import drift, featurestore, scoring, synthetic
from tidegauge.operators.encoder import ChurnEncoder, ChurnEncoderModel
from tidegauge.plans import customers as jobs
from tidegauge.session import scratch_path, through_table
from tidegauge.sources import sinks, tables

_CLEAN = raw_customers_sql()

# The parameters of the experiment files, and of the model that is served ("current").
_BOOSTED = {"n_estimators": 250, "learning_rate": 0.05, "max_depth": 3, "min_samples_leaf": 10, "subsample": 0.9,
            "random_state": 42}
_FOREST = {"n_estimators": 100, "max_depth": 10, "random_state": 42, "class_weight": "balanced"}
_SIGNAL = {**_BOOSTED, "n_estimators": 300, "learning_rate": 0.04, "max_depth": 4, "min_samples_leaf": 8}
CHAMPION = scoring.Experiment("current", "gradient_boosting", "0.3.1", _SIGNAL)
FOREST = scoring.Experiment(
    "random_forest_v2_precision", "random_forest", "0.2.0",
    {**_FOREST, "n_estimators": 200, "max_depth": 15, "min_samples_leaf": 5},
)
EXPERIMENTS = [
    scoring.Experiment("gradient_boosting_v1", "gradient_boosting", "0.3.0", _BOOSTED),
    scoring.Experiment(
        "gradient_boosting_v2_more_trees", "gradient_boosting", "0.3.1",
        {**_BOOSTED, "n_estimators": 400, "learning_rate": 0.03},
    ),
    scoring.Experiment(
        "gradient_boosting_v3_smoother", "gradient_boosting", "0.3.1",
        {**_BOOSTED, "n_estimators": 350, "learning_rate": 0.03, "max_depth": 2, "min_samples_leaf": 15,
         "subsample": 0.85},
    ),
    scoring.Experiment("gradient_boosting_v4_more_signal", "gradient_boosting", "0.3.1", _SIGNAL),
    scoring.Experiment("random_forest_v1", "random_forest", "0.1.0", _FOREST),
    FOREST,
    scoring.Experiment(
        "random_forest_v3_recall", "random_forest", "0.3.0",
        {**_FOREST, "n_estimators": 300, "max_depth": 8, "min_samples_leaf": 10},
    ),
    scoring.Experiment(
        "xgboost_v1", "xgboost", "0.3.0",
        {"n_estimators": 300, "max_depth": 8, "learning_rate": 0.05, "random_state": 42,
         "scale_pos_weight": scoring.NEG_POS_RATIO, "eval_metric": "auc", "verbosity": 0},
    ),
]
# A quick model for trials of single steps; no query trains it.
LOGISTIC = scoring.Experiment("logistic", "logistic_regression", "0.1.0", {"max_iter": 20})


# --- sources and sinks ------------------------------------------------------

_RAW_COLUMNS = ", ".join(f'"{c}"' for c in schemas.RAW_CUSTOMERS.names)


@register("csv_round_trip", f"WITH {_CLEAN} SELECT {_RAW_COLUMNS} FROM raw")
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers written as CSV with header and scanned in the fixed layout."""
    path = scratch_path(spark, "customers-csv")
    sinks.write_csv(raw_customers(spark, folder), path)
    return tables.read_raw_customers(spark, path)


@register(
    "json_line_faults",
    """SELECT CASE event_type WHEN 'error' THEN 'invalid_json' WHEN 'signup' THEN 'not_object' ELSE 'good' END AS fault,
       count(*) AS n, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN CAST(json_extract(props, '$.k') AS BIGINT) END) AS BIGINT) AS k
FROM events WHERE event_type <> 'purchase' GROUP BY 1""",
)
def json_line_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as JSON lines; glued, non-object and blank lines among them."""
    kind, props = F.col("event_type"), F.col("props")
    line = (
        F.when(kind == "error", F.concat(props, props))
        .when(kind == "signup", F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == "purchase", F.lit("  "))
        .otherwise(props)
    )
    path = scratch_path(spark, "lines")
    table(spark, folder, "events").select(line.alias("value")).write.text(path)
    good, bad = tables.parse_lines(spark.read.text(path), T.StructType([T.StructField("k", T.LongType())]))
    return good.agg(F.lit("good").alias("fault"), F.count(F.lit(1)).alias("n"), F.sum("k").alias("k")).unionByName(
        bad.groupBy("fault").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("k"))
    )


# Rows of one file of the spoiled log.
_LOG_ROWS = 20_000

_SPOILED_SQL = f"""SELECT event_id // {_LOG_ROWS} AS part, CAST(row_number() OVER (PARTITION BY event_id // {_LOG_ROWS} ORDER BY event_id) AS BIGINT) AS line,
       CASE event_type WHEN 'error' THEN 'invalid_json' WHEN 'signup' THEN 'not_object' END AS fault, event_type FROM events"""


def spoiled_log(spark: SparkSession, folder: str) -> str:
    """Path of the event properties as JSON lines, in order of their ids and in files of bounded size.

    Lines of errors are glued together, those of sign-ups are no objects, purchases leave blank lines.
    """
    kind, props = F.col("event_type"), F.col("props")
    line = (
        F.when(kind == "error", F.concat(props, props))
        .when(kind == "signup", F.concat(F.lit("["), props, F.lit("]")))
        .when(kind == "purchase", F.lit("  "))
        .otherwise(props)
    )
    path = scratch_path(spark, "spoiled-log")
    rows = table(spark, folder, "events").select(
        F.floor(F.col("event_id") / _LOG_ROWS).alias("part"), "event_id", line.alias("value")
    )
    ordered = rows.repartition("part").sortWithinPartitions("part", "event_id")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    return path


def log_part() -> Column:
    """Which file of the spoiled log a row comes from."""
    return F.regexp_extract("file", "part=([0-9]+)", 1).cast("long")


@register("json_line_numbers", f"SELECT part, line, fault FROM ({_SPOILED_SQL}) WHERE fault IS NOT NULL")
def json_line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """File, line number and fault of every bad line."""
    return tables.bad_lines(spark, spoiled_log(spark, folder)).select(log_part().alias("part"), "line", "fault")


@register(
    "history_append",
    """SELECT run, event_type, count(*) AS n FROM (SELECT event_type, unnest(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN ['first', 'second'] ELSE ['second'] END) AS run FROM events)
GROUP BY ALL UNION ALL SELECT 'latest', event_type, count(*) FROM events GROUP BY ALL""",
)
def history_append(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs: the latest result is replaced, the history keeps both."""
    events = table(spark, folder, "events")
    base = scratch_path(spark, "runs")
    half = events.where(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"))
    for name, rows in (("first", half), ("second", events)):
        counts = rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
        sinks.write_latest_with_history(
            counts.select(F.lit(name).alias("run"), "event_type", "n"), f"{base}/latest", f"{base}/history"
        )
    layout = "run string, event_type string, n long"
    latest = spark.read.schema(layout).json(f"{base}/latest").withColumn("run", F.lit("latest"))
    return spark.read.schema(layout).json(f"{base}/history").unionByName(latest)


# --- jobs -------------------------------------------------------------------


@register(
    "featurize_job",
    f"""WITH {_CLEAN}, interim AS (SELECT DISTINCT "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
  "IsActiveMember", "EstimatedSalary", "Exited", "Complain", "Satisfaction Score", "Card Type", "Point Earned" FROM raw),
sizes AS (SELECT "Exited", count(*) AS n, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS t FROM interim GROUP BY 1)
SELECT 'test' AS split, "Exited", t AS n, 15 AS n_features FROM sizes UNION ALL SELECT 'train', "Exited", n - t, 15 FROM sizes""",
)
def featurize_job(spark: SparkSession, folder: str) -> DataFrame:
    made = jobs.featurize(raw_customers(spark, folder), scratch_path(spark, "features"))
    both = made.train.withColumn("split", F.lit("train")).unionByName(made.test.withColumn("split", F.lit("test")))
    return both.groupBy("split", "Exited").agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(made.train.columns) - 1).alias("n_features")
    )


_EXPORTED = ["CreditScore", "Age", "Balance", "BalancePerProduct", "PointsPerSalary"]
_EXPORTED_SQL = {"CreditScore": "f1", "Age": "f2", "Balance": "f4", "BalancePerProduct": "f10", "PointsPerSalary": "f11"}


@register(
    "feature_export_job",
    f"""WITH {_CLEAN}, {_BASE_FEATURES}
SELECT "CustomerId" AS customer_id, strftime(TIMESTAMP '2024-01-01' + to_minutes(row_number() OVER (ORDER BY "CustomerId") - 1), '%Y-%m-%d %H:%M:%S') AS event_timestamp,
       card::DOUBLE AS "Card Type", {", ".join(f'{_scaled_sql(_EXPORTED_SQL[c])} AS "{c}"' for c in _EXPORTED)} FROM base""",
)
def feature_export_job(spark: SparkSession, folder: str) -> DataFrame:
    raw = raw_customers(spark, folder)
    export = jobs.export_features(raw, ChurnEncoder().fit(raw), scratch_path(spark, "export"))
    shown = export.select(
        "customer_id",
        F.date_format("event_timestamp", "yyyy-MM-dd HH:mm:ss").alias("event_timestamp"),
        "Card Type", *_EXPORTED,
    )
    return _rounded(shown, _EXPORTED)


_DRIFT_FEATURES = ["card", "gender", "ger", "spa", *[f"f{i}" for i in range(1, 12)]]


@register(
    "drift_job",
    f"""WITH {_CLEAN}, {_BASE_FEATURES},
sides AS (SELECT * REPLACE (CASE WHEN "CustomerId" % 3 = 0 THEN least(100, f2 + 20) ELSE f2 END AS f2), "CustomerId" % 3 > 0 AS is_ref FROM base),
{_psi_sql('sides', _DRIFT_FEATURES, 'is_ref')}
SELECT CASE WHEN max(psi) >= 0.2 THEN 'critical' WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'ok' END AS status,
       round(max(psi), 6) AS max_feature_psi, round(avg(psi), 6) AS mean_feature_psi, count(*) FILTER (psi >= 0.1) AS n_drifted,
       (SELECT count(*) FROM sides WHERE is_ref) AS reference_row_count, (SELECT count(*) FROM sides WHERE NOT is_ref) AS current_row_count,
       max(psi) >= 0.2 AS retraining_recommended, CASE WHEN max(psi) >= 0.2 THEN 1 ELSE 0 END AS n_requests FROM psi""",
)
def drift_job(spark: SparkSession, folder: str) -> DataFrame:
    """The monitoring job over encoded customers, a third of them twenty years older."""
    raw = raw_customers(spark, folder)
    older = F.when(F.col("CustomerId") % 3 == 0, F.least(F.lit(100), F.col("Age") + 20)).otherwise(F.col("Age"))
    encoder = ChurnEncoder(passthrough=["CustomerId"]).fit(raw)
    encoded = through_table(encoder.transform(raw.withColumn("Age", older.cast("long"))), "encoded")
    run = jobs.monitor_drift(
        encoded.where(F.col("CustomerId") % 3 > 0), encoded.where(F.col("CustomerId") % 3 == 0),
        output=scratch_path(spark, "drift"), created_at="2024-01-01T00:00:00-03:00",
    )
    return run.metrics.select(
        "status", F.round("max_feature_psi", 6).alias("max_feature_psi"),
        F.round("mean_feature_psi", 6).alias("mean_feature_psi"),
        F.size("drifted_features").alias("n_drifted"), "reference_row_count", "current_row_count",
        "retraining_recommended", F.lit(run.request.count()).alias("n_requests"),
    )


# --- synthetic batches ------------------------------------------------------


def _uniform_sql(column: str, seed: int, label: str) -> str:
    return (
        f"(('0x' || substr(md5({column}::VARCHAR || '|{seed}|{label}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE)"
    )


_BOOTSTRAP_SQL = """idx AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
size AS (SELECT count(*) AS n FROM customer),
draws AS (SELECT d.id AS draw_id, CAST(floor({u} * n) AS BIGINT) AS pos FROM (SELECT unnest(generate_series(0, (SELECT n FROM size) - 1)) AS id) d, size)"""


@register(
    "bootstrap_sample",
    f"""WITH {_BOOTSTRAP_SQL.format(u=_uniform_sql('d.id', 42, 'bootstrap'))}
SELECT draw_id, c_custkey FROM draws JOIN idx USING (pos)""",
)
def bootstrap_sample(spark: SparkSession, folder: str) -> DataFrame:
    """As many draws with replacement as there are customers."""
    base = table(spark, folder, "customer").select("c_custkey")
    return synthetic.bootstrap(base, [F.col("c_custkey")], base.count()).select("draw_id", "c_custkey")


def _normal_sql(label: str, mean: float, deviation: float, seed: int) -> str:
    r, t = _uniform_sql("draw_id", seed, label + ":r"), _uniform_sql("draw_id", seed, label + ":t")
    return (
        f"({mean}::DOUBLE + {deviation}::DOUBLE * (sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {r})) * cos(6.283185307179586::DOUBLE * {t})))"
    )


@register(
    "synthetic_age_drift",
    f"""WITH {_BOOTSTRAP_SQL.format(u=_uniform_sql('d.id', 43, 'bootstrap'))}
SELECT draw_id, c_custkey, CAST(greatest(58, least(92, round_even({_normal_sql('age_drift:Age', 72, 8, 43)}, 0))) AS INTEGER) AS "Age",
       CAST(floor({_uniform_sql('draw_id', 43, 'age_drift:Tenure')} * 4) AS INTEGER) AS "Tenure",
       CASE WHEN {_uniform_sql('draw_id', 43, 'age_drift:Geography')} < 2.0::DOUBLE / 3 THEN 'Germany' ELSE 'Spain' END AS "Geography"
FROM draws JOIN idx USING (pos)""",
)
def synthetic_age_drift(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "customer").select(
        "c_custkey", F.lit(0).alias("Age"), F.lit(0).alias("Tenure"), F.lit("").alias("Geography")
    )
    batch = synthetic.scenario_batch(base, [F.col("c_custkey")], "age_drift", base.count())
    return batch.select("draw_id", "c_custkey", "Age", "Tenure", "Geography")


_PRESET_KINDS = {
    "CreditScore": "long", "Age": "long", "Tenure": "long", "Balance": "double", "NumOfProducts": "long",
    "IsActiveMember": "long", "EstimatedSalary": "double", "Geography": "string", "Card Type": "string",
    "Point Earned": "long",
}


def _rule_sql(label: str, seed: int, rule: tuple) -> str:
    """A preset's rule for one column, over ``draw_id``."""
    kind, *args = rule

    def clipped(value: str, low, high) -> str:
        value = value if high is None else f"least({high}::DOUBLE, {value})"
        return value if low is None else f"greatest({low}::DOUBLE, {value})"

    def chosen(options: list) -> str:
        cases, bound = [], 0.0
        for value, weight in options[:-1]:
            bound += weight
            cases.append(f"WHEN {_uniform_sql('draw_id', seed, label)} < {bound!r}::DOUBLE THEN {value!r}")
        return f"CASE {' '.join(cases)} ELSE {options[-1][0]!r} END" if cases else repr(options[-1][0])

    if kind == "integers":
        low, high = args
        return f"CAST({low} + floor({_uniform_sql('draw_id', seed, label)} * {high - low + 1}) AS BIGINT)"
    if kind == "choice":
        return chosen(args[0])
    if kind in ("normal", "int_normal"):
        mean, deviation, low, high = args
        value = _normal_sql(label, mean, deviation, seed)
    else:
        options, deviation, low, high = args
        value = f"(({chosen(options)})::DOUBLE + {_normal_sql(label + ':noise', 0, deviation, seed)})"
    if kind.startswith("int_"):
        return f"CAST({clipped(f'round_even({value}, 0)', low, high)} AS BIGINT)"
    return f"round({clipped(value, low, high)}, 3)"


def _register_preset(scenario: str) -> None:
    preset = synthetic.PRESETS[scenario]
    seed = 42 + synthetic.SCENARIOS.index(scenario)
    rules = ", ".join(f'{_rule_sql(f"{scenario}:{name}", seed, rule)} AS "{name}"' for name, rule in preset.items())

    @register(
        f"synthetic_{scenario}_values",
        f"""WITH {_BOOTSTRAP_SQL.format(u=_uniform_sql('d.id', seed, 'bootstrap'))}
SELECT draw_id, c_custkey, {rules} FROM draws JOIN idx USING (pos)""",
    )
    def run(spark: SparkSession, folder: str) -> DataFrame:
        blank = [F.lit(None).cast(_PRESET_KINDS[c]).alias(c) for c in preset]
        base = table(spark, folder, "customer").select("c_custkey", *blank)
        batch = synthetic.scenario_batch(base, [F.col("c_custkey")], scenario, base.count())
        rounded = {c: F.round(c, 3) for c in preset if _PRESET_KINDS[c] == "double"}
        return batch.withColumns(rounded).select("draw_id", "c_custkey", *preset) if rounded else batch


for _scenario in ("wealth_drift", "high_risk_prediction_drift", "mixed_extreme_drift"):
    _register_preset(_scenario)


@register("synthetic_drift_psi")
def synthetic_drift_psi(spark: SparkSession, folder: str) -> DataFrame:
    """Stability of every scenario batch, each as large as the base, against the base."""
    base = through_table(raw_customers(spark, folder), "base")
    rows = base.count()
    whole = None
    for scenario in synthetic.SCENARIOS:
        batch = synthetic.scenario_batch(base, [F.col("CustomerId")], scenario, rows)
        named = batch.withColumn("scenario_name", F.lit(scenario))
        whole = named if whole is None else whole.unionByName(named)
    columns = ["CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "EstimatedSalary", "Point Earned",
               "Geography", "Card Type"]
    psi = drift.feature_psi(base, through_table(whole, "scenarios"), columns, keys=["scenario_name"])
    return psi.select("scenario_name", "feature", F.round("psi", 6).alias("psi"))


# --- models -----------------------------------------------------------------


def _feature_set(spark: SparkSession, folder: str) -> tuple[DataFrame, jobs.FeatureSet]:
    raw = through_table(raw_customers(spark, folder), "raw")
    return raw, jobs.featurize(raw)


def _scored_flag(df: DataFrame, *more: str) -> DataFrame:
    """Whether a row got a probability, in place of the probability itself."""
    scored = F.coalesce(F.col("churn_probability").between(0.0, 1.0), F.lit(False))
    return df.select("index", "status", "error", scored.alias("scored"), *more)


@register("train_metrics")
def train_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metric rows of one trained model."""
    _, made = _feature_set(spark, folder)
    _, found = jobs.train_and_evaluate(through_table(made.train, "train"), made.test, CHAMPION)
    return found


@register("feature_importance")
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    raw, made = _feature_set(spark, folder)
    return scoring.feature_importance(scoring.train(through_table(made.train, "train"), FOREST), raw)


_SWEPT_SQL = ", ".join(f"('{e.name}', '{e.algorithm}', '{e.version}')" for e in EXPERIMENTS)


@register(
    "experiment_sweep",
    f"""WITH {_CLEAN}, interim AS (SELECT DISTINCT "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard",
  "IsActiveMember", "EstimatedSalary", "Exited", "Complain", "Satisfaction Score", "Card Type", "Point Earned" FROM raw),
sizes AS (SELECT "Exited", CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS t FROM interim GROUP BY 1)
SELECT model, algorithm, model_version, (SELECT sum(t)::BIGINT FROM sizes) AS n_test, (SELECT sum(t)::BIGINT FROM sizes WHERE "Exited" = 1) AS n_positive,
       7 AS n_metrics, TRUE AS agrees FROM (VALUES {_SWEPT_SQL}) e(model, algorithm, model_version)""",
)
def experiment_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """The eight experiments over the same split; their recorded metrics against SQL over the stored scores."""
    _, made = _feature_set(spark, folder)
    output = scratch_path(spark, "sweep")
    jobs.sweep(made.train, made.test, EXPERIMENTS, output=output)
    recorded = spark.read.json(f"{output}/metrics")
    return spark.sql(
        """WITH cells AS (
  SELECT model, count(*) AS n_test, count_if(label = 1) AS n_positive, count_if(label = 1 AND score >= 0.5) AS tp,
         count_if(label = 0 AND score >= 0.5) AS fp, count_if((label = 1) = (score >= 0.5)) AS right
  FROM {scores} WHERE score BETWEEN 0 AND 1 GROUP BY model),
found AS (
  SELECT model, algorithm, model_version, count(*) AS n_metrics, count_if(NOT value BETWEEN 0 AND 1) AS odd,
         max(value) FILTER (WHERE metric = 'accuracy') AS accuracy, max(value) FILTER (WHERE metric = 'precision') AS `precision`,
         max(value) FILTER (WHERE metric = 'recall') AS recall, max(value) FILTER (WHERE metric = 'f1') AS f1
  FROM {recorded} GROUP BY ALL)
SELECT model, algorithm, model_version, n_test, n_positive, CAST(n_metrics AS INT) AS n_metrics,
       odd = 0 AND abs(accuracy - right / n_test) < 1e-9 AND abs(`precision` - coalesce(try_divide(tp, tp + fp), 0)) < 1e-9
       AND abs(recall - coalesce(try_divide(tp, n_positive), 0)) < 1e-9
       AND abs(f1 - coalesce(try_divide(2 * tp, n_positive + tp + fp), 0)) < 1e-9 AS agrees
FROM cells JOIN found USING (model)""",
        scores=spark.read.parquet(f"{output}/scores"), recorded=recorded,
    )


@register("retrain_decision")
def retrain_decision(spark: SparkSession, folder: str) -> DataFrame:
    """A challenger trained for a request and held against the champion."""
    _, made = _feature_set(spark, folder)
    train = through_table(made.train, "train")
    _, champion = jobs.train_and_evaluate(train, made.test, CHAMPION)
    request = {"request_id": "1f2e-req", "promotion_rules": {"primary_metric": "recall", "metric_weights": {"recall": 1.0}}}
    decision = jobs.retrain_and_decide(
        request, FOREST, train, made.test, champion, CHAMPION.name, scratch_path(spark, "retrain")
    )
    return decision.select("request_id", "challenger", "criteria", "status", "reason", "recommended_action")


@register(
    "batch_predict_raw",
    f"""WITH {raw_customers_sql(clean=False)}
SELECT "CustomerId" AS "index", CASE WHEN "Balance" < 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN "Balance" < 0 THEN 'Balance: Input should be greater than or equal to 0' END AS error, "Balance" >= 0 AS scored, TRUE AS same_score FROM raw""",
)
def batch_predict_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a raw request, scored by an encoder and a model read back from disk.

    Those with a negative balance fail with a reason; scores equal those of the model as trained.
    """
    _, made = _feature_set(spark, folder)
    model = scoring.train(through_table(made.train, "train"), CHAMPION)
    path = scratch_path(spark, "scorer")
    made.encoder.write().overwrite().save(f"{path}/encoder")
    model.write().overwrite().save(f"{path}/model")
    requests = raw_customers(spark, folder, clean=False).withColumnRenamed("RowNumber", "index")
    trained = scoring.predict_raw(requests, made.encoder, model, CHAMPION)
    loaded = scoring.predict_raw(
        requests, ChurnEncoderModel.load(f"{path}/encoder"), scoring.load_scorer(f"{path}/model"), CHAMPION
    )
    expected = trained.select("index", F.col("churn_probability").alias("_expected"))
    same = F.col("churn_probability").eqNullSafe(F.col("_expected"))
    return _scored_flag(loaded.join(expected, "index").withColumn("same_score", same), "same_score")


@register(
    "batch_predict_lookup",
    f"""WITH {_CLEAN}
SELECT o_orderkey AS "index", CASE WHEN "CustomerId" IS NULL OR o_custkey <= 0 THEN 'error' ELSE 'ok' END AS status,
       CASE WHEN o_custkey <= 0 THEN 'customer_id: Input should be greater than 0' WHEN "CustomerId" IS NULL THEN 'Cliente não encontrado na Feature Store.' END AS error, "CustomerId" IS NOT NULL AND o_custkey > 0 AS scored
FROM orders LEFT JOIN (SELECT * FROM raw WHERE "NumOfProducts" > 1) ON o_custkey = "CustomerId" """,
)
def batch_predict_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Every order asks for its customer; half of the customers are in the store."""
    raw, made = _feature_set(spark, folder)
    model = scoring.train(through_table(made.train, "train"), CHAMPION)
    export = jobs.export_features(raw.where(F.col("NumOfProducts") > 1), made.encoder)
    online = featurestore.latest_features(export)
    requests = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("index"), F.col("o_custkey").alias("customer_id")
    )
    return _scored_flag(scoring.predict_lookup(requests, online, model, CHAMPION))


@register("synthetic_prediction_log")
def synthetic_prediction_log(spark: SparkSession, folder: str) -> DataFrame:
    """Drifted inputs scored into the log layout, and their manifest row."""
    raw, made = _feature_set(spark, folder)
    model = scoring.train(through_table(made.train, "train"), CHAMPION)
    path = scratch_path(spark, "log")
    jobs.prediction_log(raw, "CustomerId", made.encoder, model, CHAMPION, raw.count(), True,
                        "2024-01-01T00:00:00-03:00", output=path)
    log = spark.read.schema(schemas.INFERENCE_LOG).json(path)
    return scoring.batch_manifest(log, ["model_name", "monitoring_contract", "feature_source"])
