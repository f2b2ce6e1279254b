import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tidegauge.operators import boosting, scoring

NAMES = ["a", "b", "c"]


def rows_of(n, seed=3, distinct=9):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, distinct, (n, 3)).astype(float)
    x[:, 2] /= 4
    y = (x[:, 0] + 2 * x[:, 1] + rng.normal(0, 3, n) > 12).astype(float)
    return x, y


@pytest.fixture(scope="module")
def table(spark):
    x, y = rows_of(200)
    return spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int").repartition(3)


def trained(table, params, algorithm="xgboost"):
    return scoring.train(table, scoring.Experiment("m", algorithm, params=params), NAMES, "y")


def scores(model, table):
    return sorted(tuple(r) for r in scoring.score(model, table).select(*NAMES, F.round("churn_probability", 9)).collect())


def brute_split(x, g, h, l2=1.0, least=1.0):
    """The best first split, by trying every threshold of every feature."""
    def worth(keep):
        return g[keep].sum() ** 2 / (h[keep].sum() + l2)

    best = (0.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] < (low + high) / 2
            if min(h[left].sum(), h[~left].sum()) < least:
                continue
            gain = worth(left) + worth(~left) - worth(np.ones(len(g), bool))
            if gain > best[0] + 1e-9:
                best = (gain, f, (low + high) / 2)
    return best


def test_first_splits_equal_brute_force(table):
    x, y = rows_of(200)
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))
    learned = trained(table, {"n_estimators": 1, "max_depth": 2}).stages[-1].table()
    gain, f, cut = brute_split(x, g, h)
    assert learned["feature"][0] == f and learned["threshold"][0] == cut and abs(learned["gain"][0] - gain) < 1e-9
    left = x[:, f] < cut
    for child, keep in ((learned["left"][0], left), (learned["right"][0], ~left)):
        gain, f2, cut2 = brute_split(x[keep], g[keep], h[keep])
        assert (learned["feature"][child], learned["threshold"][child]) == (f2, cut2)
        assert abs(learned["gain"][child] - gain) < 1e-9
        for leaf, own in ((learned["left"][child], x[keep][:, f2] < cut2), (learned["right"][child], x[keep][:, f2] >= cut2)):
            assert abs(learned["value"][leaf] + 0.3 * g[keep][own].sum() / (h[keep][own].sum() + 1.0)) < 1e-9


def test_nodes_by_levels_or_in_one_task_and_any_partitioning_give_one_model(table, monkeypatch):
    params = {"n_estimators": 3, "max_depth": 4, "subsample": 0.8, "colsample_bytree": 0.7, "random_state": 5}
    expected = scores(trained(table, params), table)
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 200 * 35 // 3)
    for rows in (0, 60):
        monkeypatch.setattr(boosting, "LOCAL_ROWS", rows)
        assert scores(trained(table.repartition(5), params), table) == expected


@pytest.mark.parametrize("algorithm, changed", [
    ("xgboost", [{"n_estimators": 4}, {"learning_rate": 0.1}, {"max_depth": 2}, {"min_child_weight": 8}, {"reg_lambda": 9},
                 {"reg_alpha": 2}, {"gamma": 3}, {"subsample": 0.6}, {"colsample_bytree": 0.4}, {"max_bin": 4}, {"base_score": 0.5},
                 {"scale_pos_weight": 3}]),
    ("gradient_boosting", [{"n_estimators": 4}, {"learning_rate": 0.2}, {"max_depth": 2}, {"min_samples_leaf": 20},
                           {"min_samples_split": 60}, {"subsample": 0.6}, {"max_features": 1}]),
])
def test_each_parameter_changes_the_model(table, algorithm, changed):
    plain = {"n_estimators": 3, "max_depth": 3, "random_state": 1}
    before = scores(trained(table, plain, algorithm), table)
    assert scores(trained(table, plain, algorithm), table) == before
    for more in changed:
        assert scores(trained(table, {**plain, **more}, algorithm), table) != before, more


def test_parameters_that_cannot_be_kept_are_refused():
    for algorithm, params in (("xgboost", {"objective": "reg:squarederror"}), ("xgboost", {"max_leaves": 3}),
                              ("random_forest", {"min_samples_split": 5}), ("gradient_boosting", {"loss": "exponential"}),
                              ("logistic_regression", {"penalty": "elasticnet"}), ("logistic_regression", {"C": 2.0})):
        with pytest.raises(ValueError):
            scoring.build_classifier(algorithm, params)
    assert scoring.build_classifier("random_forest", {"max_features": "sqrt", "bootstrap": False}).getFeatureSubsetStrategy() == "3"
    assert scoring.build_classifier("random_forest", {"max_features": None}).getFeatureSubsetStrategy() == "all"
    built = scoring.build_classifier("logistic_regression", {"C": 0.5, "penalty": "l1"}, rows=100)
    assert (built.getRegParam(), built.getElasticNetParam()) == (0.02, 1.0)


def test_loss_falls_and_a_saved_model_scores_alike(spark, table, tmp_path):
    x, y = rows_of(200)
    model = trained(table, {"n_estimators": 30, "max_depth": 3, "subsample": 0.9})
    found = scoring.score(model, table)
    loss = found.select(F.avg(-F.log(F.when(F.col("y") == 1, F.col("churn_probability")).otherwise(1 - F.col("churn_probability"))))).first()[0]
    prior = y.mean()
    assert loss < -0.6 * (prior * np.log(prior) + (1 - prior) * np.log(1 - prior))
    importance = model.stages[-1].featureImportances.toArray()
    assert abs(importance.sum() - 1) < 1e-9 and importance[1] > importance[2]
    model.write().overwrite().save(str(tmp_path / "m"))
    assert scores(PipelineModel.load(str(tmp_path / "m")), table) == scores(model, table)


def test_missing_values_and_constant_columns(spark):
    rows = [(None if k % 3 else float(k), 1.0, float("nan"), int(k % 3 == 0)) for k in range(60)]
    table = spark.createDataFrame(rows, "a double, b double, c double, y int").fillna(float("nan"), ["a"])
    rules = boosting.Rules(rounds=3, depth=2)
    from pyspark.ml.feature import VectorAssembler

    made = VectorAssembler(inputCols=NAMES, outputCol="v", handleInvalid="keep").transform(table.na.fill({"a": float("nan")}))
    model = boosting.NewtonBoosting("v", "y", rules).fit(made)
    found = model.transform(made).groupBy("y").agg(F.min("prediction").alias("low"), F.max("prediction").alias("high")).collect()
    assert {r.y: (r.low, r.high) for r in found} == {0: (0.0, 0.0), 1: (1.0, 1.0)}
    with pytest.raises(ValueError):
        boosting.NewtonBoosting("v", "y", rules).fit(made.limit(0))
