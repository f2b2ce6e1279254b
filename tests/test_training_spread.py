import pytest
from pyspark.sql import functions as F

from tidegauge.operators import boosting, scoring
from tidegauge.plans import customers

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    a, b, c = (F.floor(F.rand(k) * 40) for k in (1, 2, 3))
    return spark.range(400, numPartitions=1).select(
        *[x.cast("double").alias(n) for n, x in zip(NAMES, (a, b, c))], (F.rand(4) + F.rand(1) > 1).cast("int").alias("y")
    ).localCheckpoint()


def trained(table, params):
    model = scoring.train(table, scoring.Experiment("m", "xgboost", params=params), NAMES, "y")
    return sorted(tuple(r) for r in scoring.score(model, table).select(*NAMES, F.round("churn_probability", 9)).collect())


def test_many_rows_are_trained_on_by_all_cores_and_give_the_same_model(spark, table, monkeypatch):
    params = {"n_estimators": 2, "max_depth": 7, "min_child_weight": 0.1, "subsample": 0.8, "random_state": 3}
    expected = trained(table, params)
    asked, aside = [], []
    make, grow = boosting._blocks, boosting.grow

    def blocks(rows, edges, parts, start):
        asked.append(parts)
        return make(rows, edges, parts, start)

    def grown(*given, **more):
        found = grow(*given, **more)
        aside.append(len(found[1]))
        return found

    monkeypatch.setattr(boosting, "_blocks", blocks)
    monkeypatch.setattr(boosting, "grow", grown)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 150)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 20)
    assert trained(table, params) == expected
    assert asked == [spark.sparkContext.defaultParallelism]
    assert max(aside) > 0


def test_placing_split_by_split_or_row_by_row_is_the_same(table, monkeypatch):
    params = {"n_estimators": 2, "max_depth": 5, "random_state": 3}
    expected = trained(table, params)
    monkeypatch.setattr(boosting, "_MASKED_SPLITS", 0)
    assert trained(table, params) == expected


def test_a_training_table_of_many_rows_has_a_partition_for_each_core(spark, table, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    assert customers.sized(table).rdd.getNumPartitions() == 1
    monkeypatch.setattr(customers, "_TRAIN_ROWS", 50)
    assert customers.sized(table).rdd.getNumPartitions() == cores
