import pytest
from pyspark.sql import functions as F

from tidegauge.catalog import jobs as queries
from tidegauge.operators import boosting, scoring
from tidegauge.plans import customers

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    a, b, c = (F.floor(F.rand(k) * 40) for k in (1, 2, 3))
    return spark.range(400, numPartitions=1).select(
        *[x.cast("double").alias(n) for n, x in zip(NAMES, (a, b, c))], (F.rand(4) + F.rand(1) > 1).cast("int").alias("y")
    ).localCheckpoint()


def trained(table, params, **more):
    model = scoring.train(table, scoring.Experiment("m", "xgboost", params=params), NAMES, "y", **more)
    return sorted(tuple(r) for r in scoring.score(model, table).select(*NAMES, F.round("churn_probability", 9)).collect())


def test_trainings_side_by_side_share_the_cores():
    """By the levels that each has to grow; forests are few jobs and keep all cores."""
    shared = customers.shared_cores(queries.EXPERIMENTS, 8, 12)
    assert shared == {"gradient_boosting_v1": 1, "gradient_boosting_v2_more_trees": 2, "gradient_boosting_v3_smoother": 1,
                      "gradient_boosting_v4_more_signal": 2, "xgboost_v1": 5}
    assert customers.shared_cores(queries.EXPERIMENTS, 1, 12) == {name: 12 for name in shared}
    assert customers.shared_cores([queries.CHAMPION, queries.FOREST], 8, 12) == {queries.CHAMPION.name: 12}


def test_sums_of_chunks_of_blocks_of_fewer_cores_give_the_same_model(table, monkeypatch):
    params = {"n_estimators": 2, "max_depth": 7, "min_child_weight": 0.1, "subsample": 0.8, "random_state": 3}
    expected = trained(table, params)
    asked, aside = [], []
    make, grow = boosting._blocks, boosting.grow
    monkeypatch.setattr(boosting, "_blocks", lambda rows, edges, parts, start: asked.append(parts) or make(rows, edges, parts, start))

    def grown(*given, **more):
        found = grow(*given, **more)
        aside.append(len(found[1]))
        return found

    monkeypatch.setattr(boosting, "grow", grown)
    monkeypatch.setattr(boosting, "LOCAL_ROWS", 150)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 20)
    monkeypatch.setattr(boosting, "_CHUNK_ROWS", 7)
    for moved in (0, 1000):
        monkeypatch.setattr(boosting, "MOVED_ROWS", moved)
        assert trained(table, params, tasks=2) == expected
    assert asked == [2, 2] and max(aside) > 0
