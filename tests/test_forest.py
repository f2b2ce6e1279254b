import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidegauge.operators import boosting, forest, scoring

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (600, 3)).astype(float)
    y = x[:, 0] + 2 * x[:, 1] + rng.normal(0, 20, 600) > 60
    return spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, y int").repartition(3)


def trained(table, **params):
    given = {"n_estimators": 5, "max_depth": 6, "min_samples_leaf": 2, "random_state": 4, "class_weight": "balanced", **params}
    return scoring.train(table, scoring.Experiment("m", "random_forest", params=given), NAMES, "y")


def scores(model, table):
    return sorted(tuple(r) for r in scoring.score(model, table).select(*NAMES, "churn_probability").collect())


def test_a_forest_is_grown_in_a_few_jobs_whatever_its_trees_and_depth(spark, table):
    made = VectorAssembler(inputCols=NAMES, outputCol="v").transform(table)
    context = spark.sparkContext
    jobs = []
    for trees, depth in ((2, 3), (40, 12)):
        context.setJobGroup(f"forest-{trees}", "jobs of one training")
        built = scoring.build_classifier("random_forest", {"n_estimators": trees, "max_depth": depth}, features=3)
        assert isinstance(built, forest.Forest)
        built.columns = ("v", "y", None)
        assert built.fit(made).getNumTrees() == trees
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"forest-{trees}")))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_nodes_by_levels_or_in_one_task_any_spread_and_any_batch_give_one_model(table, monkeypatch):
    expected = scores(trained(table), table)
    for rows, block, moved in ((0, 100, 1), (150, 50, 600 * 5 * 2), (10_000, 5, 1 << 30)):
        monkeypatch.setattr(forest, "LOCAL_ROWS", rows)
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        monkeypatch.setattr(forest, "MOVED_BYTES", moved)
        monkeypatch.setattr(forest, "NODES_AT_ONCE", 3)
        assert scores(trained(table.repartition(5)), table) == expected


def brute_split(x, y, w, least):
    """The best first split by Gini impurity, by trying every threshold of every feature."""
    def impurity(keep):
        p, whole = (w * y)[keep].sum(), w[keep].sum()
        return 2 * p * (whole - p) / whole

    best = (0.0, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] < (low + high) / 2
            if min(left.sum(), (~left).sum()) >= least:
                gain = impurity(np.ones(len(y), bool)) - impurity(left) - impurity(~left)
                if gain > best[0] + 1e-9:
                    best = (gain, f, (low + high) / 2)
    return best


def test_a_tree_equals_brute_force(table):
    """Two levels of a tree over all rows and features."""
    rows = np.array(table.collect(), float)
    x, y = rows[:, :3], rows[:, 3]
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    model = trained(table, n_estimators=1, max_depth=2, min_samples_leaf=20).stages[-1]
    tree = model.trees[0]
    gains = np.zeros(3)

    def check(node, keep, depth):
        gain, f, cut = brute_split(x[keep], y[keep], w[keep], 20) if depth < 2 else (0.0, None, None)
        if f is None:
            assert tree.feature[node] == -1
            assert tree.share[node] == pytest.approx((w * y)[keep].sum() / w[keep].sum(), rel=1e-6)
            return
        assert tree.feature[node] == f and model.edges[f][tree.cut[node]] == cut
        gains[f] += gain
        check(tree.left[node], keep & (x[:, f] < cut), depth + 1)
        check(tree.right[node], keep & (x[:, f] >= cut), depth + 1)

    check(0, np.ones(len(y), bool), 0)
    assert tree.gain == pytest.approx(gains)
    assert model.featureImportances.toArray() == pytest.approx(gains / gains.sum())


def test_each_parameter_changes_the_model_and_a_seed_repeats_it(table):
    before = scores(trained(table), table)
    assert scores(trained(table), table) == before
    for more in ({"n_estimators": 4}, {"max_depth": 3}, {"min_samples_leaf": 20}, {"random_state": 5}, {"class_weight": None},
                 {"max_features": 1}, {"max_features": None}, {"bootstrap": False}):
        assert scores(trained(table, **more), table) != before, more


def test_rows_are_drawn_about_once_and_features_are_dealt_evenly():
    growth = forest.Growth(3, 1, 4, True, 42, 15, 9, np.ones(2), np.arange(2.0), 0.5)
    keys = np.arange(50_000, dtype=np.uint64)
    times = forest._times(keys, growth, 7)
    assert abs(times.mean() - 1) < 0.02 and abs(times.var() - 1) < 0.03
    assert abs(np.corrcoef(times, forest._times(keys, growth, 8))[0, 1]) < 0.02
    chosen = forest._chosen(growth, 7, np.arange(1, 3001))
    assert all(len(set(c)) == 4 for c in chosen)
    assert np.all(np.abs(np.bincount(chosen.ravel(), minlength=15) - 800) < 120)


def test_quality_and_a_saved_model(spark, table, tmp_path):
    from pyspark.ml.classification import RandomForestClassifier

    model = trained(table, n_estimators=40)
    made = VectorAssembler(inputCols=NAMES, outputCol="v").transform(table)
    plain = RandomForestClassifier(featuresCol="v", labelCol="y", numTrees=40, maxDepth=6, minInstancesPerNode=2, seed=4).fit(made)
    right = lambda df: df.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]
    assert right(model.transform(table)) > right(plain.transform(made)) - 0.03
    importance = model.stages[-1].featureImportances.toArray()
    assert abs(importance.sum() - 1) < 1e-9 and importance[1] > importance[0] > importance[2]
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert scores(again, table) == scores(model, table)
    assert list(again.stages[-1].featureImportances.toArray()) == list(importance)


def test_equal_rows_are_drawn_one_by_one(spark, monkeypatch):
    """Two kinds of rows, a thousand copies of each; every tree sees both about evenly."""
    table = spark.range(2000).selectExpr("double(id % 2) as a", "0D as b", "0D as c", "int(id % 8 = 0 or id % 2 = 1) as y")
    monkeypatch.setattr(forest, "_COPIES_AT_ONCE", 300)
    model = trained(table, n_estimators=30, max_features=None, class_weight=None)
    for tree in model.stages[-1].trees:
        shares = tree.share[tree.feature < 0]
        assert sorted(shares)[-1] == 1.0 and abs(min(shares) - 0.25) < 0.08


def test_missing_values_one_class_and_faulty_rows(spark):
    rows = [(float("nan") if k % 3 else float(k), 1.0, int(k % 3 == 0)) for k in range(60)]
    made = VectorAssembler(inputCols=["a", "b"], outputCol="v", handleInvalid="keep").transform(
        spark.createDataFrame(rows, "a double, b double, y int"))
    found = forest.Forest("v", "y", numTrees=3, featureSubsetStrategy="all").fit(made).transform(made)
    assert {(r.y, r.prediction) for r in found.collect()} == {(0, 0.0), (1, 1.0)}
    alone = forest.Forest("v", "y", numTrees=2).fit(made.where("y = 1")).transform(made)
    assert {r.probability[1] for r in alone.collect()} == {1.0}
    for bad in (made.limit(0), made.withColumn("y", F.lit(2))):
        with pytest.raises(ValueError):
            forest.Forest("v", "y").fit(bad)
