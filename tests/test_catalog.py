import math
import os

import pytest

from tidegauge.catalog import REGISTRY

FOLDER = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]
# Covered by the whole-job tests; slow to repeat here.
TRAINED = {"train_metrics", "feature_importance", "experiment_sweep", "retrain_decision", "synthetic_prediction_log",
           "synthetic_drift_psi"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=0, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", [n for n, e in REGISTRY.items() if e.sql and n not in TRAINED])
def test_query_equals_its_sql(spark, duck, name):
    entry = REGISTRY[name]
    found = entry.run(spark, FOLDER)
    cursor = duck.execute(entry.sql)
    names = [c[0] for c in cursor.description]
    assert sorted(found.columns) == sorted(names)
    order = sorted(names)
    left = sorted((tuple(r[c] for c in order) for r in found.collect()), key=repr)
    right = sorted((tuple(r[names.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    assert len(left) == len(right)
    assert all(same(x, y) for a, b in zip(left, right) for x, y in zip(a, b))
