import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge import schemas
from tidegauge.operators import featurestore, opsmetrics


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_event_times_are_one_minute_apart(spark):
    data = spark.range(50).repartition(4)
    got = featurestore.with_event_times(data, [F.col("id")]).orderBy("id").collect()
    assert [r["event_timestamp"] for r in got] == [at(i) for i in range(50)]


def test_late_facts_do_not_replace_newer_ones(spark):
    layout = "customer_id long, event_timestamp timestamp, created_timestamp timestamp, x int"
    first = spark.createDataFrame([(1, at(10), at(10), 1), (2, at(5), at(5), 2)], layout)
    late = spark.createDataFrame([(1, at(3), at(99), 7), (2, at(5), at(6), 8), (3, at(1), at(1), 9)], layout)
    online = featurestore.materialize(featurestore.materialize(None, first), late)
    assert {r["customer_id"]: r["x"] for r in online.collect()} == {1: 1, 2: 8, 3: 9}
    only_new = featurestore.materialize(None, late, after=F.lit(at(4)))
    assert [r["customer_id"] for r in only_new.collect()] == [2]


def test_lookup_errors_only_when_all_features_are_null(spark):
    online = spark.createDataFrame([(1, 1.0, None), (2, None, None)], "customer_id long, a double, b double")
    requests = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "index int, customer_id long")
    got = {r["index"]: r["status"] for r in featurestore.lookup(requests, online, ["a", "b"]).collect()}
    assert got == {0: "ok", 1: "error", 2: "error"}


def test_as_of_equals_pandas_with_one_busy_key(spark):
    import random

    rng = random.Random(4)
    facts = [(1 if rng.random() < 0.6 else rng.randint(2, 9), at(rng.randint(0, 6000)), i) for i in range(800)]
    facts = list({(k, t): (k, t, v) for k, t, v in facts}.values())
    labels = [(i, 1 if rng.random() < 0.6 else rng.randint(2, 9), at(rng.randint(0, 6000))) for i in range(400)]
    got = featurestore.as_of(
        spark.createDataFrame(labels, "id int, k int, t timestamp"),
        spark.createDataFrame(facts, "k int, ft timestamp, v int"),
        "k", "t", "ft", ["v"], ttl="600 MINUTES",
    )
    left = pd.DataFrame(labels, columns=["id", "k", "t"]).sort_values("t")
    right = pd.DataFrame(facts, columns=["k", "ft", "v"]).sort_values("ft")
    expected = pd.merge_asof(left, right, left_on="t", right_on="ft", by="k")
    stale = expected["ft"] <= expected["t"] - pd.Timedelta(minutes=600)
    values = expected["v"].where(~stale)
    assert {r["id"]: r["v"] for r in got.collect()} == {
        i: None if pd.isna(v) else int(v) for i, v in zip(expected["id"], values)
    }


def test_bucket_quantile(spark):
    data = spark.createDataFrame([(v,) for v in (0.05, 0.15, 0.15, 0.4)], "x double")
    bounds = [0.1, 0.2, 0.5]
    wide = data.agg(*opsmetrics.bucket_counts(F.col("x"), bounds))
    counts = [F.col(f"le_{i}") for i in range(4)]
    got = wide.select(
        opsmetrics.bucket_quantile(counts, bounds, 0.5).alias("m"), opsmetrics.bucket_quantile(counts, bounds, 0.95).alias("p")
    ).first()
    assert got["m"] == pytest.approx(0.15)
    assert got["p"] == pytest.approx(0.2 + 0.3 * (3.8 - 3) / 1)


def test_quantile_past_the_last_bound_and_empty(spark):
    data = spark.createDataFrame([(9.0,)], "x double")
    counts = [F.col(f"le_{i}") for i in range(3)]
    for frame, expected in ((data, 2.0), (data.limit(0), None)):
        wide = frame.agg(*opsmetrics.bucket_counts(F.col("x"), [1.0, 2.0]))
        assert wide.select(opsmetrics.bucket_quantile(counts, [1.0, 2.0], 0.95)).first()[0] == expected


def test_export_layout(spark):
    row = [(7, at(0), at(0), *[float(i) for i in range(15)])]
    names = ["key", "event_timestamp", "created_timestamp", *schemas.FEATURES]
    data = spark.createDataFrame(row, names)
    assert featurestore.feature_export(data, "key").columns == schemas.FEATURE_EXPORT.names


def test_as_of_is_the_same_for_any_partitioning_of_ties(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    facts = spark.createDataFrame([("a", at, k) for k in range(50)], "k string, t timestamp, v long")
    labels = spark.createDataFrame([("a", at, k) for k in range(7)], "k string, at timestamp, i long")
    found = {
        tuple(sorted((r["i"], r["v"]) for r in featurestore.as_of(
            labels.repartition(n), facts.repartition(n), "k", "at", "t", ["v"]).collect()))
        for n in (1, 3, 7)
    }
    assert len(found) == 1 and len({v for _, v in next(iter(found))}) == 1
