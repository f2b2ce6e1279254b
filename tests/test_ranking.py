import random

import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import ranking


def test_global_rank_with_one_value_shared_by_many(spark):
    rng = random.Random(5)
    rows = [(i, 1.0 if i % 3 else rng.random()) for i in range(3000)]
    data = spark.createDataFrame(rows, "id long, score double").repartition(5)
    got = {r["id"]: r["rank"] for r in ranking.global_rank(data, [F.col("score").desc(), F.col("id")]).collect()}
    expected = {i: n for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), start=1)}
    assert got == expected


def test_running_totals_over_an_empty_frame(spark):
    data = spark.createDataFrame([], "id long")
    assert ranking.global_rank(data, [F.col("id")]).count() == 0


def test_latest_row_breaks_ties_by_the_second_version(spark):
    data = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (2, 1, 9, "c"), (1, 4, 9, "d")], "k int, t int, c int, v string")
    got = {r["k"]: r["v"] for r in ranking.latest_per_key(data, ["k"], ["t", "c"]).collect()}
    assert got == {1: "b", 2: "c"}


def test_running_sum_inside_busy_keys(spark):
    rng = random.Random(1)
    rows = [("a" if i % 4 else "b", i, rng.choice([1, -1])) for i in range(500)]
    data = spark.createDataFrame(rows, "k string, t int, d int").repartition(3)
    totals, expected = {"a": 0, "b": 0}, {}
    for k, t, d in rows:
        totals[k] += d
        expected[t] = totals[k]
    got = ranking.running_sum_per_key(data, ["k"], [F.col("t")], F.col("d"), "s")
    assert {r["t"]: r["s"] for r in got.collect()} == expected


def test_quantile_within_equals_numpy(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.7 else rng.choice("bcd"), round(rng.random(), 2)) for _ in range(800)]
    data = spark.createDataFrame([*rows, ("e", 0.5), ("f", None)], "k string, x double")
    got = {r["k"]: (r["n"], r["q"]) for r in ranking.quantile_within(data, ["k"], "x", 0.95, "q").collect()}
    for k in "abcd":
        values = [x for key, x in rows if key == k]
        assert got[k][0] == len(values) and abs(got[k][1] - np.quantile(values, 0.95)) < 1e-12
    assert got["e"] == (1, 0.5) and "f" not in got


def test_segmented_scan_over_busy_keys_and_many_ranges(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        key = rng.choice(["a"] * 12 + ["b", "c", None, "d"])
        rows.append((key, i, rng.randint(-3, 3), (i, f"v{i}") if rng.random() < 0.1 else None))
    layout = "k string, t int, d int, v struct<at:int,text:string>"
    data = spark.createDataFrame(rows, layout).repartition(4)
    sums, last, expected = {}, {}, {}
    for k, t, d, v in rows:
        sums[k] = sums.get(k, 0) + d
        last[k] = v or last.get(k)
        expected[t] = (sums[k], last[k])
    for parts in (1, 7, 40):
        found = ranking.segmented_scan(data, ["k"], [F.col("t")], {"s": F.col("d")}, {"v": F.col("v")}, parts)
        got = {r["t"]: (r["s"], tuple(r["v"]) if r["v"] else None) for r in found.collect()}
        assert got == expected
    assert ranking.segmented_scan(data.limit(0), ["k"], [F.col("t")], {"s": F.col("d")}).count() == 0
    whole = ranking.segmented_scan(data, [], [F.col("t")], {"s": F.col("d")}, partitions=5).collect()
    total, upto = 0, {}
    for _, t, d, _ in rows:
        total += d
        upto[t] = total
    assert {r["t"]: r["s"] for r in whole} == upto


def test_scans_leave_no_join_in_the_plan(spark):
    from tidegauge.operators import featurestore, metrics, opsmetrics

    rows = spark.createDataFrame([("m", i, i % 2, i / 10) for i in range(50)], "model string, id long, label int, score double")
    times = rows.select("model", "id", F.timestamp_seconds(F.col("id")).alias("t"), "score")
    frames = [
        metrics.top_fraction_metrics(rows, ["model"]),
        opsmetrics.in_flight(times, "model", "t", "id", F.lit(1)),
        featurestore.as_of(times.select("model", "t", "id"), times, "model", "t", "t", ["score"]),
    ]
    for frame in frames:
        assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["score"] for r in frames[2].collect()} == {i: i / 10 for i in range(50)}
