import datetime
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import drift


def plain_psi(reference, current):
    """The rules written out over pandas."""
    reference, current = pd.Series(reference).dropna(), pd.Series(current).dropna()
    if reference.empty or current.empty:
        return 0.0
    edges = np.unique(np.quantile(reference, np.linspace(0, 1, 11)))
    if len(edges) < 2:
        low, high = min(reference.min(), current.min()), max(reference.max(), current.max())
        if low == high:
            return 0.0
        edges = np.linspace(low, high, 11)

    def share(values):
        counts = pd.cut(values, edges, include_lowest=True).value_counts(sort=False)
        return np.maximum(counts / max(counts.sum(), 1), 1e-6).to_numpy()

    r, c = share(reference), share(current)
    return float(np.sum((c - r) * np.log(c / r)))


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


CASES = {
    "shifted": (range(30, 40), range(70, 80)),
    "same": (range(100), range(100)),
    "constant": ([5.0] * 10, [5.0] * 10),
    "constant_reference": ([5.0] * 10, [5.0, 6.0, 7.0, 9.0] * 3),
    "binary": ([0, 1] * 20, [1] * 30 + [0] * 2),
    "empty": ([1.0, 2.0], [None, None]),
    "partly_outside": (range(100), range(50, 150)),
    "nan": ([1.0, 2.0, 3.0, float("nan")] * 10, [2.0, 3.0, 3.0, float("nan")] * 10),
    "normal": (np.random.default_rng(1).normal(size=500), np.random.default_rng(2).normal(0.4, 1.3, 400)),
}


@pytest.mark.parametrize("case", CASES)
def test_numeric_psi_follows_the_rules(spark, case):
    reference, current = CASES[case]
    got = drift.numeric_psi(frame(spark, reference), frame(spark, current), ["x"]).collect()
    expected = plain_psi(
        pd.Series(list(reference), dtype=float), pd.Series(list(current), dtype=float)
    )
    assert got and got[0]["psi"] == pytest.approx(expected, abs=1e-9)


def test_edges_are_exact_quantiles_of_all_columns(spark):
    draws = np.random.default_rng(3)
    columns = {"x": draws.lognormal(size=997).round(3), "y": draws.integers(0, 40, 997).astype(float)}
    rows = [tuple(float(v) for v in r) for r in zip(*columns.values())]
    data = spark.createDataFrame([*rows, (None, float("nan"))], "x double, y double")
    edges = drift.fit_edges(data, None, ["x", "y"])
    for name, values in columns.items():
        assert edges[name] == pytest.approx(sorted(set(np.quantile(values, np.linspace(0, 1, 11)))), abs=1e-9)
        row = data.agg(drift.F.percentile(name, [k / 10 for k in range(11)])).first()[0] if name == "x" else None
        assert row is None or edges[name] == sorted(set(row))


def test_booleans_are_binned_and_times_compared_by_value(spark):
    schema = "flag boolean, day timestamp"
    days = [datetime.datetime(2024, 1, 1 + k % 3) for k in range(41)]
    reference = spark.createDataFrame([(k % 2 == 0, d) for k, d in enumerate(days)], schema)
    current = spark.createDataFrame([(k % 10 == 0, days[0]) for k in range(40)], schema)
    psi = {r["feature"]: r["psi"] for r in drift.feature_psi(reference, current).collect()}
    assert psi["flag"] == pytest.approx(0.0, abs=1e-9) and psi["day"] > 1.0


def test_open_ended_bins_count_outside_values(spark):
    reference, current = frame(spark, range(100)), frame(spark, range(50, 150))
    closed = drift.numeric_psi(reference, current, ["x"]).first()["psi"]
    opened = drift.numeric_psi(reference, current, ["x"], open_ended=True).first()["psi"]
    assert opened != pytest.approx(closed)


def test_categorical_psi_counts_missing_and_new_categories(spark):
    reference = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    current = spark.createDataFrame([("a",), ("c",)], "x string")
    got = drift.categorical_psi(reference, current, ["x"]).first()["psi"]
    r = {"a": 0.5, "b": 0.25, "__missing__": 0.25, "c": 1e-6}
    c = {"a": 0.5, "b": 1e-6, "__missing__": 1e-6, "c": 0.5}
    assert got == pytest.approx(sum((c[k] - r[k]) * np.log(c[k] / r[k]) for k in r))


def psi_rows(spark, values):
    return spark.createDataFrame(list(values.items()), "feature string, psi double")


def test_decision_is_critical_and_names_the_drifted_feature(spark):
    row = drift.decide(psi_rows(spark, {"Age": 0.25, "Balance": 0.03})).first()
    assert (row["status"], row["drifted_features"]) == ("critical", ["Age"])
    assert row["max_feature_psi"] == 0.25
    assert row["mean_feature_psi"] == pytest.approx(0.14)
    assert row["drifted_feature_share"] == 0.5


def test_prediction_index_alone_can_raise_the_status(spark):
    prediction = spark.createDataFrame([(0.15,)], "prediction_psi double")
    assert drift.decide(psi_rows(spark, {"Age": 0.01}), prediction).first()["status"] == "warning"


def test_no_feature_gives_ok(spark):
    row = drift.decide(psi_rows(spark, {"Age": 0.2}).limit(0)).first()
    assert (row["status"], row["max_feature_psi"], row["drifted_features"]) == ("ok", 0.0, [])


def test_small_samples_withhold_the_decision(spark):
    decision = drift.decide(psi_rows(spark, {"Age": 0.25, "Balance": 0.03}))
    row = drift.apply_minimum_sample(decision, F.lit(4), 30).first()
    assert (row["status"], row["decision_eligible"], row["retraining_recommended"]) == (
        "insufficient_data", False, False,
    )
    assert row["max_feature_psi"] == 0.25
    assert drift.apply_minimum_sample(decision, F.lit(30), 30).first()["retraining_recommended"]


def test_slices_are_judged_against_one_reference(spark):
    reference = frame(spark, range(100))
    current = spark.createDataFrame(
        [("same", float(i)) for i in range(100)] + [("high", float(i)) for i in range(60, 100)], "part string, x double"
    )
    got = {r["part"]: r["psi"] for r in drift.numeric_psi(reference, current, ["x"], keys=["part"]).collect()}
    assert got["same"] == pytest.approx(0.0)
    assert got["high"] == pytest.approx(plain_psi(range(100), range(60, 100)))


def test_result_does_not_depend_on_partitioning(spark):
    reference, current = frame(spark, range(200)), frame(spark, range(90, 260))
    once = drift.numeric_psi(reference, current, ["x"]).first()["psi"]
    again = drift.numeric_psi(reference.repartition(7), current.repartition(3), ["x"]).first()["psi"]
    assert once == pytest.approx(again, abs=1e-12)


def test_numbers_and_texts_are_counted_in_one_pass(spark):
    schema = "x double, a string, `odd name` string"
    reference = spark.createDataFrame([(float(i), "0" if i % 2 else "b", None) for i in range(40)], schema)
    current = spark.createDataFrame([(float(i + 20), "0" if i % 4 else "c", "new") for i in range(40)], schema)
    edges, texts = drift.fit_edges(reference, None, ["x"]), ["a", "odd name"]
    counts = [drift.count_values(side, edges, texts) for side in (reference, current)]
    got = {r["feature"]: r["psi"] for r in drift.psi_from_values(*counts).collect()}
    alone = drift.numeric_psi(reference, current, ["x"]).unionByName(drift.categorical_psi(reference, current, texts))
    assert got == pytest.approx({r["feature"]: r["psi"] for r in alone.collect()}) and len(got) == 3
    kinds = {(r["kind"], r["feature"]) for r in counts[1].collect()}
    assert kinds == {("number", "x"), ("text", "a"), ("text", "odd name")}
