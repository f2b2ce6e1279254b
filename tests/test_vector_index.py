import numpy as np
import pytest

from tidegauge.operators import retrieval, vector_index

LAYOUT = "key long, vector array<float>, list string"


def clustered(rows=600, dimension=8, seed=5):
    """Vectors around a few directions, a third of them one and the same."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dimension)) * 3
    vectors = centres[rng.integers(0, 12, rows)] + rng.normal(size=(rows, dimension)) * 0.3
    vectors[rng.permutation(rows)[: rows // 3]] = centres[0]
    return vectors.astype(np.float32)


def brute(vectors, asked, k):
    scores = np.round(vectors[asked].astype(float) @ vectors.astype(float).T, retrieval.SCORE_DECIMALS)
    return {q: list(np.lexsort((np.arange(len(vectors)), -row))[:k]) for q, row in zip(asked, scores)}


@pytest.fixture(scope="module")
def table(spark):
    vectors = clustered()
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    # rows without key or vector, and a column named as one of the index
    frame = spark.createDataFrame([*rows, (None, rows[0][1], "y"), (9999, None, "z")], LAYOUT)
    return vectors, frame


def keys_of(frame):
    found = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query"], r["rank"])):
        found.setdefault(r["query"], []).append(r["key"])
    return found


def asked_of(frame):
    return frame.where("key % 20 = 0").selectExpr("key AS query", "vector")


@pytest.mark.parametrize("block_rows", [20_000, 40])
def test_exact_search_equals_brute_force(table, block_rows):
    vectors, frame = table
    index = vector_index.build(frame, lists=12, block_rows=block_rows)
    assert index.rows.count() == len(vectors)
    asked = asked_of(frame)
    expected = brute(vectors, list(range(0, len(vectors), 20)), 5)
    for visited in (1, 3):
        assert keys_of(vector_index.search_exact(index, asked, 5, visited, block_rows=block_rows)) == expected


def test_lists_visited_follow_from_the_target(table):
    vectors, frame = table
    index = vector_index.build(frame, lists=12)
    asked = asked_of(frame)
    few = vector_index.lists_to_visit(index, asked, 5, target=0.5)
    most = vector_index.lists_to_visit(index, asked, 5, target=1.0)
    assert 1 <= few <= most <= 12
    exact = retrieval.nearest(index.rows, asked, 5)
    row = vector_index.recall(vector_index.search(index, asked, 5, most), exact).first()
    assert (row["queries"], row["wanted"], row["recall"]) == (30, 150, 1.0)
    assert vector_index.recall(vector_index.search(index, asked, 5, few), exact).first()["recall"] >= 0.5


def test_bounds_leave_lists_out(table):
    vectors, frame = table
    index = vector_index.build(frame, lists=12)
    one = asked_of(frame).limit(1).withColumn("floor", vector_index.F.lit(1e9))
    lists = vector_index._open_lists(index, one["vector"], one["floor"], 1)
    assert one.select(lists.alias("lists")).first()["lists"] == []


def test_few_and_no_vectors(spark, table):
    _, frame = table
    empty = vector_index.build(frame.limit(0))
    assert vector_index.search_exact(empty, asked_of(frame), 5, 1).count() == 0
    assert vector_index.lists_to_visit(empty, asked_of(frame), 5) == 1
    same = spark.createDataFrame([(i, [1.0, 0.0], "x") for i in range(5)], LAYOUT)
    found = keys_of(vector_index.search_exact(vector_index.build(same), asked_of(same), 3, 1))
    assert found == {0: [0, 1, 2]}
    assert vector_index.search_exact(vector_index.build(same), asked_of(same).limit(0), 3, 1).count() == 0


def test_number_of_lists_grows_up_to_the_sample():
    assert [vector_index.list_count(n) for n in (0, 1, 100, 10_000, 10**6, 10**12)] == [1, 1, 4, 100, 1000, 4096]
