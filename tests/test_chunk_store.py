import pytest

from tidegauge.operators import retrieval
from tidegauge.plans.chunk_store import ChunkStore

LAYOUT = "source string, text string"


def store_at(spark, path, **options):
    return ChunkStore(spark, str(path), retrieval.hashed_terms(16), "hashed16", **options)


def test_only_new_texts_are_cut(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    first = store.commit(spark.createDataFrame([("a", "drift psi"), ("b", "predict rota"), ("c", "drift psi"), ("n", None)], LAYOUT))
    # three different texts, one of them empty: two chunks
    assert (first["added"], first["contents_cut"], first["chunks_embedded"]) == (4, 3, 2)
    assert {(r["source"], r["text"]) for r in store.chunks().collect()} == {("a", "drift psi"), ("b", "predict rota"), ("c", "drift psi")}
    # one renamed, one edited, one gone
    second = store.commit(spark.createDataFrame([("a2", "drift psi"), ("b", "predict nova")], LAYOUT))
    assert [second[k] for k in ("unchanged", "changed", "added", "removed", "contents_cut")] == [0, 1, 1, 3, 1]
    # back to the first text
    third = store.commit(spark.createDataFrame([("b", "predict rota")], LAYOUT))
    assert (third["changed"], third["contents_cut"], third["chunks_embedded"]) == (1, 0, 0)
    assert [r["text"] for r in store.chunks().collect()] == ["predict rota"]
    found = store.search(spark.createDataFrame([(1, "rota")], "query_id int, text string"), top_k=1).first()
    assert found["source"] == "b"


def test_snapshots_stay_readable_and_compaction_forgets(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    store.commit(spark.createDataFrame([("a", "one"), ("b", "two")], LAYOUT))
    before = store.manifest()
    store.commit(spark.createDataFrame([("a", "one"), ("c", "three")], LAYOUT))
    assert {r["text"] for r in store.chunks(before).collect()} == {"one", "two"}
    assert store.compact() and not store.compact()
    assert {r["text"] for r in store.chunks().collect()} == {"one", "three"}
    again = store.commit(spark.createDataFrame([("b", "two"), ("c", "three")], LAYOUT))
    assert again["contents_cut"] == 1
    assert store.clean(1) > 0 and {r["text"] for r in store.chunks().collect()} == {"two", "three"}


def test_other_recipe_takes_nothing_over(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x" * 50)], LAYOUT)
    store = store_at(spark, tmp_path / "s")
    store.commit(docs)
    other = store_at(spark, tmp_path / "s", size=20, overlap=5)
    assert other.chunks().count() == 0
    made = other.commit(docs)
    assert made["contents_cut"] == 1 and made["unchanged"] == 1 and made["chunks_embedded"] > 1
    assert other.chunks().count() == made["chunks_embedded"]


def test_repeated_paths_and_lost_races_are_refused(spark, tmp_path, monkeypatch):
    store = store_at(spark, tmp_path / "s")
    with pytest.raises(ValueError):
        store.commit(spark.createDataFrame([("a", "x"), ("a", "y")], LAYOUT))
    assert store.manifest()["version"] == 0 and store.chunks().count() == 0
    stale = store.manifest()
    store.commit(spark.createDataFrame([("a", "x")], LAYOUT))
    true = store.manifest
    calls = iter([stale])
    monkeypatch.setattr(store, "manifest", lambda: next(calls, None) or true())
    with pytest.raises(RuntimeError):
        store.commit(spark.createDataFrame([("a", "z")], LAYOUT))
    monkeypatch.undo()
    assert [r["text"] for r in store.chunks().collect()] == ["x"]


def test_empty_input(spark, tmp_path):
    store = store_at(spark, tmp_path / "s")
    made = store.commit(spark.createDataFrame([], LAYOUT))
    assert (made["added"], made["contents_cut"]) == (0, 0) and store.chunks().count() == 0
