import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.operators import retrieval
from tidegauge.plans import index
from tidegauge.sources import corpus


def plain_chunks(text, size, overlap):
    """The packing rules written out over one text."""
    chunks, current = [], ""
    for paragraph in [p.strip() for p in text.split("\n\n") if p.strip()]:
        joined = f"{current}\n\n{paragraph}" if current else paragraph
        if len(joined) <= size:
            current = joined
            continue
        if current:
            chunks.append(current)
        current = paragraph if len(paragraph) <= size else ""
        if not current:
            cuts = [paragraph[s : s + size].strip() for s in range(0, len(paragraph), size - overlap)]
            chunks += [c for c in cuts if c]
    return chunks + ([current] if current else [])


def test_chunks_follow_the_packing_rules(spark):
    rng = np.random.default_rng(0)
    words = lambda n: " ".join("w" * int(k) for k in rng.integers(1, 9, n))
    texts = ["\n\n".join(words(int(n)) for n in rng.integers(1, 60, int(m))) for m in rng.integers(1, 9, 40)] + ["", "a"]
    data = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string")
    got = {}
    for r in retrieval.chunk_documents(data, size=120, overlap=20).orderBy("source", "chunk_id").collect():
        got.setdefault(r["source"], []).append(r["text"])
    assert got == {str(i): plain_chunks(t, 120, 20) for i, t in enumerate(texts) if t}


@pytest.mark.parametrize("bound", [retrieval.BROADCAST_QUERY_BYTES, 0])
def test_nearest_equals_brute_force_on_both_paths(spark, bound):
    rng = np.random.default_rng(1)
    vectors = np.round(rng.normal(size=(300, 8)), 1)
    vectors[100:200] = vectors[0]  # a third of all rows are copies
    queries = np.round(rng.normal(size=(7, 8)), 1)
    corpus_rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "key long, vector array<double>")
    query_rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)], "query long, vector array<double>")
    got = retrieval.nearest(corpus_rows.repartition(5), query_rows, 5, broadcast_bytes=bound, block_rows=40)
    scores = np.round(queries @ vectors.T, 9)
    for q in range(7):
        expected = sorted(range(300), key=lambda i: (-scores[q, i], i))[:5]
        rows = sorted((r["rank"], r["key"]) for r in got.where(F.col("query") == q).collect())
        assert [k for _, k in rows] == expected


def test_retrieval_finds_the_drift_note(spark):
    docs = spark.createDataFrame(
        [("README.md", "Rotas: POST /predict e GET /health."), ("drift.md", "O drift usa PSI com limite critico."), ("b.md", " ")],
        "source string, text string",
    )
    chunks = retrieval.chunk_documents(docs, size=120, overlap=20)
    encoder = retrieval.keyword_counts(["drift", "psi", "predict"])
    questions = spark.createDataFrame([(1, "como o drift e o PSI?"), (2, "  ")], "query_id int, text string")
    got = retrieval.retrieve(chunks, questions, encoder, top_k=2, lexical_weight=0.2, multiplier=3).orderBy("rank").collect()
    assert {r["query_id"] for r in got} == {1}
    assert got[0]["source"] == "drift.md"
    assert got[0]["context"].startswith("[Fonte: drift.md | tipo: markdown | chunk: 0]\nO drift")


def test_index_is_rebuilt_only_for_changes(spark, tmp_path):
    docs = spark.createDataFrame([("a", "drift psi"), ("b", "predict rota"), ("c", "outro texto")], "source string, text string")
    def build(rows, previous, target):
        return index.build_index(
            rows, previous, str(tmp_path / target), retrieval.hashed_terms(16), "hashed16", 16
        ).first()

    first = build(docs, None, "one")
    assert (first["files"], first["chunks"], first["added"], first["cache_hit"]) == (3, 3, 3, False)
    later = docs.where("source <> 'c'").withColumn("text", F.when(F.col("source") == "a", "drift novo").otherwise(F.col("text")))
    second = build(later, str(tmp_path / "one"), "two")
    assert (second["unchanged"], second["changed"], second["removed"], second["chunks"]) == (1, 1, 1, 2)
    assert build(later, str(tmp_path / "two"), "three")["cache_hit"]
    found = index.search_index(
        spark, str(tmp_path / "three"), spark.createDataFrame([(1, "drift novo")], "query_id int, text string"),
        retrieval.hashed_terms(16), "hashed16", top_k=1,
    ).first()
    assert found["source"] == "a"
    vectors = spark.read.parquet(str(tmp_path / "three" / "vectors"))
    assert vectors.count() == 2
    assert index.load_part(spark, str(tmp_path / "three"), "chunks", "other").count() == 0


def test_discovery_and_manifest(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "note.md").write_text("drift  note\r\n", encoding="utf-8")
    (tmp_path / "docs" / "empty.md").write_text("")
    (tmp_path / "set.json").write_text('{"b": 1, "a": "x"}', encoding="utf-8")
    files = corpus.discover(spark, str(tmp_path), ["docs/**/*.md", "absent/*.md"], ["set.json", "no.json"])
    texts = {r["source"].rsplit("/", 1)[1]: (r["source_type"], r["text"]) for r in corpus.read_text(files).collect()}
    assert texts == {"note.md": ("markdown", "drift note"), "set.json": ("json", '{\n  "a": "x",\n  "b": 1\n}')}
    rows = corpus.manifest(files).collect()
    assert {r["size_bytes"] for r in rows} == {13, 18} and all(len(r["sha256"]) == 64 for r in rows)


def test_patterns_take_folders_and_broken_bytes_are_dropped(spark, tmp_path):
    for folder in ("docs", "docs/deep/er", "other"):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
    (tmp_path / "top.md").write_text("top")
    (tmp_path / "docs" / "one.md").write_bytes(b"caf\xc3\xa9 \xff\xfe broken \xef\xbf\xbd kept")
    (tmp_path / "docs" / "deep" / "er" / "two.md").write_text("two")
    (tmp_path / "other" / "three.md").write_text("three")

    def names(*patterns):
        return sorted(r["path"].rsplit("/", 1)[1] for r in corpus.discover(spark, str(tmp_path), patterns).collect())

    assert names("*.md") == ["top.md"]
    assert names("docs/**/*.md") == ["one.md", "two.md"] and names("docs/*.md") == ["one.md"]
    assert names("**/*.md") == ["one.md", "three.md", "top.md", "two.md"] and names("none/*.md") == []
    texts = {r["source"].rsplit("/", 1)[1]: r["text"] for r in
             corpus.read_text(corpus.discover(spark, str(tmp_path), ["docs/*.md"])).collect()}
    assert texts == {"one.md": "caf\u00e9 broken \ufffd kept"}


def test_packing_time_is_linear_in_the_paragraphs(spark):
    import time

    took = {}
    for n in (2_000, 2_000, 16_000):
        text = "\n\n".join(f"paragraph {k} of a long document with some words in it" for k in range(n))
        data = spark.createDataFrame([("d", text)], "source string, text string")
        began = time.time()
        got = [r.text for r in retrieval.chunk_documents(data, size=120, overlap=20).orderBy("chunk_id").collect()]
        took[n] = time.time() - began
        assert got == plain_chunks(text, 120, 20)
    assert took[16_000] < 30
