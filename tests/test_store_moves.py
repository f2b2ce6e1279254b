import numpy as np
from pyspark.sql import functions as F

from tidegauge.operators import retrieval
from tidegauge.plans.chunk_store import ChunkStore


def test_values_of_chunks_are_formed_before_the_join(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path), retrieval.keyword_counts(["a", "b"]), "two")
    store.commit(spark.createDataFrame([("x", "a b a"), ("y", "b"), ("z", "b")], "source string, text string"))
    whole = store.chunks().select("source", "chunk_id", F.md5(F.col("text").cast("binary")).alias("digest")).orderBy("source")
    short = store.chunks(values={"digest": F.md5(F.col("text").cast("binary"))}).orderBy("source")
    assert [tuple(r) for r in whole.collect()] == [tuple(r) for r in short.select("source", "chunk_id", "digest").collect()]
    plan = short._jdf.queryExecution().optimizedPlan().toString()
    at_join = plan.index("Join Inner")
    assert "md5" not in plan[:at_join] and "md5" in plan[at_join:]


def test_texts_are_embedded_a_bounded_number_at_once(spark):
    def sizes(texts):
        return np.array([[float(len(texts)), 1.0] for _ in texts])

    rows = spark.range(0, 2500, 1, 1).select("id", F.col("id").cast("string").alias("t"))
    found = rows.select("id", retrieval.embed(F.col("t"), sizes, normalize=False)[0].alias("n")).agg(F.count("n"), F.max("n")).first()
    assert tuple(found) == (2500, float(retrieval.EMBED_ROWS))
