"""Retrieval index as tables, rebuilt only for what changed."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.operators import retrieval
from tidegauge.sources import corpus, sinks

INDEX_VERSION = 1


def _stamped(df: DataFrame, encoder_name: str) -> DataFrame:
    return df.withColumns({"schema_version": F.lit(INDEX_VERSION), "encoder": F.lit(encoder_name)})


def load_part(spark: SparkSession, path: str, part: str, encoder_name: str) -> DataFrame | None:
    """A stored part of the index; rows of another version or encoder do not count."""
    try:
        stored = spark.read.parquet(f"{path}/{part}")
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    mine = (F.col("schema_version") == INDEX_VERSION) & (F.col("encoder") == encoder_name)
    return stored.where(mine)


def build_index(
    documents: DataFrame, previous: str | None, target: str, encoder: retrieval.Encoder, encoder_name: str,
    dimension: int, path: str = "source", text: str = "text",
    size: int = retrieval.CHUNK_SIZE, overlap: int = retrieval.CHUNK_OVERLAP,
) -> DataFrame:
    """Write chunks, vectors and manifest to ``target`` and return the statistics row.

    Chunks of unchanged documents are taken over from ``previous``; only new and
    edited ones are cut and embedded. The state of every path is counted in the row.
    """
    spark = documents.sparkSession
    fresh = corpus.table_manifest(documents, path, text)
    old = load_part(spark, previous, "manifest", encoder_name) if previous else None
    if old is None:
        old = fresh.limit(0)
    old = old.select("path", "size_bytes", "sha256")
    stale = corpus.stale_documents(documents, path, fresh, old)
    chunks = retrieval.chunk_documents(stale, path, text, size=size, overlap=overlap)
    kept_chunks = load_part(spark, previous, "chunks", encoder_name) if previous else None
    kept_vectors = load_part(spark, previous, "vectors", encoder_name) if previous else None

    same = fresh.join(old.select("path", "sha256"), ["path", "sha256"], "left_semi").select(
        F.col("path").alias("source")
    )
    named = chunks.withColumn("key", retrieval.chunk_key())
    if kept_chunks is not None:
        kept = kept_chunks.drop("schema_version", "encoder").join(same, "source", "left_semi")
        all_chunks = named.unionByName(kept)
    else:
        all_chunks = named
    sinks.write_table(_stamped(all_chunks, encoder_name), f"{target}/chunks")
    stored = spark.read.parquet(f"{target}/chunks").drop("schema_version", "encoder")
    if kept_vectors is not None:
        wanted = kept_vectors.drop("schema_version", "encoder").join(
            stored.join(same, "source", "left_semi").select("key"), "key", "left_semi"
        )
        missing = stored.join(same, "source", "left_anti")
        vectors = missing.select(
            "key", retrieval.embed(F.col("text"), encoder).alias("vector")
        ).unionByName(wanted)
    else:
        vectors = stored.select("key", retrieval.embed(F.col("text"), encoder).alias("vector"))
    sinks.write_table(_stamped(vectors, encoder_name), f"{target}/vectors")
    sinks.write_table(_stamped(fresh, encoder_name), f"{target}/manifest")

    diff = corpus.manifest_diff(old, fresh)
    states = diff.agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "changed", "added", "removed")],
        F.lit(1).alias("_one"),
    )
    stats = retrieval.index_statistics(stored, documents, path, text, dimension).withColumn("_one", F.lit(1))
    row = stats.join(states, "_one").drop("_one").withColumn(
        "cache_hit", (F.col("changed") + F.col("added") + F.col("removed")) == 0
    )
    sinks.append_history(row, f"{target}/history")
    return spark.read.schema(row.schema).json(f"{target}/history")


def search_index(
    spark: SparkSession, path: str, queries: DataFrame, encoder: retrieval.Encoder, encoder_name: str, **options
) -> DataFrame:
    """Ranked contexts from a stored index."""
    chunks = load_part(spark, path, "chunks", encoder_name)
    vectors = load_part(spark, path, "vectors", encoder_name)
    if chunks is None or vectors is None:
        raise FileNotFoundError(f"no index at {path}")
    return retrieval.retrieve(
        chunks.select("source", "source_type", "chunk_id", "text", "char_count"),
        queries, encoder, vectors=vectors.select("key", "vector"), **options,
    )
