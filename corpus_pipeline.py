"""Corpus pipeline: documents through five stages, each written as Parquet and read back for the next.

1. quality rules: documents that the rules reject go;
2. n-gram Jaccard join: of each class of near-duplicates the document with the least id stays;
3. substring dedup: stretches that came before in the corpus are cut out of the texts;
4. secret scan: secrets are masked in the texts;
5. best-fit packing: the tokenised documents are laid out in sequences.

Stages one to four return the columns of the table they are given; the last one returns pieces
with their sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegauge.llm import gear_chunks, jaccard_join, packing, quality_rules, secret_grammar
from tidegauge.llm.catalog import vocabulary
from tidegauge.llm.common import prepare, read_documents
from tidegauge.session import through_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_rejected(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the quality rules."""
    prepare(spark)
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of texts linked by a shingle similarity of 0.8 or more."""
    prepare(spark)
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated stretches but their first place out of the texts."""
    prepare(spark)
    return gear_chunks.strip_repeats(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts."""
    prepare(spark)
    return secret_grammar.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay the documents' tokens out in sequences."""
    prepare(spark)
    return packing.pack(packing.cut_documents(docs, vocabulary("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", drop_rejected),
    ("jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

# Chunk digests, automata and token ids are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = read_documents(spark, sf_dir)
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = through_table(docs, f"pipeline-{name}")
    return docs
