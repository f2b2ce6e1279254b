"""A store of chunks addressed by the content they were cut from, with snapshots of the sources.

A document is known by the SHA-256 of its text. What a commit cuts and embeds are the texts that no
earlier commit has seen, once each, whatever the number of sources that hold them; a source
that is renamed, copied or set back to an earlier text costs nothing. A snapshot is a table of sources and the
folders of chunks; it is published by a manifest, whole or not at all.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.operators import retrieval
from tidegauge.sources import corpus
from tidegauge.sources.manifests import Published

SOURCES = "path string, source_type string, size_bytes long, sha256 string, n_rows long"


class ChunkStore(Published):
    """Chunks and vectors of a changing set of sources, made with one recipe.

    The recipe is the encoder's name and the way texts are cut; with another one nothing is taken over.
    A null text is an empty one and has no chunks. Each source is one row: a commit in which a path has several rows is refused.
    """

    EMPTY = {"version": 0, "folders": [], "parts": [], "sources": None, "recipe": None}

    def __init__(
        self, spark: SparkSession, path: str, encoder: retrieval.Encoder, encoder_name: str,
        size: int = retrieval.CHUNK_SIZE, overlap: int = retrieval.CHUNK_OVERLAP,
    ) -> None:
        super().__init__(spark, path)
        self.encoder, self.size, self.overlap = encoder, size, overlap
        self.recipe = f"{encoder_name}/{size}/{overlap}"

    def _read(self, folders: list[str], layout: str) -> DataFrame:
        reader = self.spark.read.schema(layout)
        if not folders:
            return self.spark.createDataFrame([], layout)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders])

    def _usable(self, manifest: dict) -> list[str]:
        return manifest["parts"] if manifest["recipe"] == self.recipe else []

    def sources(self, manifest: dict | None = None) -> DataFrame:
        """Path, type, size and digest of every source of a snapshot."""
        chosen = manifest or self.manifest()
        return self._read([chosen["sources"]] if chosen["sources"] else [], SOURCES).drop("n_rows")

    def entries(self, manifest: dict | None = None) -> DataFrame:
        """Chunks by content: ``(sha256, chunk_id, text, char_count, vector, part)``."""
        parts = self._usable(manifest or self.manifest())
        layout = "sha256 string, chunk_id int, text string, char_count int, vector array<double>, part string"
        return self._read([f"{p}/chunks" for p in parts], layout)

    def commit(self, documents: DataFrame, path: str = "source", text: str = "text", kind: str | None = None) -> dict:
        """Make these documents the sources of the next snapshot; returns what it took.

        Only digests are compared; of the texts those with a new digest are cut, each at the smallest path that holds it.
        """
        seen = self.manifest()
        body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
        named = documents.select(
            F.col(f"`{path}`").cast("string").alias("path"),
            (F.col(f"`{kind}`").cast("string") if kind else F.lit("markdown")).alias("source_type"),
            body.alias("text"),
        ).withColumn("sha256", F.sha2(F.encode("text", "UTF-8"), 256))
        part, listed = f"data/{uuid.uuid4().hex}", f"sources/{uuid.uuid4().hex}"
        named.groupBy("path").agg(
            F.min("source_type").alias("source_type"), F.min(F.octet_length("text").cast("long")).alias("size_bytes"),
            F.min("sha256").alias("sha256"), F.count(F.lit(1)).alias("n_rows"),
        ).write.parquet(f"{self.path}/{listed}")
        listing = self._read([listed], SOURCES)
        if not listing.where(F.col("n_rows") > 1).isEmpty():
            raise ValueError("a path has several rows")

        known = self._read([f"{p}/contents" for p in self._usable(seen)], "sha256 string")
        first = listing.groupBy("sha256").agg(F.min(F.coalesce("path", F.lit(""))).alias("at"))
        first.join(known, "sha256", "left_anti").write.parquet(f"{self.path}/{part}/new")
        new = self._read([f"{part}/new"], "sha256 string, at string")
        # digest and path together spread the copies of one text
        fresh = named.withColumn("at", F.coalesce("path", F.lit(""))).join(new, ["sha256", "at"], "left_semi")
        chunks = retrieval.chunk_documents(fresh, "sha256", "text", size=self.size, overlap=self.overlap)
        chunks.select(
            F.col("source").alias("sha256"), "chunk_id", "text", "char_count",
            retrieval.embed(F.col("text"), self.encoder).alias("vector"), F.lit(part).alias("part"),
        ).write.parquet(f"{self.path}/{part}/chunks")
        new.select("sha256").write.parquet(f"{self.path}/{part}/contents")

        def edit(now: dict) -> dict | None:
            if now["version"] != seen["version"]:
                return None
            parts = [*self._usable(now), part]
            return {"folders": [*parts, listed], "parts": parts, "sources": listed, "recipe": self.recipe}

        if not self._change(edit):
            raise RuntimeError("another commit was faster; commit again")
        diff = corpus.manifest_diff(self.sources(seen), listing)
        states = diff.agg(
            *[F.count_if(F.col("state") == s).alias(s) for s in ("unchanged", "changed", "added", "removed")]
        ).first()
        made = self.spark.read.schema("char_count int").parquet(f"{self.path}/{part}/chunks")
        return {
            "version": seen["version"] + 1, "part": part, **states.asDict(),
            "contents_cut": new.count(), "chunks_embedded": made.count(),
        }

    def chunks(self, manifest: dict | None = None, values: dict[str, Column] | None = None) -> DataFrame:
        """The chunks of every source: ``(source, source_type, chunk_id, text, char_count, key, vector, part)``.

        With ``values`` these, made from a chunk's own columns, take the place of text, count, vector and part: they are
        formed before chunks meet their sources, so that neither texts nor vectors are moved for them.
        """
        chosen = manifest or self.manifest()
        entries = self.entries(chosen)
        if values is not None:
            entries = entries.select("sha256", "chunk_id", *[c.alias(n) for n, c in values.items()])
        rows = self.sources(chosen).join(entries, "sha256").withColumnRenamed("path", "source")
        found = rows.withColumn("key", retrieval.chunk_key())
        if values is not None:
            return found.select("source", "source_type", "chunk_id", "key", *values)
        return found.select("source", "source_type", "chunk_id", "text", "char_count", "key", "vector", "part")

    def search(self, queries: DataFrame, **options) -> DataFrame:
        """Ranked contexts from the newest snapshot."""
        found = self.chunks()
        return retrieval.retrieve(
            found.drop("key", "vector", "part"), queries, self.encoder, vectors=found.select("key", "vector"), **options
        )

    def compact(self) -> bool:
        """Gather what the present sources use into one folder; other texts are forgotten."""
        seen = self.manifest()
        if len(self._usable(seen)) < 2:
            return False
        part = f"data/{uuid.uuid4().hex}"
        used = self.sources(seen).select("sha256").distinct()
        used.write.parquet(f"{self.path}/{part}/contents")
        kept = self.entries(seen).join(used, "sha256", "left_semi").withColumn("part", F.lit(part))
        kept.write.parquet(f"{self.path}/{part}/chunks")

        def edit(now: dict) -> dict | None:
            if now["version"] != seen["version"]:
                return None  # a commit was faster
            return {**now, "folders": [part, now["sources"]], "parts": [part]}

        return self._change(edit)
