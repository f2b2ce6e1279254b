"""A log-structured online table whose snapshots are published by manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidegauge.operators import featurestore
from tidegauge.sources.manifests import Published
from tidegauge.streaming.logs import BatchHandler


class OnlineTable(Published):
    """Newest rows by key, in folders that a numbered manifest lists.

    A micro-batch writes a folder with its newest rows and publishes the next manifest; if another was published
    meanwhile, that one is read and the change is made to it. A reader sees all or none of a batch. Compaction
    replaces the folders it has read by one and keeps those added since. A batch id that a manifest knows is not
    added again. Folders of old manifests stay until :meth:`clean`.
    """

    EMPTY = {"version": 0, "folders": [], "batches": {}}

    def __init__(self, spark: SparkSession, path: str, keys: list[str], versions: list[str]) -> None:
        super().__init__(spark, path)
        self.keys, self.versions = keys, versions

    def add(self, batch: DataFrame, source: str, batch_id: int) -> bool:
        """Take in a batch of a source once; its later repetition changes nothing."""
        if self.manifest()["batches"].get(source, -1) >= batch_id:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        featurestore.latest_features(batch, self.keys, self.versions).write.parquet(f"{self.path}/{folder}")

        def edit(now: dict) -> dict | None:
            if now["batches"].get(source, -1) >= batch_id:
                return None
            return {"folders": [*now["folders"], folder], "batches": {**now["batches"], source: batch_id}}

        return self._change(edit)

    def handler(self, source: str) -> BatchHandler:
        """For ``foreachBatch``; ``source`` names the stream, whose batches are numbered upwards."""
        return lambda batch, batch_id: self.add(batch, source, batch_id) and None

    def read(self, manifest: dict | None = None) -> DataFrame | None:
        """Newest row per key of one snapshot; none of an empty table."""
        folders = (manifest or self.manifest())["folders"]
        if not folders:
            return None
        rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders])
        return featurestore.latest_features(rows, self.keys, self.versions)

    def compact(self) -> bool:
        """Replace the folders of the present snapshot by one."""
        seen = self.manifest()
        if len(seen["folders"]) < 2:
            return False
        folder = f"data/{uuid.uuid4().hex}"
        self.read(seen).write.parquet(f"{self.path}/{folder}")
        old = set(seen["folders"])

        def edit(now: dict) -> dict | None:
            if not old <= set(now["folders"]):
                return None  # another compaction was faster
            return {"folders": [folder, *[f for f in now["folders"] if f not in old]], "batches": now["batches"]}

        return self._change(edit)
