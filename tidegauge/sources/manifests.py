"""Tables whose snapshots are published by numbered manifests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

# How often a publication is tried again when others publish meanwhile.
TRIES = 20


class Published:
    """A folder whose state is what its newest manifest lists.

    Publication is a rename that fails if that number is taken; the store must rename a file
    atomically and not over another. A reader sees the folders of one manifest, whole.
    """

    EMPTY: dict = {"version": 0, "folders": []}

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._place("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._place(f"manifests/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _names(self) -> list[str]:
        """Files of all manifests, oldest first."""
        folder = self._place("manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest manifest; of an empty table version 0."""
        names = self._names()
        return self._load(names[-1]) if names else dict(self.EMPTY)

    def _publish(self, manifest: dict) -> bool:
        """Make a manifest the one of its number, unless there is one already."""
        self._fs.mkdirs(self._place("manifests"))
        draft = self._place(f"manifests/{uuid.uuid4().hex}.draft")
        place = self._place(f"manifests/{manifest['version']:012d}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self._fs.exists(place) or not self._fs.rename(draft, place):
            self._fs.delete(draft, False)
            return False
        return True

    def _change(self, edit: Callable[[dict], dict | None]) -> bool:
        """Publish what ``edit`` makes of the newest manifest; False if it makes nothing of it."""
        for _ in range(TRIES):
            now = self.manifest()
            new = edit(now)
            if new is None:
                return False
            if self._publish({**new, "version": now["version"] + 1}):
                return True
        raise RuntimeError("the table is being changed too often")

    def clean(self, keep: int = 2) -> int:
        """Delete the folders that only manifests older than the newest ``keep`` list; returns how many."""
        names = self._names()
        old, new = names[:-keep], names[-keep:]
        gone = {f for n in old for f in self._load(n)["folders"]} - {f for n in new for f in self._load(n)["folders"]}
        for folder in gone:
            self._fs.delete(self._place(folder), True)
        for name in old:
            self._fs.delete(self._place(f"manifests/{name}"), False)
        return len(gone)
