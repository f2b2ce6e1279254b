"""Lines of text files with their places: exact line numbers, and a stream that follows growing files.

Line numbers are counted per byte range of a file: a line's number is what the ranges before its own hold,
plus its place within the range. So no file is read by one task, and one row per range is summed up.

:class:`TailedLines` is a streaming source for logs that are appended to, which a file stream (it takes each
file once) does not follow. Its offset is the length of every file up to the last line break, so a line is
read once it is complete; a file cut short is an error. Its workers open the files themselves: local paths
and all stores pyarrow knows by URI. The batch form uses Spark's own scan and works on every store.

Defined results: an empty file has no lines; a last line without a break is a line for the batch form and
waits for its break in the stream; a line longer than a range belongs to the range it starts in; bytes that
are not UTF-8 are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SOURCE = "tailed_lines"
RANGE_BYTES = 64 << 20
# Bytes looked at in one step for the last line break of a file, and read in one step by a task.
STEP_BYTES = 1 << 20


# --- line numbers -----------------------------------------------------------


def first_lines(counts: DataFrame) -> DataFrame:
    """``(file, range, before)``: lines of a file before each range, from ``(file, range, n)``."""
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, range, place)`` of the lines of text files; places ascend within a range."""
    return spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("place"),
    )


def numbered(placed: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` rows of :func:`placed_lines` with ``line``, counted from 1 in each file.

    All lines are counted, one row per range is kept, and only the wanted ones meet the counts.
    """
    counts = placed.groupBy("file", "range").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    starts = first_lines(counts).join(counts.select("file", "range", "first"), ["file", "range"])
    line = (F.col("before") + F.col("place") - F.col("first") + 1).alias("line")
    kept = [c for c in wanted.columns if c not in ("range", "place")]
    return wanted.join(starts, ["file", "range"]).select(*kept, line)


# --- growing files ----------------------------------------------------------


@dataclass
class LineRange(InputPartition):
    """The lines that start in a range of bytes; ``base`` is where whole lines begin."""

    file: str
    base: int
    start: int
    stop: int


def cut_ranges(file: str, start: int, stop: int, size: int) -> list[LineRange]:
    """Ranges of at most ``size`` bytes over the new bytes of a file."""
    return [LineRange(file, start, at, min(at + size, stop)) for at in range(start, stop, size)]


def lines_of(stream, part: LineRange) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of every line that starts in the range, read in bounded steps."""
    at = part.start
    skipping = part.start > part.base
    if skipping:
        # a line starts here only if the byte before is a line break
        at -= 1
    stream.seek(at)
    held: list[bytes] = []
    while True:
        block = stream.read(STEP_BYTES)
        pieces = block.split(b"\n")
        for piece in pieces[:-1]:
            held.append(piece)
            line = b"".join(held)
            held = []
            if skipping:
                skipping = False
            elif at < part.stop:
                yield at, line
            at += len(line) + 1
            if at >= part.stop:
                return
        if not block:
            return
        held.append(pieces[-1])


class _Files:
    """Files below a path in any store pyarrow knows."""

    def __init__(self, path: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (
            pafs.LocalFileSystem(), path)

    def sizes(self) -> dict[str, int]:
        """Bytes of every file; names that start with a dot or an underscore do not count."""
        info = self.fs.get_file_info(self.path)
        found = [info] if info.type == pafs.FileType.File else self.fs.get_file_info(
            pafs.FileSelector(self.path, allow_not_found=True, recursive=True))
        return {
            f.path: f.size for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"
        }

    def whole_lines(self, file: str, start: int, size: int) -> int:
        """End of the last complete line between ``start`` and ``size``; ``start`` if there is none."""
        with self.fs.open_input_file(file) as stream:
            stop = size
            while stop > start:
                at = max(start, stop - STEP_BYTES)
                stream.seek(at)
                found = stream.read(stop - at).rfind(b"\n")
                if found >= 0:
                    return at + found + 1
                stop = at
        return start


class _TailReader(DataSourceStreamReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"ends": "{}"}

    def latestOffset(self) -> dict:
        files = _Files(self.path)
        for file, size in files.sizes().items():
            self.known[file] = files.whole_lines(file, min(self.known.get(file, 0), size), size)
        return {"ends": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[LineRange]:
        before, after = json.loads(start["ends"]), json.loads(end["ends"])
        parts: list[LineRange] = []
        for file, stop in sorted(after.items()):
            begin = before.get(file, 0)
            if stop < begin:
                raise ValueError(f"{file} was cut from {begin} to {stop} bytes")
            parts += cut_ranges(file, begin, stop, self.size)
        # what is planned is where the next look for line breaks begins
        self.known.update(after)
        return parts

    def read(self, partition: LineRange) -> Iterator[tuple]:
        files = _Files(self.path)
        with files.fs.open_input_file(partition.file) as stream:
            for place, (at, line) in enumerate(lines_of(stream, partition)):
                text = line.removesuffix(b"\r").decode("utf-8", "replace")
                yield partition.file, partition.start, place, at, text


class TailedLines(DataSource):
    """Complete lines of the files below ``path``; option ``rangeBytes`` bounds what a task reads."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return "file string, range long, place long, at long, value string"

    def streamReader(self, schema) -> _TailReader:
        return _TailReader(self.options["path"], int(self.options.get("rangeBytes", RANGE_BYTES)))


def tail(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines as they are appended: ``(file, range, place, at, value)``; ``at`` is the line's first byte."""
    spark.dataSource.register(TailedLines)
    return spark.readStream.format(SOURCE).option("path", path).option("rangeBytes", range_bytes).load()
