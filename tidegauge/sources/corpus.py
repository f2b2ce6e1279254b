"""Document corpora: discovery, reading, manifests and what changed between two of them."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidegauge.functions.text import normalize_document


def _glob_regex(pattern: str) -> str:
    """A path pattern as a regular expression: ``**/`` any folders, ``*`` and ``?`` within a name."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif pattern[k] == "*":
            out, k = out + "[^/]*", k + 1
        else:
            out, k = out + ("[^/]" if pattern[k] == "?" else re.escape(pattern[k])), k + 1
    return out


def _files(spark: SparkSession, path: str, name: str | None = None) -> DataFrame | None:
    """Files at or below a path; none if the path does not exist."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if name is not None:
        reader = reader.option("pathGlobFilter", name)
    try:
        return reader.load(path)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def discover(spark: SparkSession, root: str, patterns: Sequence[str], fixed: Sequence[str] = ()) -> DataFrame:
    """Non-empty files under ``root`` that match a pattern or are named, each once.

    A pattern is a path below ``root``; ``**`` stands for any folders, so ``*.md`` takes
    the files of the root only and ``docs/**/*.md`` all below ``docs``. Folders and named files
    that do not exist are skipped. Columns: path, modificationTime, length, content.
    """
    if not patterns and not fixed:
        raise ValueError("no pattern and no file given")
    base = root.rstrip("/")
    parts = []
    for pattern in patterns:
        folders = pattern.split("/")[:-1]
        plain = []
        for folder in folders:
            if any(c in folder for c in "*?"):
                break
            plain.append(folder)
        files = _files(spark, "/".join([base, *plain]), pattern.split("/")[-1])
        if files is not None:
            bare = re.sub(r"^[a-z][a-z0-9+.-]*:/*", "/", base)
            parts.append(files.where(F.col("path").rlike(re.escape(bare) + "/" + _glob_regex(pattern) + "$")))
    parts += [files for name in fixed if (files := _files(spark, f"{base}/{name}")) is not None]
    if not parts:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.where(F.col("length") > 0).dropDuplicates(["path"])


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON with sorted keys and an indent of two; null when the text is no JSON."""

    def one(raw: str | None) -> str | None:
        try:
            return None if raw is None else json.dumps(json.loads(raw), ensure_ascii=False, indent=2, sort_keys=True)
        except (ValueError, RecursionError):
            return None

    return text.map(one)


@F.pandas_udf(T.StringType())
def _readable(content: pd.Series) -> pd.Series:
    """Text of files with bytes that are not UTF-8, without those bytes."""
    return content.map(lambda b: bytes(b).decode("utf-8", "ignore") if b is not None else None)


def read_text(files: DataFrame) -> DataFrame:
    """Decoded and normalised text per file; JSON files with sorted keys and an indent of two.

    Bytes that are not UTF-8 are dropped.
    """
    plain = F.col("content").cast("string")
    sound = F.is_valid_utf8(plain)
    # only files with broken bytes are sent to Python
    raw = F.when(sound, plain).otherwise(_readable(F.when(~sound, F.col("content"))))
    is_json = F.lower(F.col("path")).endswith(".json")
    text = F.when(is_json, F.coalesce(canonical_json(F.when(is_json, raw)), normalize_document(raw))).otherwise(
        normalize_document(raw)
    )
    return files.select(
        F.col("path").alias("source"),
        F.when(is_json, "json").otherwise("markdown").alias("source_type"),
        text.alias("text"),
        "length",
    )


def manifest(files: DataFrame) -> DataFrame:
    """Path, size, change time and SHA-256 of each file."""
    return files.select(
        "path",
        F.col("length").alias("size_bytes"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"),
        F.sha2("content", 256).alias("sha256"),
    )


def table_manifest(documents: DataFrame, path: str, text: str) -> DataFrame:
    """Manifest of documents held in a table."""
    content = F.encode(F.col(text), "UTF-8")
    return documents.select(
        F.col(path).cast("string").alias("path"),
        F.octet_length(content).cast("long").alias("size_bytes"),
        F.sha2(content, 256).alias("sha256"),
    )


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """State of each path: unchanged, changed, added or removed."""
    before = old.select("path", F.col("sha256").alias("old_sha256"))
    after = new.select("path", F.col("sha256").alias("new_sha256"))
    state = (
        F.when(F.col("old_sha256").isNull(), "added")
        .when(F.col("new_sha256").isNull(), "removed")
        .when(F.col("old_sha256") == F.col("new_sha256"), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, "path", "full").withColumn("state", state)


def stale_documents(documents: DataFrame, path: str, new: DataFrame, old: DataFrame) -> DataFrame:
    """Documents whose path and content the old manifest does not hold."""
    fresh = new.join(old.select("path", "sha256"), ["path", "sha256"], "left_anti").select("path")
    return documents.join(fresh, documents[path].cast("string") == fresh["path"], "left_semi")
