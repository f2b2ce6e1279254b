"""Table sinks: overwrite, append-only history, and both together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a parquet table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Replace a CSV table with header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """Replace a JSON-lines table."""
    df.write.mode("overwrite").json(path)


def append_history(df: DataFrame, path: str) -> None:
    """Add run rows to a JSON-lines history."""
    df.write.mode("append").json(path)


def write_latest_with_history(df: DataFrame, latest: str, history: str) -> None:
    """Replace the latest result and add it to the history; the rows are computed once."""
    df.write.mode("overwrite").json(latest)
    written = df.sparkSession.read.schema(df.schema).json(latest)
    append_history(written, history)


def append_inference_log(records: DataFrame, path: str) -> None:
    """Add scored rows to the inference log; every record ends its own line."""
    records.write.mode("append").json(path)


def write_feature_list(spark: SparkSession, features: Sequence[str], path: str) -> None:
    """Write ordered feature names."""
    rows = list(enumerate(features))
    spark.createDataFrame(rows, "place int, feature string").coalesce(1).write.mode("overwrite").json(path)
