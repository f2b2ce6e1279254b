"""Table scans with fixed layouts, strict checks and quarantine."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidegauge import schemas
from tidegauge.functions.text import json_status, trim_space
from tidegauge.operators.evaluation import normalize_golden, require_golden
from tidegauge.sources import lines


class SourceError(ValueError):
    """A source that cannot be read as asked."""


def read_raw_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customer CSV with a header, in the fixed layout; a malformed row fails the job."""
    return (
        spark.read.schema(schemas.RAW_CUSTOMERS)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )


def _require_bytes(spark: SparkSession, path: str) -> None:
    try:
        files = spark.read.format("binaryFile").load(path).select("length")
        size = files.agg(F.sum("length")).first()[0]
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            raise FileNotFoundError(path) from error
        raise
    if not size:
        raise SourceError(f"{path} is empty")


def load_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, CSV or JSON lines by suffix; a missing, empty or other file is an error."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix not in ("parquet", "csv", "jsonl", "ndjson"):
        raise SourceError(f"unsupported suffix in {path}")
    _require_bytes(spark, path)
    if suffix == "parquet":
        return spark.read.parquet(path)
    if suffix == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    return read_json_lines(spark, path, schema or schemas.INFERENCE_LOG)


# --- JSON lines -------------------------------------------------------------


def classify_lines(rows: DataFrame, column: str = "value") -> DataFrame:
    """Add ``fault`` to text lines: invalid_json, not_object, or null for a good line.

    Blank lines are dropped.
    """
    text = trim_space(F.col(column))
    state = json_status(text)
    fault = F.when(state == "json_invalid", "invalid_json").when(state == "json_non_dict", "not_object")
    return rows.where(text != "").withColumn("fault", fault)


def parse_lines(rows: DataFrame, schema: T.StructType, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good records in the layout, and the quarantined lines with their fault."""
    marked = classify_lines(rows, column)
    good = marked.where(F.col("fault").isNull()).select(F.from_json(column, schema).alias("r")).select("r.*")
    return good, marked.where(F.col("fault").isNotNull()).select(F.col(column).alias("line"), "fault")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """Records of a JSON-lines file; in strict mode a bad line stops with its number."""
    good, bad = parse_lines(spark.read.text(path), schema)
    if not strict:
        return good
    if bad.limit(1).count():
        file, number, fault = first_bad_line(spark, path)
        raise SourceError(f"{file}, line {number}: {fault}")
    if good.isEmpty():
        raise SourceError(f"{path} holds no records")
    return good


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every bad line of JSON-lines files: ``(file, line, fault, value)``, lines counted from 1."""
    placed = lines.placed_lines(spark, path)
    bad = classify_lines(placed).where(F.col("fault").isNotNull())
    return lines.numbered(placed, bad).select("file", "line", "fault", "value")


def first_bad_line(spark: SparkSession, path: str) -> tuple[str, int, str]:
    """File, 1-based line number and fault of the first bad line; only used on failure."""
    row = bad_lines(spark, path).orderBy("file", "line").first()
    return row["file"], row["line"], row["fault"]


# --- nested documents -------------------------------------------------------


def read_golden_set(spark: SparkSession, path: str) -> DataFrame:
    """Normalised golden items of a JSON document; none, or one without query, is an error."""
    document = spark.read.schema(schemas.GOLDEN_SET).option("multiLine", True).json(path)
    items = document.select(F.explode("items").alias("item")).select("item.*")
    return require_golden(normalize_golden(items))


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenario rows of a JSON document: a list, or an object with ``scenarios``."""
    wrapped = T.StructType(
        [*schemas.SCENARIO.fields, T.StructField("scenarios", T.ArrayType(schemas.SCENARIO))]
    )
    document = spark.read.schema(wrapped).option("multiLine", True).json(path)
    own = F.when(F.col("name").isNotNull(), F.array(F.struct("name", "payload")))
    rows = document.select(F.explode(F.coalesce("scenarios", own)).alias("s"))
    return rows.select(F.col("s.name").alias("scenario_name"), "s.payload.*")


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    """Ordered feature names, from the table written beside a feature set."""
    rows = spark.read.schema("place int, feature string").json(path).orderBy("place").collect()
    return [r["feature"] for r in rows]
