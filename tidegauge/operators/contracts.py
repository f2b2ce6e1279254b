"""Table contracts, feature contracts and row-by-row request validation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegauge import schemas
from tidegauge.functions.encoding import CARD_ORDER, COUNTRY_ORDER, GENDER_ORDER


class ContractError(ValueError):
    """A table that breaks its contract."""


@dataclass(frozen=True)
class Rule:
    """A check on one column; bounds are closed unless ``above`` is set."""

    column: str
    low: float | None = None
    high: float | None = None
    above: float | None = None
    allowed: tuple | None = None

    @property
    def name(self) -> str:
        if self.allowed is not None:
            return "isin"
        if self.above is not None:
            return "greater_than"
        return "in_range" if self.high is not None else "greater_than_or_equal_to"

    def holds(self) -> Column:
        """True, false, or null for a missing value."""
        value = F.col(f"`{self.column}`")
        parts = []
        if self.low is not None:
            parts.append(value >= F.lit(self.low))
        if self.high is not None:
            parts.append(value <= F.lit(self.high))
        if self.above is not None:
            parts.append(value > F.lit(self.above))
        if self.allowed is not None:
            parts.append(value.isin(*self.allowed))
        condition = parts[0]
        for part in parts[1:]:
            condition = condition & part
        return condition


# The rules of the customer tables.
INTERIM_RULES = [
    Rule("CreditScore", 300, 850),
    Rule("Geography", allowed=tuple(COUNTRY_ORDER)),
    Rule("Gender", allowed=tuple(GENDER_ORDER)),
    Rule("Age", 18, 100),
    Rule("Tenure", 0, 10),
    Rule("Balance", 0),
    Rule("NumOfProducts", 1, 4),
    Rule("HasCrCard", allowed=(0, 1)),
    Rule("IsActiveMember", allowed=(0, 1)),
    Rule("EstimatedSalary", above=0),
    Rule("Exited", allowed=(0, 1)),
    Rule("Complain", allowed=(0, 1)),
    Rule("Satisfaction Score", 1, 5),
    Rule("Card Type", allowed=tuple(CARD_ORDER)),
    Rule("Point Earned", 0),
]
RAW_RULES = INTERIM_RULES


def _missing(field: T.StructField) -> Column:
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def contract_report(df: DataFrame, schema: T.StructType, rules: Sequence[Rule]) -> DataFrame:
    """Violations per column and rule, counted in one pass over the table.

    Columns that are absent or of another type are reported for every row.
    Columns beyond the contract are allowed.
    """
    have = {f.name: f for f in df.schema.fields}
    checks: list[tuple[str, str, Column]] = []
    for field in schema.fields:
        present = have.get(field.name)
        fits = present is not None and present.dataType == field.dataType
        checks.append((field.name, "dtype", F.lit(not fits)))
        if present is not None:
            checks.append((field.name, "not_null", _missing(present)))
    for rule in rules:
        if rule.column in have:
            checks.append(
                (rule.column, rule.name, ~F.coalesce(rule.holds(), F.lit(True)) & ~_missing(have[rule.column]))
            )
    counted = df.agg(*[F.count_if(broken).alias(f"v{i}") for i, (_, _, broken) in enumerate(checks)])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.lit(r).alias("rule"), F.col(f"v{i}").alias("n_violations"))
            for i, (c, r, _) in enumerate(checks)
        ]
    )
    return counted.select(F.inline(rows))


def require_contract(df: DataFrame, schema: T.StructType, rules: Sequence[Rule]) -> DataFrame:
    """Return the table, or raise on the first broken check."""
    absent = [f.name for f in schema.fields if f.name not in df.columns]
    if absent:
        raise ContractError(f"columns missing: {absent}")
    broken = contract_report(df, schema, rules).where(F.col("n_violations") > 0).first()
    if broken is not None:
        raise ContractError(
            f"column {broken['column']!r} breaks {broken['rule']} in {broken['n_violations']} rows"
        )
    return df


def require_columns(df: DataFrame, columns: Sequence[str]) -> None:
    """Raise KeyError naming the columns a table lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"required columns missing: {missing}")


# --- personal data ----------------------------------------------------------


def drop_identifiers(df: DataFrame, columns: Sequence[str] = schemas.IDENTIFIERS) -> DataFrame:
    """Drop direct identifiers; absent ones are ignored."""
    return df.drop(*columns)


def require_no_identifiers(df: DataFrame, columns: Sequence[str] = schemas.IDENTIFIERS) -> DataFrame:
    """Raise when a direct identifier is still there."""
    left = [c for c in columns if c in df.columns]
    if left:
        raise ContractError(f"direct identifiers present: {left}")
    return df


def governed_columns(df: DataFrame, columns: Sequence[str] = schemas.GOVERNED) -> DataFrame:
    """One audit row per sensitive column, with whether the table uses it."""
    rows = [(c, c in df.columns) for c in columns]
    return df.sparkSession.createDataFrame(rows, "column string, in_use boolean")


# --- feature matrix ---------------------------------------------------------


def resolve_features(df: DataFrame, features: Sequence[str], encoder=None) -> DataFrame:
    """The ordered feature matrix: taken as is, or encoded from raw columns.

    All features present: rows with a missing one are an error. Some present:
    an error. None: target and log metadata are dropped and ``encoder`` applied.
    """
    present = [c for c in features if c in df.columns]
    if len(present) == len(features):
        bad = incomplete_rows(df, features).first()["n_incomplete"]
        if bad:
            raise ContractError(f"{bad} rows lack features of the transformed contract")
        return df.select(*[F.col(f"`{c}`") for c in features])
    if present:
        raise ContractError(f"only part of the transformed features is present: {present}")
    if encoder is None:
        raise ContractError("raw columns given without an encoder")
    drop = [schemas.TARGET, *[f.name for f in schemas.LOG_METADATA]]
    return encoder.transform(df.drop(*drop)).select(*[F.col(f"`{c}`") for c in features])


def incomplete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Number of rows with at least one missing feature."""
    kinds = {f.name: f for f in df.schema.fields}
    any_missing = F.lit(False)
    for name in features:
        any_missing = any_missing | _missing(kinds[name])
    return df.agg(F.count_if(any_missing).alias("n_incomplete"))


# --- requests ---------------------------------------------------------------

# Wording of validation errors.
_AT_LEAST = "Input should be greater than or equal to {}"
_AT_MOST = "Input should be less than or equal to {}"
_ABOVE = "Input should be greater than {}"
_ONE_OF = "Value error, {} deve ser um de {}"
_NAME_EMPTY = "Value error, model_name não pode ser vazio"
_NAME_FORM = "Value error, model_name deve conter apenas letras minúsculas, números e underscore"
LOOKUP_MISSING = "Cliente não encontrado na Feature Store."

# The request fields with their defaults.
REQUEST_RULES = [
    (Rule("CreditScore", 0, 850), 600),
    (Rule("Geography", allowed=tuple(COUNTRY_ORDER)), "France"),
    (Rule("Gender", allowed=tuple(GENDER_ORDER)), "Female"),
    (Rule("Age", 18, 100), 40),
    (Rule("Tenure", 0, 10), 5),
    (Rule("Balance", 0), 0.0),
    (Rule("NumOfProducts", 1, 4), 1),
    (Rule("HasCrCard", 0, 1), 1),
    (Rule("IsActiveMember", 0, 1), 1),
    (Rule("EstimatedSalary", above=0), 50000.0),
    (Rule("Card Type", allowed=tuple(CARD_ORDER)), "SILVER"),
    (Rule("Point Earned", 0), 100),
]
DEFAULT_MODEL = "current"


def _message(rule: Rule) -> Column:
    """Error text of a rule, null when it holds."""
    value = F.col(f"`{rule.column}`")
    text = F.lit(None).cast("string")
    if rule.allowed is not None:
        text = F.when(~value.isin(*rule.allowed), F.lit(_ONE_OF.format(rule.column, list(rule.allowed))))
    elif rule.above is not None:
        text = F.when(value <= F.lit(rule.above), F.lit(_ABOVE.format(rule.above)))
    else:
        text = F.when(value < F.lit(rule.low), F.lit(_AT_LEAST.format(rule.low)))
        if rule.high is not None:
            text = text.when(value > F.lit(rule.high), F.lit(_AT_MOST.format(rule.high)))
    return F.when(text.isNotNull(), F.concat(F.lit(f"{rule.column}: "), text))


def _model_name_error(name: Column) -> Column:
    text = F.when(name == "", F.lit(_NAME_EMPTY)).when(~name.rlike("^[a-z0-9_]+$"), F.lit(_NAME_FORM))
    return F.when(text.isNotNull(), F.concat(F.lit("model_name: "), text))


def _with_verdict(df: DataFrame, errors: list[Column]) -> DataFrame:
    listed = df.withColumn("errors", F.array_compact(F.array(*errors)))
    return listed.withColumns(
        {
            "status": F.when(F.size("errors") == 0, F.lit("ok")).otherwise(F.lit("error")),
            "error": F.when(F.size("errors") > 0, F.array_join("errors", "; ")),
        }
    )


def validate_requests(df: DataFrame) -> DataFrame:
    """Fill defaults, then add ``errors``, ``status`` and ``error`` per request row."""
    filled = df
    for rule, default in REQUEST_RULES:
        given = F.col(f"`{rule.column}`") if rule.column in df.columns else F.lit(None)
        filled = filled.withColumn(rule.column, F.coalesce(given, F.lit(default)))
    given = F.col("model_name") if "model_name" in df.columns else F.lit(None).cast("string")
    filled = filled.withColumn("model_name", F.lower(F.trim(F.coalesce(given, F.lit(DEFAULT_MODEL)))))
    errors = [_message(rule) for rule, _ in REQUEST_RULES]
    return _with_verdict(filled, [*errors, _model_name_error(F.col("model_name"))])


def validate_lookups(df: DataFrame) -> DataFrame:
    """Check ``customer_id`` and the model name of lookup requests."""
    given = F.col("model_name") if "model_name" in df.columns else F.lit(None).cast("string")
    named = df.withColumn("model_name", F.lower(F.trim(F.coalesce(given, F.lit(DEFAULT_MODEL)))))
    key = F.when(F.col("customer_id").isNull(), F.lit("customer_id: Field required")).when(
        F.col("customer_id") <= 0, F.lit("customer_id: " + _ABOVE.format(0))
    )
    return _with_verdict(named, [key, _model_name_error(F.col("model_name"))])


def batch_summary(items: DataFrame) -> DataFrame:
    """Total, successful and failed rows."""
    ok = F.count_if(F.col("status") == "ok")
    total = F.count(F.lit(1))
    return items.agg(total.alias("total"), ok.alias("success"), (total - ok).alias("errors"))
