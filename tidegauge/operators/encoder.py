"""The churn feature encoder as a pipeline estimator.

Fitting is one aggregate over the training rows; the fitted model is a handful
of numbers, and applying it is a projection.
"""

from __future__ import annotations

import warnings

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge import schemas
from tidegauge.functions import encoding as E

NUMERIC = [
    "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
    "EstimatedSalary", "Point Earned", "BalancePerProduct", "PointsPerSalary",
]
CATEGORICAL = ["Card Type", "Gender", "Geo_Germany", "Geo_Spain"]
# Card codes of the exploratory variant.
CARD_CODES = {"SILVER": 1, "GOLD": 2, "PLATINUM": 3, "DIAMOND": 4}
GENDER_CODES = {"Female": 0, "Male": 1}


def enrich(df: DataFrame) -> DataFrame:
    """Add balance per product and points per salary."""
    return df.withColumns(
        {
            "BalancePerProduct": E.balance_per_product(F.col("Balance"), F.col("NumOfProducts")),
            "PointsPerSalary": E.points_per_salary(F.col("`Point Earned`"), F.col("EstimatedSalary")),
        }
    )


def rename_prefix(df: DataFrame, old: str = "Geography_", new: str = "Geo_") -> DataFrame:
    """Replace a part of column names."""
    return df.withColumnsRenamed({c: c.replace(old, new) for c in df.columns if old in c})


class LeakageDropper(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Drop columns that reveal the target; absent ones are ignored."""

    columns = Param(Params._dummy(), "columns", "columns to drop", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._setDefault(columns=schemas.LEAKAGE)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def missing(self, df: DataFrame) -> list[str]:
        """Configured columns the table lacks."""
        return [c for c in self.getOrDefault(self.columns) if c not in df.columns]

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.getOrDefault(self.columns))


class LeakageFilter(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Remember which of the revealing columns the training table has, and drop just these.

    Columns the table lacks are named in a warning; one that only a later table has stays there.
    """

    columns = Param(Params._dummy(), "columns", "columns that reveal the target", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._setDefault(columns=schemas.LEAKAGE)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, df: DataFrame) -> LeakageDropper:
        wanted = self.getOrDefault(self.columns)
        dropper = LeakageDropper(columns=[c for c in wanted if c in df.columns])
        if absent := sorted({c for c in wanted if c not in df.columns}):
            warnings.warn(f"columns to drop are not in the table: {', '.join(absent)}", stacklevel=2)
        return dropper


class _EncoderParams(Params):
    variant = Param(Params._dummy(), "variant", "standard or exploratory", TypeConverters.toString)
    means = Param(Params._dummy(), "means", "column means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "column deviations", TypeConverters.toListFloat)
    passthrough = Param(Params._dummy(), "passthrough", "columns kept as they are", TypeConverters.toListString)

    def _scaled(self) -> list[str]:
        exploratory = self.getOrDefault(self.variant) == "exploratory"
        return CATEGORICAL + NUMERIC if exploratory else NUMERIC

    def _unscaled(self, df: DataFrame) -> DataFrame:
        """Encoded but not yet scaled columns, with the columns to keep."""
        enriched = enrich(df)
        if self.getOrDefault(self.variant) == "exploratory":
            card = E.mapped_code(F.col("`Card Type`"), CARD_CODES)
            gender = E.mapped_code(F.col("Gender"), GENDER_CODES)
        else:
            card = E.ordinal(F.col("`Card Type`"), E.CARD_ORDER)
            gender = E.ordinal(F.col("Gender"), E.GENDER_ORDER)
        kept = [c for c in self.getOrDefault(self.passthrough) if c in df.columns]
        return enriched.select(
            *[F.col(f"`{c}`") for c in kept],
            card.alias("Card Type"),
            gender.alias("Gender"),
            *[c.alias(n) for n, c in E.one_hot(F.col("Geography"), E.COUNTRY_ORDER, "Geo_").items()],
            *[F.col(f"`{c}`").cast("double").alias(c) for c in NUMERIC],
        )


class ChurnEncoder(Estimator, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learn means and population deviations on the training rows."""

    @keyword_only
    def __init__(self, *, variant="standard", passthrough=None):
        super().__init__()
        self._setDefault(variant="standard", passthrough=[])
        self._set(variant=variant, passthrough=passthrough or [])

    def _fit(self, df: DataFrame) -> ChurnEncoderModel:
        names = self._scaled()
        row = self._unscaled(df).agg(
            *[F.avg(f"`{c}`").alias(f"m{i}") for i, c in enumerate(names)],
            *[F.stddev_pop(f"`{c}`").alias(f"s{i}") for i, c in enumerate(names)],
        ).first()
        model = ChurnEncoderModel()
        return model._set(
            variant=self.getOrDefault(self.variant),
            passthrough=self.getOrDefault(self.passthrough),
            means=[row[f"m{i}"] or 0.0 for i in range(len(names))],
            deviations=[row[f"s{i}"] or 0.0 for i in range(len(names))],
        )


class ChurnEncoderModel(Model, _EncoderParams, DefaultParamsReadable, DefaultParamsWritable):
    """Encode and scale: kept columns, then the features in their fixed order."""

    def __init__(self):
        super().__init__()
        self._setDefault(variant="standard", passthrough=[])

    def _transform(self, df: DataFrame) -> DataFrame:
        means, deviations = self.getOrDefault(self.means), self.getOrDefault(self.deviations)
        scale = {c: (means[i], deviations[i]) for i, c in enumerate(self._scaled())}
        base = self._unscaled(df)
        kept = base.columns[: len(base.columns) - len(schemas.FEATURES)]
        return base.select(
            *[F.col(f"`{c}`") for c in kept],
            *[
                (E.standardize(F.col(f"`{c}`"), *scale[c]) if c in scale else F.col(f"`{c}`")).alias(c)
                for c in schemas.FEATURES
            ],
        )

    def keeping(self, *columns: str) -> ChurnEncoderModel:
        """The same encoder with other columns kept beside the features."""
        return self.copy()._set(passthrough=list(columns))

    def parameters(self, spark: SparkSession) -> DataFrame:
        """The fitted numbers as a table, in feature order."""
        means, deviations = self.getOrDefault(self.means), self.getOrDefault(self.deviations)
        rows = [(i, c, means[i], deviations[i]) for i, c in enumerate(self._scaled())]
        return spark.createDataFrame(rows, "place int, feature string, mean double, deviation double")
