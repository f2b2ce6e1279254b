"""Fixed table layouts shared by sources, contracts and jobs."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_CUSTOMERS = T.StructType(
    [
        T.StructField("RowNumber", T.LongType()),
        T.StructField("CustomerId", T.LongType()),
        T.StructField("Surname", T.StringType()),
        T.StructField("CreditScore", T.LongType()),
        T.StructField("Geography", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("Age", T.LongType()),
        T.StructField("Tenure", T.LongType()),
        T.StructField("Balance", T.DoubleType()),
        T.StructField("NumOfProducts", T.LongType()),
        T.StructField("HasCrCard", T.LongType()),
        T.StructField("IsActiveMember", T.LongType()),
        T.StructField("EstimatedSalary", T.DoubleType()),
        T.StructField("Exited", T.LongType()),
        T.StructField("Complain", T.LongType()),
        T.StructField("Satisfaction Score", T.LongType()),
        T.StructField("Card Type", T.StringType()),
        T.StructField("Point Earned", T.LongType()),
    ]
)

IDENTIFIERS = ["RowNumber", "CustomerId", "Surname"]
GOVERNED = ["Geography"]
TARGET = "Exited"
LEAKAGE = ["Exited", "Complain", "Satisfaction Score"]

INTERIM_CUSTOMERS = T.StructType([f for f in RAW_CUSTOMERS.fields if f.name not in IDENTIFIERS])

# The twelve columns a scoring request may carry.
REQUEST_COLUMNS = [
    "CreditScore", "Geography", "Gender", "Age", "Tenure", "Balance", "NumOfProducts",
    "HasCrCard", "IsActiveMember", "EstimatedSalary", "Card Type", "Point Earned",
]

# Order of the encoded matrix.
FEATURES = [
    "Card Type", "Gender", "Geo_Germany", "Geo_Spain", "CreditScore", "Age", "Tenure",
    "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember", "EstimatedSalary",
    "Point Earned", "BalancePerProduct", "PointsPerSalary",
]

MONITORING_CONTRACT = "transformed_features_v1"
LOG_METADATA = [
    T.StructField("timestamp", T.StringType()),
    T.StructField("monitoring_contract", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("churn_probability", T.DoubleType()),
    T.StructField("churn_prediction", T.IntegerType()),
    T.StructField("feature_source", T.StringType()),
    T.StructField("customer_id", T.LongType()),
]
INFERENCE_LOG = T.StructType(
    LOG_METADATA + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)

FEATURE_EXPORT = T.StructType(
    [
        T.StructField("customer_id", T.LongType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("created_timestamp", T.TimestampType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)

GOLDEN_ITEM = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("expected_answer", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("contexts", T.ArrayType(T.StringType())),
        T.StructField("expected_tools", T.ArrayType(T.StringType())),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("category", T.StringType()),
                    T.StructField("difficulty", T.StringType()),
                    T.StructField("type", T.StringType()),
                ]
            ),
        ),
    ]
)
GOLDEN_SET = T.StructType(
    [
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("title", T.StringType()),
        T.StructField("items", T.ArrayType(GOLDEN_ITEM)),
    ]
)

AGENT_TRACE = T.ArrayType(
    T.StructType(
        [T.StructField("action", T.StringType()), T.StructField("observation", T.StringType())]
    )
)

SCENARIO_PAYLOAD = T.StructType(
    [f for f in RAW_CUSTOMERS.fields if f.name in REQUEST_COLUMNS]
)
SCENARIO = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("payload", SCENARIO_PAYLOAD)]
)
