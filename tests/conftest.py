import os
import sys

import pytest
from pyspark.sql.types import StructType

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidegauge import schemas  # noqa: E402
from tidegauge.session import build_session  # noqa: E402

SAMPLE = """
600,France,Female,30,2,1000.0,1,1,1,50000.0,0,0,4,SILVER,100
650,Germany,Male,40,5,2000.0,2,0,1,60000.0,1,1,2,GOLD,200
700,Spain,Female,35,3,1500.0,1,1,0,55000.0,0,0,5,PLATINUM,150
720,France,Male,50,7,3000.0,3,1,0,70000.0,1,1,1,DIAMOND,250
680,Germany,Female,28,1,0.0,2,0,1,52000.0,0,0,4,SILVER,120
710,Spain,Male,45,8,2500.0,1,1,0,68000.0,1,1,2,GOLD,230
690,France,Female,33,4,1800.0,2,1,1,58000.0,0,0,5,PLATINUM,170
640,Germany,Male,41,6,2200.0,1,0,1,61000.0,1,0,3,DIAMOND,210
730,Spain,Female,38,9,2700.0,3,1,0,73000.0,0,1,1,SILVER,260
660,France,Male,29,2,1300.0,2,1,1,54000.0,1,0,4,GOLD,140
""".split()


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", 4, {"spark.ui.enabled": "false", "spark.driver.memory": "4g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def interim(spark):
    """The ten sample customers without identifiers."""
    kinds = {"bigint": int, "double": float, "string": str}
    types = [kinds[f.dataType.simpleString()] for f in schemas.INTERIM_CUSTOMERS.fields]
    rows = [tuple(t(v) for t, v in zip(types, line.split(","))) for line in SAMPLE]
    return spark.createDataFrame(rows, schemas.INTERIM_CUSTOMERS)


@pytest.fixture(scope="session")
def raw(spark, interim):
    """The ten sample customers with identifiers."""
    names = interim.columns
    rows = [(i + 1, 100 + i, f"Name{i}", *r) for i, r in enumerate(interim.collect())]
    order = ["RowNumber", "CustomerId", "Surname", *names]
    by_name = {f.name: f for f in schemas.RAW_CUSTOMERS.fields}
    return spark.createDataFrame(rows, StructType([by_name[c] for c in order]))
