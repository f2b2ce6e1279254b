import datetime as dt

from pyspark.sql import functions as F

from tidegauge.streaming import logs, requests

START = dt.datetime(2024, 1, 1, 12, 0, 0)
LAYOUT = "request string, endpoint string, phase string, at timestamp"


def run(spark, folder, batches, timeout=60):
    """The batches as files of their own, one micro-batch each."""
    for number, rows in enumerate(batches):
        data = [(r, e, p, START + dt.timedelta(seconds=s)) for r, e, p, s in rows]
        spark.createDataFrame(data, LAYOUT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(LAYOUT).parquet(f"{folder}/in")
        changes = requests.gauge_changes(stream, "request", "endpoint", "phase", "at", timeout, "5 seconds")
        with requests.use_rocks(spark):
            logs.run_available(changes, logs.per_batch_table(f"{folder}/out"), checkpoint=f"{folder}/state")
    found = spark.read.parquet(f"{folder}/out").select("request", "endpoint", F.unix_timestamp("at").alias("at"), "change", "reason")
    base = spark.createDataFrame([(START,)], "t timestamp").select(F.unix_timestamp("t")).first()[0]
    return sorted((r.request, r.at - base, r.change, r.reason, r.endpoint) for r in found.collect())


def test_requests_that_never_finish_expire(spark, tmp_path):
    found = run(spark, str(tmp_path), [
        [("a", "x", "start", 0), ("a", "x", "finish", 3), ("lost", "x", "start", 1), ("late", "y", "start", 2)],
        [("late", "y", "finish", 40), ("b", "y", "start", 50)],
        [("tick", "z", "start", 100), (None, "z", "start", 100)],
    ])
    assert found == [
        ("a", 0, 1, "start", "x"), ("a", 3, -1, "finish", "x"),
        ("b", 50, 1, "start", "y"),
        ("late", 2, 1, "start", "y"), ("late", 40, -1, "finish", "y"),
        ("lost", 1, 1, "start", "x"), ("lost", 61, -1, "expired", "x"),
        ("tick", 100, 1, "start", "z"),
    ]


def test_a_finish_may_come_before_its_start_and_a_long_request_ends_at_its_limit(spark, tmp_path):
    found = run(spark, str(tmp_path), [
        [("early", None, "finish", 74), ("tick", "z", "start", 10), ("long", "x", "start", 0), ("long", "x", "finish", 75)],
        [("early", "x", "start", 72), ("tick", "z", "finish", 73)],
    ], timeout=70)
    assert found == [
        ("early", 72, 1, "start", "x"), ("early", 74, -1, "finish", "x"),
        ("long", 0, 1, "start", "x"), ("long", 70, -1, "expired", "x"),
        ("tick", 10, 1, "start", "z"), ("tick", 73, -1, "finish", "z"),
    ]
