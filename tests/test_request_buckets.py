import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tidegauge.streaming import logs, requests

START = dt.datetime(2024, 1, 1, 12, 0, 0)
LAYOUT = "request string, endpoint string, phase string, at timestamp"


def run(spark, folder, batches, timeout, **options):
    """The batches as one file each, a micro-batch a file."""
    for number, rows in enumerate(batches):
        data = [(r, e, p, START + dt.timedelta(seconds=s)) for r, e, p, s in rows]
        spark.createDataFrame(data, LAYOUT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(LAYOUT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    changes = requests.gauge_changes(stream, "request", "endpoint", "phase", "at", timeout, "5 minutes", **options)
    with requests.use_rocks(spark):
        logs.run_available(changes, logs.per_batch_table(f"{folder}/out"))
    out = spark.read.parquet(f"{folder}/out")
    found = out.select("request", "endpoint", F.unix_timestamp("at").alias("at"), "change", "reason")
    base = spark.createDataFrame([(START,)], "t timestamp").select(F.unix_timestamp("t")).first()[0]
    return sorted((r.request, r.at - base, r.change, r.reason, r.endpoint) for r in found.collect())


def test_the_limit_holds_whichever_batch_brings_the_finish(spark, tmp_path):
    found = run(spark, str(tmp_path), [
        [("late", "x", "start", 0), ("again", "x", "start", 0), ("same", "x", "start", 0), ("same", "x", "finish", 75)],
        [("late", "x", "finish", 75), ("again", "y", "start", 70), ("again", "y", "finish", 72)],
    ], timeout=60)
    assert found == [
        ("again", 0, 1, "start", "x"), ("again", 60, -1, "expired", "x"),
        ("again", 70, 1, "start", "y"), ("again", 72, -1, "finish", "y"),
        ("late", 0, 1, "start", "x"), ("late", 60, -1, "expired", "x"),
        ("same", 0, 1, "start", "x"), ("same", 60, -1, "expired", "x"),
    ]


def test_many_requests_in_few_buckets_over_several_batches(spark, tmp_path):
    draw = random.Random(7)
    batches, expected = [[] for _ in range(3)], []
    for i in range(300):
        name, at = f"r{i}", 0
        # up to three lifetimes of one name, each later than the one before; phases fall to batches in order of time
        for _ in range(draw.choice([1, 1, 1, 3])):
            start = at + draw.randint(1, 20)
            finish = None if draw.random() < 0.3 else start + draw.randint(0, 90)
            place = min(2, start // 40)
            batches[place].append((name, f"e{start % 3}", "start", start))
            expected.append((name, start, 1, "start", f"e{start % 3}"))
            if finish is not None:
                batches[max(place, min(2, finish // 40))].append((name, None, "finish", finish))
            done = finish is not None and finish - start <= 60
            expected.append((name, finish if done else start + 60, -1, "finish" if done else "expired", f"e{start % 3}"))
            at = finish if done else start + 60
            if not done:
                break
    batches[2].append(("tick", "z", "start", 2000))
    for rows in batches:
        draw.shuffle(rows)
    found = run(spark, str(tmp_path), batches, 60, buckets=3)
    assert found == sorted([*expected, ("tick", 2000, 1, "start", "z")])


class Held:
    """State of one bucket outside a stream."""

    value, timer, hasTimedOut, watermark = None, None, False, 0

    exists = property(lambda self: self.value is not None)
    getOption = property(lambda self: self.value)

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.value = value

    def setTimeoutTimestamp(self, millis):
        self.timer = millis

    def remove(self):
        self.value = None


def test_one_call_takes_all_requests_of_a_bucket():
    n, step, state = 20_000, requests.bucket_step(60), Held()
    ids = [str(i) for i in range(n)]
    layout = ["request", "endpoint", "ended", "millis"]
    starts = pd.DataFrame({"request": ids, "endpoint": "x", "ended": False, "millis": range(1000, n + 1000)})
    ends = pd.DataFrame({"request": ids[::2], "endpoint": "x", "ended": True, "millis": range(2000, n + 2000, 2)})
    first = pd.concat(step((0,), iter([starts[layout], ends[layout]]), state))
    assert first.groupby("reason").size().to_dict() == {"start": n, "finish": n // 2}
    assert len(state.value[0]) == n // 2 and state.timer == 61_000

    # the first limit is reached by a watermark at it, not before
    state.hasTimedOut, state.watermark = True, 61_001
    out = pd.concat(step((0,), iter([starts[layout]]), state))
    assert out.to_dict("records") == [{"request": "1", "endpoint": "x", "millis": 61_001, "change": -1, "reason": "expired"}]
    assert state.timer == 61_002
    state.watermark = 10**9
    assert len(pd.concat(step((0,), iter([starts[layout].iloc[:0]]), state))) == n // 2 - 1
    assert not state.exists
