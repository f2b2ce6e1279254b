import io
import random

import pytest

from tidegauge.sources import lines, tables
from tidegauge.streaming import logs

BAD = {3: '{"a": 1}{"a": 2}', 7: "[1, 2]", 20: "not json"}


def content(count, bad=BAD):
    return [bad.get(n, "   " if n % 6 == 0 else '{"a": %d, "t": "%s"}' % (n, "é" * (n % 9))) for n in range(1, count + 1)]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 10_000])
def test_ranges_hold_every_line_once(size):
    rng = random.Random(size)
    texts = [b"", b"a", b"bb" * 40, "é".encode() * 3, b"x"]
    for start in (0, 5):
        chosen = [rng.choice(texts) for _ in range(30)]
        data = b"1234\n"[:start] + b"".join(t + b"\n" for t in chosen)
        found = [
            (at, line) for part in lines.cut_ranges("f", start, len(data), size)
            for at, line in lines.lines_of(io.BytesIO(data), part)
        ]
        assert [line for _, line in found] == chosen
        assert all(data[at : at + len(line) + 1] == line + b"\n" for at, line in found)


def test_line_longer_than_a_step(monkeypatch):
    monkeypatch.setattr(lines, "STEP_BYTES", 8)
    data = b"a" * 50 + b"\n" + b"b" * 20 + b"\nc\n"
    parts = lines.cut_ranges("f", 0, len(data), 16)
    assert [line for p in parts for _, line in lines.lines_of(io.BytesIO(data), p)] == [b"a" * 50, b"b" * 20, b"c"]


def test_bad_lines_are_numbered_over_ranges(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "one.jsonl").write_text("\n".join(content(40)) + "\n")
    (folder / "two.jsonl").write_text("\n".join(content(8)))
    (folder / "empty.jsonl").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        found = tables.bad_lines(spark, str(folder)).collect()
        first = tables.first_bad_line(spark, str(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"]) for r in found) == [
        ("one.jsonl", 3), ("one.jsonl", 7), ("one.jsonl", 20), ("two.jsonl", 3), ("two.jsonl", 7)
    ]
    assert {r["line"]: r["fault"] for r in found} == {3: "invalid_json", 7: "not_object", 20: "invalid_json"}
    assert first[1:] == (3, "invalid_json")


def test_stream_follows_a_growing_file(spark, tmp_path):
    folder, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    folder.mkdir()
    log = folder / "inference.jsonl"
    text = content(40)
    accepted = {}

    def accept(batch, batch_id):
        accepted[batch_id] = [r["value"] for r in batch.collect()]

    def run():
        stream = logs.tailed_log(spark, str(folder), range_bytes=50)
        logs.run_available(stream, logs.number_faults(out, accept), checkpoint=state)

    whole = "\n".join(text) + "\n"
    for stop in (0, 150, 420, len(whole)):  # cuts fall within lines
        log.write_text(whole[:stop])
        run()
    (folder / "late.jsonl").write_text("x\n")
    run()
    faults = spark.read.parquet(f"{out}/faults").collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["line"], r["fault"]) for r in faults) == [
        ("inference.jsonl", 3, "invalid_json"), ("inference.jsonl", 7, "not_object"),
        ("inference.jsonl", 20, "invalid_json"), ("late.jsonl", 1, "invalid_json"),
    ]
    data = whole.encode()
    assert all(data[r["at"] :].startswith(r["value"].encode()) for r in faults if "inference" in r["file"])
    good = [t for n, t in enumerate(text, 1) if n not in BAD and t.strip()]
    assert sorted(v for rows in accepted.values() for v in rows) == sorted(good)


def test_file_cut_short_is_an_error():
    reader = lines._TailReader("/nowhere", 10)
    with pytest.raises(ValueError, match="was cut"):
        reader.partitions({"ends": '{"a": 9}'}, {"ends": '{"a": 4}'})
    assert reader.latestOffset() and reader.partitions({"ends": "{}"}, {"ends": "{}"}) == []
