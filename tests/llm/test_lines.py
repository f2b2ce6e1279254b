import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegauge.llm import line_runs

SPACE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key_of(line):
    return line.strip(SPACE).translate(LOWER)


def brute(rows):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 40:
                holders[key_of(line)].add(doc)
    keeper = {k: max(d, key=lambda x: (x is not None, x)) for k, d in holders.items() if len(d) >= 5}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key_of(x) not in keeper or keeper[key_of(x)] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    stock = ["A shared LICENCE line of some forty code points %d" % k for k in range(12)]
    stock += ["é" * 39, "é" * 40, "É" * 45, "x" * 39, "  " + "y" * 40 + "\t\r", "Y" * 40, " " + "z" * 39]
    rows = []
    for doc in range(n):
        lines = [rng.choice([*stock, "", "short", f"a line that only document {doc} holds, number {rng.random()}"])
                 for _ in range(rng.randint(0, 9))]
        rows.append((doc, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (6, 3), (7, 2)])
def test_equals_brute_force(spark, batches, fan_in):
    rows = corpus(3, 80) + [(None, "é" * 40), (None, "é" * 40), (7, "é" * 40 + "\n" + "x" * 50), (79, "é" * 40), (5, None), (6, "")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(line_runs.drop_repeated(docs, batches, fan_in)) == brute(rows)


def test_a_line_that_fills_every_slice(spark, monkeypatch):
    monkeypatch.setattr(line_runs, "BATCHES", 3)
    common = "The very same line in each and every document."
    rows = [(k, f"{common}\n{k}\n{common.upper()}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = found(line_runs.drop_repeated(docs, 3))
    assert got == brute(rows)
    assert sum(r[2] for r in got) == 2 * 299


def test_odd_rows_and_clashing_columns(odd_docs, odd_rows, no_docs):
    assert found(line_runs.drop_repeated(odd_docs)) == brute(odd_rows)
    assert found(line_runs.drop_repeated(no_docs)) == []


def test_runs_are_levelled_and_thinned(spark):
    store = line_runs.LineRuns(fan_in=2)
    for batch in range(3):
        ids = range(100 - 10 * batch, 90 - 10 * batch, -1)
        rows = [(b"hot", d) for d in ids] + [(b"k%d" % d, d) for d in ids]
        store.add(spark.createDataFrame(rows, "key binary, doc_id long"))
    assert [len(level) for level in store.levels] == [1, 1]
    counts = [run.where(F.col("key") == F.lit(b"hot")).count() for run in store.runs()]
    assert sorted(counts) == [0, 5]  # the last batch finds the key settled
    assert [tuple(r) for r in store.repeated().collect()] == [(bytearray(b"hot"), 100)]


def test_long_text(spark):
    line = "a line of more than forty code points, number "
    text = "\n".join(line + str(k) for k in range(200_000)) + "\n" + "w" * 5_000_000
    rows = [(k, text) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, len(r.text)) for r in line_runs.drop_repeated(docs).collect())
    assert got == [(k, 200_001, 200_001, 0) for k in range(4)] + [(4, 200_001, 0, len(text))]
