import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import words
from tidegauge.llm import quality_rules as q
from tidegauge.llm import rule_ensemble, toxicity
from tidegauge.llm.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def plain_counts(text):
    """The counts of the quality rules written out for one text."""
    text = text or ""
    w = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k:k + 8])].append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    symbols = len(re.findall("[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_the_plain_ones(spark, odd_docs, no_docs):
    rng = random.Random(17)
    loop = words(rng, 10)
    texts = [" ".join([loop] * 4), loop + "\n" + loop + " x " + loop, "a " * 30, "#*$%&|<> x\n#*$%&|<> x\n \n \n", "a b c d e f g h a b c d e f g h"]
    docs = odd_docs.select("doc_id", "text").unionAll(
        spark.createDataFrame([(600 + k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    )
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    found = sorted(((r.doc_id, *[r[c] for c in columns]) for r in q.measure(docs).collect()), key=repr)
    assert found == sorted(((r.doc_id, *plain_counts(r.text)) for r in docs.collect()), key=repr)
    assert q.measure(no_docs).count() == 0 and q.keep_good(no_docs).count() == 0
    kept = q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == q.measure(odd_docs).where("kept").count() > 0


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op6_quality_rules"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    cursor = con.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in frame.collect()) == sorted(cursor.fetchall())


def test_verdicts_follow_the_labels(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 1")
    rows = QUERIES["op6_quality_rules"](spark, FOLDER).join(labels, "doc_id").where("not base_failed")
    assert rows.where("not kept").count() == 0


def labelled(spark):
    rng = random.Random(19)
    rows, labels = [], []
    for k in range(240):
        text, toxic, good = words(rng, rng.randint(25, 80)), int(k % 5 == 0), int(k % 4 != 0)
        if toxic:
            text += " you grobnik " + words(rng, 5) + " grobniks"
        if not good:
            text = text.replace("e", "#$")
        rows.append((k, text))
        labels.append((k, good, toxic))
    rows += [(900, None), (901, ""), (None, "words"), (5, rows[5][1]), (902, "x " * 30000)]
    labels += [(777, 1, 0), (None, 1, 1), (6, None, None), labels[7]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {k: (g, t) for k, g, t in labels[:240]}


@pytest.mark.parametrize("module, place", [(toxicity, 1), (rule_ensemble, 0)])
def test_classifier_on_held_out_rows(spark, no_docs, module, place):
    docs, labels, truth = labelled(spark)
    held_out = toxicity.crc_remainder(F.col("doc_id"), 3) == 1
    model = module.learn(docs, labels, ~held_out)
    scored = module.score(docs, model).withColumn("held_out", held_out).collect()
    assert len(scored) == docs.count() and all(0.0 <= r.score <= 1.0 for r in scored)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in scored)
    held = [r for r in scored if r.held_out and r.doc_id in truth]
    yes = [r.score for r in held if truth[r.doc_id][place]]
    no = [r.score for r in held if not truth[r.doc_id][place]]
    assert sum(a > b for a in yes for b in no) / (len(yes) * len(no)) > 0.97
    assert len({r.score for r in scored if r.doc_id == 5}) == 1
    none = module.learn(docs, labels.where("doc_id < 0"), ~held_out)
    assert {r.score for r in module.score(docs, none).collect()} == {0.5}
    one_class = module.learn(docs, labels.where("toxic = 0 and quality = 1"), ~held_out)
    assert len({r.score for r in module.score(docs, one_class).collect()}) == 1
    assert module.score(no_docs, model).count() == 0


def test_slots_do_not_cross_texts():
    def alone(text):
        return set(toxicity.distinct_slots([text])[0].tolist())

    texts = ["abcdef", "", "gh", "ABCDEF", "é" * 10]
    slots, owners = toxicity.distinct_slots(texts)
    for k, text in enumerate(texts):
        assert set(slots[owners == k].tolist()) == alone(text)
    assert alone("abcdef") == alone("ABCDEF") and len(alone("abcdef")) == 6 + 5 + 4 and not alone("")


def test_paths_of_described_trees():
    text = """Tree 0 (weight 1.0):
    If (feature 0 <= 2.5)
     If (feature 3 <= 0.25)
      Predict: 1.0
     Else (feature 3 > 0.25)
      Predict: 0.0
    Else (feature 0 > 2.5)
     Predict: 0.0
"""
    rules = rule_ensemble.paths(text)
    shown = {tuple((c.feature, c.above, c.threshold) for c in r) for r in rules}
    assert shown == {
        ((0, False, 2.5),), ((0, False, 2.5), (3, False, 0.25)), ((0, False, 2.5), (3, True, 0.25)), ((0, True, 2.5),)
    }
