import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import winnowing as w
from tidegauge.llm.catalog import QUERIES


def gram_hash(text):
    hashes, _, _ = w.winnow([text])
    return int(hashes[0])


def brute(text, cache={}):
    """Chosen (hash, position) pairs by trying every window."""
    if not text:
        return []
    n = max(1, len(text) - w.GRAM + 1)
    hashes = [cache.setdefault(g, gram_hash(g)) for g in (text[i:i + w.GRAM] for i in range(n))]
    chosen = set()
    for start in range(max(1, n - w.WINDOW + 1)):
        span = range(start, min(n, start + w.WINDOW))
        chosen.add(min(span, key=lambda i: (hashes[i], -i)))
    return [(hashes[i], i) for i in sorted(chosen)]


def test_winnowing_equals_trying_every_window(odd_rows):
    texts = [t or "" for _, t in odd_rows if len(t or "") < 2500] + ["ab" * 100, "a" * 300, "é" * 17, "x" * 15]
    hashes, positions, offsets = w.winnow(texts)
    for k, text in enumerate(texts):
        own = slice(offsets[k], offsets[k + 1])
        assert list(zip(hashes[own].tolist(), positions[own].tolist())) == brute(text)


def test_shared_passage_is_found():
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    for _ in range(50):
        shared = draw(w.GRAM + w.WINDOW - 1)
        a, b = draw(rng.randint(0, 200)) + shared + draw(90), draw(rng.randint(0, 200)) + shared + draw(70)
        hashes, _, offsets = w.winnow([a, b])
        assert np.intersect1d(hashes[:offsets[1]], hashes[offsets[1]:]).size


def expected_rows(rows):
    out = []
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = w.edited(text, following)
        out.append((i, len(text), new, [h for h, _ in brute(text)], [h for h, _ in brute(new)], {h for h, _ in brute(following)}))
    return out


def check(found, rows):
    found = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    for i, n, new, own, other, following in expected_rows(rows):
        r = found[i]
        to_hex = lambda hs: "".join(f"{h:08x}" for h in hs)
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (n, to_hex(own), to_hex(other))
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert abs(r.near_edited - like(set(own), set(other))) < 1e-12
        assert abs(r.near_next - like(set(own), following)) < 1e-12
        edited = r.edited_sha256 if hasattr(r, "edited_sha256") else hashlib.sha256(r.edited.encode()).hexdigest()
        assert edited == hashlib.sha256(new.encode()).hexdigest()


def test_neighbours_across_ranges(spark, odd_rows):
    rows = {i: t for i, t in odd_rows if i is not None and len(t or "") < 2500}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(4)
    check(w.compare_with_next(docs).collect(), [(i, rows[i] or "") for i in sorted(rows, reverse=True)])


def test_odd_rows_and_small_tables(spark, odd_docs, no_docs):
    rows = w.compare_with_next(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    same = [r for r in rows if r.doc_id == 129]
    assert len(same) == 3 and len({r.fingerprint for r in same}) == 1 and sum(r.near_next == 1.0 for r in same) >= 2
    assert w.compare_with_next(no_docs).count() == 0
    alone = w.compare_with_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert alone[0].edited == "abcabc" and alone[0].near_next == 1.0
    assert w.fingerprint(odd_docs).where(F.size("hashes") != F.size("positions")).count() == 0


@pytest.mark.parametrize("partitions", [1, 12])
def test_large_ids_no_ids_and_busy_ids(spark, partitions):
    texts = [f"text number {k} of some words and more of {k * k}" for k in range(400)]
    rows = [(2**60 + k, texts[k]) for k in range(40)] + [(None, texts[40])]
    rows += [(None, texts[k]) for k in range(41, 120)] + [(77, texts[k]) for k in range(120, 260)]
    rows += [(k, texts[k]) for k in range(260, 300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = w.compare_with_next(docs).collect()
        one = w.compare_with_next(spark.createDataFrame(rows[:41], "doc_id long, text string").coalesce(1)).collect()
        frame = w.documents_of(docs).withColumn("tie", F.xxhash64("text"))
        ties = {(r.doc_id, r.text): r.tie for r in frame.collect()}
        bounds = w._range_bounds(frame, partitions)
        parts = frame.groupBy(w._range_of(F.struct("doc_id", "tie"), bounds).alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(one) == 41
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, ties[r]), reverse=True)
    expected = [(i, w.edited(t, ordered[(k + 1) % len(ordered)][1])) for k, (i, t) in enumerate(ordered)]
    assert sorted(((r.doc_id, r.edited) for r in found), key=str) == sorted(expected, key=str)
    # no id, or the lack of one, fills a task
    assert max(r["count"] for r in parts) <= max(60, 3 * len(rows) // partitions) or partitions == 1


def test_query_over_the_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = sorted(((r.doc_id, r.text or "") for r in docs), reverse=True)
    if sum(len(t) for _, t in rows) > 2_000_000:
        return
    found = QUERIES["op8_winnowing"](spark, folder).collect()
    keep = [k for k, (_, t) in enumerate(rows) if len(t) < 1200][:60]
    by_id = {r.doc_id: r for r in found}
    assert len(by_id) == len(rows)
    for k in keep:
        i, text = rows[k]
        new = w.edited(text, rows[(k + 1) % len(rows)][1])
        assert by_id[i].fingerprint == "".join(f"{h:08x}" for h, _ in brute(text))
        assert by_id[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
