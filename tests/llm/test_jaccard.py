import random
import re

import pytest

from conftest import SYLLABLES
from tidegauge.llm import jaccard_join as j
from tidegauge.llm.components import components


def brute(rows):
    """Links and classes by comparing all pairs of rows."""
    def shingles(text):
        w = re.findall("[^\x20\x09-\x0D]+", text or "")
        return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k:k + 5]) for k in range(len(w) - 4)])

    sets = [shingles(t) for _, t in rows]
    group, links = list(range(len(rows))), [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                links[a] += 1
                links[b] += 1
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[q][0] for q in range(len(rows)) if group[q] == group[k] and rows[q][0] is not None]
        out.append((i, min(ids) if ids else None, links[k]))
    return sorted(out, key=repr)


def near_copies(rng, n, length, edits):
    base = [rng.choice(SYLLABLES) + rng.choice(SYLLABLES) + str(rng.randint(0, 99)) for _ in range(length)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(length)] = f"edit{rng.randint(0, 9999)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    texts = near_copies(rng, 60, 90, 5) + near_copies(rng, 3, 40, 1) * 2 + near_copies(rng, 25, 12, 1)
    license_line = " ".join(f"license{k}" for k in range(12))
    for _ in range(60):
        own = " ".join(rng.choice(SYLLABLES) + str(rng.randint(0, 9999)) for _ in range(rng.randint(5, 40)))
        texts.append(f"{own} {license_line}")
    texts += [None, "", " \n", "one", "one", "one two three four", "one two three four", "a a a a a a a a a"]
    return [(1000 - k, t) for k, t in enumerate(texts)] + [(5, texts[0]), (5, texts[0]), (None, texts[1]), (None, None)]


def found(docs):
    return sorted(((r.doc_id, r.class_id, r.n_links) for r in j.link(docs).collect()), key=repr)


def test_equals_all_pairs(spark, rows):
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_splits_and_tiles_lose_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(j, "SMALL", 6)
    monkeypatch.setattr(j, "TILE_SETS", 9)
    monkeypatch.setattr(j, "DENSE", 0.6)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_empty_tiles_count_no_pair_again(spark, monkeypatch):
    """Buckets of two or three long sets are tiled by shingles, so that often all sets are in one tile."""
    rng = random.Random(12)
    texts = [t for k in range(16) for t in near_copies(rng, 2 + k % 2, 120, 1)]
    rows = list(enumerate(texts))
    monkeypatch.setattr(j, "TILE_SHINGLES", 100)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute(rows)


def test_keep_one_and_odd_rows(spark, odd_docs, no_docs, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    kept = j.keep_one(docs)
    assert kept.columns == docs.columns
    classes = {c for _, c, _ in brute(rows)}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(classes)
    assert found(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert j.link(no_docs).count() == 0 and j.keep_one(no_docs).count() == 0


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(1, 200)] + [(500, k) for k in range(501, 700)] + [(900, 900)]
    rows = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in rows} == {**{k: 1 for k in range(2, 201)}, **{k: 500 for k in range(501, 700)}}
