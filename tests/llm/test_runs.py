import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tidegauge.llm import periodic_runs as pr


def brute_runs(word, least=24, turns=3):
    """All runs by trying every period; a run's period must be its smallest."""
    n, out, seen = len(word), [], set()
    for q in range(1, n // turns + 1):
        i = 0
        while i + q < n:
            if word[i] != word[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and word[i] == word[i + q]:
                i += 1
            length = i - a + q
            if length >= max(least, turns * q) and not any(
                q % p == 0 and (a, length, p) in seen for p in range(1, q)
            ):
                out.append((a, length, q))
                seen.add((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(40))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    word = []
    while len(word) < rng.randint(1, 160):
        piece = [rng.randint(1, rng.choice([1, 2, 3])) for _ in range(rng.randint(1, 7))]
        word += piece * rng.randint(1, 7) + piece[:rng.randint(0, 3)]
    assert pr.runs_of(word) == brute_runs(word)
    assert pr.runs_of(word, 2, 2) == brute_runs(word, 2, 2)


def test_tree_extensions_equal_brute_force():
    rng = random.Random(4)
    for n in (1, 2, 5, 60):
        word = [rng.randint(1, 3) for _ in range(n)]
        tree = pr.SuffixTree(word)
        for descending in (False, True):
            key = lambda i: [-x if descending else x for x in word[i:]]
            assert tree.suffixes(descending) == [n, *sorted(range(n), key=key)]
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        if pairs:
            got = tree.extension(*map(np.array, zip(*pairs)))
            for (a, b), k in zip(pairs, got):
                assert word[a:a + k] == word[b:b + k] and word[a:][k:k + 1] != word[b:][k:k + 1]


def brute(rows):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        h, n = zlib.crc32(str(doc).encode() if doc is not None else b""), len(words)
        if h % 10 == 0 and n:
            g, old = h // 10, list(words)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [old[i] if i < a else old[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(words)
        kept = [w for k, w in enumerate(words) if not any(s + q <= k < s + m for s, m, q in runs)]
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
        out.append((doc, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                    hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                    hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_documents_equal_brute_force(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(9)
    rows = list(odd_rows)
    for k in range(60):
        base = [rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 40))]
        rows.append((1000 + k, " ".join(base * rng.randint(1, 6) + [str(x) for x in range(rng.randint(0, 30))] + base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in pr.measure(docs, pr.planted).select(*COLUMNS).collect()), key=str)
    assert got == brute(rows)
    plain = pr.measure(odd_docs, pr.planted).select(*COLUMNS).collect()
    assert sorted((tuple(r) for r in plain), key=str) == brute(odd_rows)
    assert pr.measure(no_docs).collect() == []


def test_long_texts(spark):
    period = [f"w{k}" for k in range(5000)]
    docs = spark.createDataFrame([(1, " ".join(period * 40)), (2, " ".join(str(k * k) for k in range(1_500_000)))],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in pr.measure(docs).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period) == (1, 0, 200_000, 5000)
    assert got[1].collapsed == " ".join(period)
    assert got[2].n_runs == 0 and len(got[2].collapsed) > 15_000_000
