import hashlib
import random
from collections import Counter, defaultdict

import pytest

from conftest import words
from tidegauge.llm import gear_chunks as gear
from tidegauge.llm import suffix_buckets as sb


@pytest.fixture(scope="module")
def rows(odd_rows):
    """Texts with shared passages, near copies, copies and inner repeats."""
    rng = random.Random(21)
    passages = [words(rng, rng.randint(30, 90)) for _ in range(6)]
    common = words(rng, 70)
    texts = []
    for k in range(160):
        parts = [words(rng, rng.randint(0, 60))]
        if k % 3 == 0:
            parts += [common, words(rng, rng.randint(0, 30))]
        if k % 4 == 0:
            parts += [rng.choice(passages), words(rng, rng.randint(0, 30))]
        texts.append("é " * (k % 3) + " ".join(parts))
    base = words(rng, 200)
    for k in range(25):
        w = base.split(" ")
        w[rng.randrange(len(w))] = f"edit{k}é"
        texts.append(" ".join(w))
    texts += [base, base, base + base, "ab" * 300, "x" * 450, "y" * 200, "y" * 199, words(rng, 60)[:200]]
    return list(odd_rows) + [(5000 - k, t) for k, t in enumerate(texts)]


def brute_suffixes(rows):
    counts = Counter()
    raws = [(t or "").encode() for _, t in rows]
    for raw in raws:
        counts.update(raw[k:k + 200] for k in range(len(raw) - 199))
    out = []
    for (i, _), raw in zip(rows, raws):
        covered = bytearray(len(raw))
        for k in range(len(raw) - 199):
            if counts[raw[k:k + 200]] > 1:
                covered[k:k + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(raw, covered) if not c)
        spans = sum(1 for k in range(len(raw)) if covered[k] and not (k and covered[k - 1]))
        out.append((i, len(raw), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_hot, bucket_hot", [(16, 1000), (3, 4), (10**9, 10**9)])
def test_suffixes_equal_counting_all_strings(spark, rows, monkeypatch, batch_hot, bucket_hot):
    # limits are read in the workers, so they are handed over in the closures
    monkeypatch.setattr(sb, "_entries", with_limits(sb._entries, BATCH_HOT=batch_hot))
    monkeypatch.setattr(sb, "_shared", with_limits(sb._shared, BUCKET_HOT=bucket_hot))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((tuple(r) for r in sb.remove_repeats(docs).collect()), key=repr)
    assert found == brute_suffixes(rows)


def with_limits(function, **limits):
    name = function.__name__

    def run(batches):
        from tidegauge.llm import suffix_buckets

        for key, value in limits.items():
            setattr(suffix_buckets, key, value)
        return getattr(suffix_buckets, name)(batches)

    return run


def test_suffixes_of_odd_tables(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted((tuple(r) for r in sb.remove_repeats(odd_docs).collect()), key=repr) == brute_suffixes(rows)
    assert sb.remove_repeats(no_docs).count() == 0


# --- chunks -------------------------------------------------------------------------------


def brute_cuts(raw):
    """Chunk starts by rolling the gear hash byte by byte."""
    cuts, h = [0], 0
    for k, b in enumerate(raw):
        h = ((h << 1) + int(gear._GEAR[b])) % 2**32
        if h < int(gear._SMALL) and k + 1 < len(raw) and raw[k + 1] & 0xC0 != 0x80:
            cuts.append(k + 1)
    return [*cuts, len(raw)]


def brute_chunks(rows):
    seen, out = {}, []
    texts = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, text_order(rows[k])))
    for k in order:
        i, text = rows[k]
        raw = (text or "").encode()
        if (i, text or "") in texts:
            out.append((i, *texts[i, text or ""]))
            continue
        cuts = brute_cuts(raw) if raw else [0]
        chunks = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        hit = set()
        for n in range(max(1, len(chunks) - gear.RUN + 1) if chunks else 0):
            unit = tuple(chunks[n:n + gear.RUN])
            if seen.setdefault(unit, (k, n)) != (k, n):
                hit.update(range(n, n + len(unit)))
        kept, removed, spans, n = [], 0, 0, 0
        while n < len(chunks):
            end = n
            while end < len(chunks) and end in hit:
                end += 1
            size = sum(len(c) for c in chunks[n:end])
            if size >= gear.LEAST:
                removed, spans, n = removed + size, spans + 1, end
            else:
                kept += chunks[n:max(end, n + 1)]
                n = max(end, n + 1)
        texts[i, text or ""] = (len(raw), removed, spans, b"".join(kept).decode())
        out.append((i, *texts[i, text or ""]))
    return sorted(out, key=repr)


_ORDER = {}


def text_order(row):
    return _ORDER[row[0], row[1] or ""]


def test_chunks_equal_the_plain_loop(spark, rows, no_docs):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for r in gear._document_key(gear.documents_of(docs)).collect():
        _ORDER[r.doc_id, r.text] = r.dk
    found = sorted((tuple(r) for r in gear.remove_repeats(docs).collect()), key=repr)
    assert found == brute_chunks(rows)
    assert gear.remove_repeats(no_docs).count() == 0 and gear.strip_repeats(no_docs).count() == 0


def test_passages_go_but_their_first_place(spark):
    rng = random.Random(8)
    passages = [words(rng, 55) for _ in range(40)]
    rows = []
    for k in range(200):
        own = [words(rng, 40), words(rng, 40)]
        rows.append((k, own[0] + " " + passages[k % 40] + " " + own[1]))
    found = defaultdict(list)
    for r in gear.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[r.doc_id % 40].append((r.doc_id, r.n_removed))
    later = [n for group in found.values() for i, n in group if i >= 40]
    assert all(n == 0 for group in found.values() for i, n in group if i < 40)
    assert sum(n > 0 for n in later) >= 0.98 * len(later)


def test_few_short_passages_are_missed():
    """Passages of 51 words, each in two places: almost all share a unit."""
    import pyarrow as pa

    rng = random.Random(9)
    passages = [words(rng, 51) for _ in range(3000)]
    keys = []
    for _ in range(2):
        texts = [f"{words(rng, 12)} {p} {words(rng, 12)}" for p in passages]
        key, owner, _, _ = gear.units(*gear.text_bytes(pa.array(texts)))
        own = defaultdict(set)
        for k, i in zip(key.tolist(), owner.tolist()):
            own[i].add(k)
        keys.append(own)
    missed = sum(not keys[0][i] & keys[1][i] for i in range(len(passages)))
    assert missed <= 3, missed


def test_stripping_keeps_columns(odd_docs):
    out = gear.strip_repeats(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    nulls = odd_docs.where("text is null").count()
    assert out.where("text is null").count() == nulls
