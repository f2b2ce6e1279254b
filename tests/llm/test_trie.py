import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidegauge.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members = defaultdict(set)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].add(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    def below(node):
        stack = [node]
        while stack:
            one = stack.pop()
            yield one
            stack += children[one]

    out = []
    for node, convs in members.items():
        tree = list(below(node))
        ends = sorted(c for c in convs if len(rebuilt[c]) == len(node))
        out.append((
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
            sum(not children[n] for n in tree),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in tree if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def made(spark, rows, parts=3):
    frame = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, x1 string, depth int")
    return frame.repartition(parts)


def found(frame):
    return sorted((tuple(r) for r in frame.select(*COLUMNS).collect()), key=str)


def corpus(seed, convs, longest, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(convs * 2), convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant"][:rng.randint(1, 2)]), rng.choice(words)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    rows = corpus(seed, 40, 14, ["a", "é", "hello there"])
    assert found(pt.nodes(made(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = corpus(7, 15, 6, ["a", ""])
    rows += [(None, 1, "user", "lost"), (3, None, None, None), (3, None, "user", ""), (-7, 1, "user", "a"), (-10, 5, None, "b")]
    numbered = {(c, t) for c, t, _, _ in rows}
    rows = [r for k, r in enumerate(rows) if (r[0], r[1]) in numbered and not any(q[:2] == r[:2] for q in rows[:k])]
    rows += [(500, 1, "user", "same"), (500, 1, "user", "same"), (501, 2, "user", "t"), (501, 1, "user", "x" * 3_000_000)]
    assert found(pt.nodes(made(spark, rows))) == brute(rows)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert pt.nodes(none).collect() == []


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(pt, "BLOCK_CHARS", 8)
    rows = [(1, t, "user", str(t % 3)) for t in range(400)]
    rows += [(c, t, "user", str(t % 3)) for c in range(100, 160) for t in range(4)]
    assert found(pt.nodes(made(spark, rows, 6))) == brute(rows)


def test_colliding_fingerprints_are_noticed(spark, monkeypatch):
    rows = corpus(5, 20, 5, ["a", "b"])
    good = pt.bases
    tried = []
    monkeypatch.setattr(pt, "bases", lambda seed: tried.append(seed) or ([1] * pt.LANES if seed == 0 else good(seed)))
    assert found(pt.nodes(made(spark, rows))) == brute(rows)
    assert tried == [0, 1]
    monkeypatch.setattr(pt, "bases", lambda seed: [1] * pt.LANES)
    with pytest.raises(RuntimeError):
        pt.nodes(made(spark, rows))
