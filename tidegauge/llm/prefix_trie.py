"""Trie of conversations that begin with turns of another one, from composable fingerprints.

A rebuilt conversation is the head of a base conversation followed by the rest of its own turns. Its texts are
never put together. A sequence of turns has the fingerprint ``sum of x(i) * B**i`` over its turns' digests, in
four residues of 31 bits, and its length; the fingerprint of two sequences in a row is that of the first
plus that of the second times a power of B, so sequences form a monoid. The fingerprint of every beginning of
a rebuilt conversation is combined from one of a stored head and the difference of two of the stored own turns.

Stored turns are sorted by conversation and turn into ranges, each range is summed up as one monoid
element, and a second pass starts from the product of the ranges before it; a conversation may span ranges.
Beginnings with equal depth and fingerprint form a node. Nodes are verified through the stored turns:
all members must have the same 128-bit digest of the last turn and the same parent fingerprint, so
that by induction all their turns are equal; else another B is taken.

A node belongs to its smallest member, and a conversation owns the beginnings longer than some length. So what a
subtree holds is a sum over the node's members of what each owns, and no level is worked after the other.
The members that end in a node are sorted by node and id in ranges and joined to blocks of text, which are
hashed one after the other, so that a node in which a third of all conversations end needs little memory.

Defined results: a null role or text is empty; rows without a conversation id are left out; turns of one number
are ordered by their digests, repeated rows being repeated turns; an empty table gives no nodes, not even a root;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegauge.llm.common import mix
from tidegauge.session import durable, through_table

PRIME = 2**31 - 1
LANES = 4
# Longest head that a rebuilt conversation takes over, and how often another B is tried.
LONGEST_HEAD = 8
TRIES = 4
BLOCK_CHARS = 1 << 16

TURNS = "conv_id long, turn long, x1 long, x2 long, bytes long"
STORED = "conv_id long, place long, f1 long, f2 long, g1 long, g2 long, x1 long, x2 long, bytes long, upto long"
STATE = "part int, whole boolean, first long, last long, count long, bytes long, lanes array<long>"
NODE = ["depth", "f1", "f2"]


def bases(seed: int) -> list[int]:
    """The B of each residue."""
    return [int(x) % (PRIME - 2) + 2 for x in mix(np.arange(1, LANES + 1, dtype=np.uint64) + np.uint64(LANES * seed))]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of each turn's role and text, and the bytes of its text."""
    for batch in batches:
        marks, sizes = [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            raw, head = text.encode(), role.encode()
            marks.append(hashlib.blake2b(b"%d:%b" % (len(head), head + raw), digest_size=16).digest())
            sizes.append(len(raw))
        x = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), pa.array(sizes, pa.int64())],
            names=["conv_id", "turn", "x1", "x2", "bytes"],
        )


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """``base ** exponents`` modulo the prime."""
    out, square = np.ones(len(exponents), np.uint64), base
    left = exponents.astype(np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * np.uint64(square) % np.uint64(PRIME)
        square, left = square * square % PRIME, left >> np.uint64(1)
    return out


class _Walk:
    """Fingerprints along sorted turns; ``count``, ``bytes`` and ``lanes`` are those of the conversation at hand."""

    def __init__(self, base: list[int]) -> None:
        self.base = base
        self.first = self.last = None
        self.count = self.bytes = 0
        self.lanes = [0] * LANES
        self.whole = True  # one conversation so far

    def start(self, conv: int, count: int, size: int, lanes: list[int]) -> None:
        self.last, self.count, self.bytes, self.lanes = conv, count, size, list(lanes)

    def step(self, convs: np.ndarray, x1: np.ndarray, x2: np.ndarray, size: np.ndarray):
        """Place, fingerprint residues before and with each turn, and bytes so far, of a batch that is not empty."""
        n = len(convs)
        new = np.empty(n, bool)
        new[0] = self.last != convs[0]
        new[1:] = convs[1:] != convs[:-1]
        if self.first is None:
            self.first = int(convs[0])
            self.whole = True
            self.whole &= not new[1:].any()
        else:
            self.whole &= not new.any()
        heads = np.flatnonzero(new)
        owner = np.cumsum(new) - 1
        carried = owner < 0
        head = np.where(carried, 0, heads[np.maximum(owner, 0)] if len(heads) else 0)
        place = np.arange(n) - head + 1 + np.where(carried, self.count, 0)

        def along(values: np.ndarray, start: int) -> np.ndarray:
            total = np.cumsum(values)
            return total - np.where(head > 0, total[head - 1], 0) + np.where(carried, start, 0)

        upto = along(size, self.bytes)
        before, after = [], []
        halves = [h for x in (x1, x2) for h in (x.view(np.uint64) >> np.uint64(32), x.view(np.uint64) & np.uint64(2**32 - 1))]
        for k, half in enumerate(halves):
            term = (half % np.uint64(PRIME) * _powers(self.base[k], place) % np.uint64(PRIME)).astype(np.int64)
            sums = along(term, self.lanes[k])
            before.append((sums - term) % PRIME)
            after.append(sums % PRIME)
        self.last, self.count, self.bytes = int(convs[-1]), int(place[-1]), int(upto[-1])
        self.lanes = [int(a[-1]) for a in after]
        return place, before, after, upto


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("conv_id", "x1", "x2", "bytes")]


def _starts(states: list, base: list[int]) -> dict[int, tuple[int, int, int, list[int]]]:
    """For each range the conversation that is open before it: the product of what earlier ranges hold of it."""
    out, open_ = {}, None
    for s in states:
        if open_ is not None:
            out[s["part"]] = open_
        conv, count, size, lanes = s["last"], s["count"], s["bytes"], s["lanes"]
        if s["whole"] and open_ is not None and open_[0] == conv:
            shift = [pow(b, open_[1], PRIME) for b in base]
            lanes = [(a + x * y) % PRIME for a, x, y in zip(open_[3], lanes, shift)]
            count, size = count + open_[1], size + open_[2]
        open_ = (conv, count, size, lanes)
    return out


def stored_turns(turns: DataFrame, base: list[int]) -> DataFrame:
    """Every turn with its place, the fingerprints of its conversation before and with it, and bytes so far."""
    spark = turns.sparkSession
    order = ["conv_id", "turn", "x1", "x2"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(turns.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    ranged = ranged.withColumn("part", F.spark_partition_id())

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, part = _Walk(base), None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(batch.schema.get_field_index("part"))[0].as_py()
                walk.step(*_columns(batch))
        if part is not None:
            row = dict(part=part, whole=bool(walk.whole), first=walk.first, last=walk.last, count=walk.count,
                       bytes=walk.bytes, lanes=walk.lanes)
            kinds = [("part", pa.int32()), ("whole", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()),
                     ("count", pa.int64()), ("bytes", pa.int64()), ("lanes", pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema(kinds))

    states = sorted(ranged.mapInArrow(sum_up, STATE).collect(), key=lambda s: s["part"])  # one row per range
    starts = _starts(states, base)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if walk is None:
                walk = _Walk(base)
                open_ = starts.get(batch.column(batch.schema.get_field_index("part"))[0].as_py())
                if open_ is not None:
                    walk.start(*open_)
            convs, x1, x2, size = _columns(batch)
            place, before, after, upto = walk.step(convs, x1, x2, size)
            packed = [(f[k] << 31) | f[k + 1] for f in (after, before) for k in (0, 2)]
            columns = [convs, place, *packed, x1, x2, size, upto]
            names = [c.split()[0] for c in STORED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=names)

    return ranged.mapInArrow(spell, STORED)


def _joined(head: Column, own: Column, own_head: Column, shift: Column, base: list[int], first: int) -> Column:
    """A head's fingerprint times that of own turns without their head; one packed pair of residues."""

    def lane(k: int) -> Column:
        pick = lambda c: F.shiftrightunsigned(c, 31) if k % 2 == 0 else c.bitwiseAND(F.lit(PRIME))
        back = pow(base[k], -1, PRIME)
        steps = F.array(*[F.lit(pow(back, s, PRIME)).cast("long") for s in range(LONGEST_HEAD + 1)])
        gap = F.pmod(pick(own) - pick(own_head), F.lit(PRIME).cast("long"))
        return (pick(head) + gap * F.element_at(steps, shift.cast("int") + 1)) % F.lit(PRIME).cast("long")

    return F.shiftleft(lane(first), 31).bitwiseOR(lane(first + 1))


def beginnings(
    stored: DataFrame, base_of: Callable[[Column], Column], head_of: Callable[[Column], Column], base: list[int]
) -> tuple[DataFrame, DataFrame]:
    """All beginnings of all rebuilt conversations by fingerprint, and one row per conversation."""
    turn = F.struct("place", "f1", "f2", "g1", "g2", "x1", "x2", "bytes", "upto")
    heads = F.array_sort(F.collect_list(F.when(F.col("place") <= LONGEST_HEAD, turn)))
    convs = stored.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max("upto").alias("own"), heads.alias("heads"))
    convs = through_table(convs.withColumns({"base": base_of(F.col("conv_id")), "h": head_of(F.col("conv_id"))}), "trie-conversations")
    sources = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("nb"), F.col("heads").alias("source"))
    none = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("place", "f1", "f2", "g1", "g2", "x1", "x2", "bytes", "upto")])
    at = lambda turns, k: F.when(k > 0, F.get(turns, k.cast("int") - 1)).otherwise(none)
    k, over = F.least("h", F.coalesce("nb", F.lit(0))), F.least("h", "n")
    both = convs.join(sources, "base", "left").withColumn("k", k)
    rebuilt = both.select(
        "conv_id", "h", "k", "source", at(F.col("source"), F.col("k")).alias("head"), at(F.col("heads"), over).alias("skip"),
        (F.col("k") + F.col("n") - over).alias("size"),
    ).withColumn("from_own", F.col("size") - F.col("k"))
    rebuilt = rebuilt.join(convs.select("conv_id", F.col("own").alias("own_bytes")), "conv_id")
    total = F.col("head.upto") + F.when(F.col("from_own") > 0, F.col("own_bytes") - F.col("skip.upto")).otherwise(0)
    rebuilt = through_table(rebuilt.withColumn("total", total).drop("own_bytes", "from_own"), "trie-rebuilt")

    zero = [F.lit(0).cast("long").alias(c) for c in ("depth", "f1", "f2", "g1", "g2", "x1", "x2", "bytes", "upto")]
    roots = rebuilt.select("conv_id", "size", *zero)
    taken = rebuilt.select("conv_id", "size", F.explode(F.slice("source", 1, F.col("k").cast("int"))).alias("t"))
    taken = taken.select("conv_id", "size", F.col("t.place").alias("depth"), *[f"t.{c}" for c in ("f1", "f2", "g1", "g2", "x1", "x2", "bytes", "upto")])
    met = stored.join(rebuilt.select("conv_id", "size", "h", "k", "head", "skip"), "conv_id").where(F.col("place") > F.col("h"))
    shift = F.col("h") - F.col("k")
    join = lambda own, which, first: _joined(F.col(f"head.f{which}"), F.col(f"{own}{which}"), F.col(f"skip.f{which}"), shift, base, first)
    rest = met.select(
        "conv_id", "size", (F.col("place") - shift).alias("depth"), join("f", 1, 0).alias("f1"), join("f", 2, 2).alias("f2"),
        join("g", 1, 0).alias("g1"), join("g", 2, 2).alias("g2"), "x1", "x2", "bytes",
        (F.col("upto") - F.col("skip.upto") + F.col("head.upto")).alias("upto"),
    )
    whole = roots.unionByName(taken).unionByName(rest)
    return through_table(whole, "trie-beginnings"), rebuilt.select("conv_id", "size", "total")


def _groups(starts: DataFrame) -> DataFrame:
    """Beginnings of one depth and fingerprint, with the extremes of what must be equal in them."""
    same = ["x1", "x2", "g1", "g2", "bytes", "upto"]
    return starts.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.max("size").alias("deepest"),
        *[f(c).alias(f"{c}_{n}") for c in same for f, n in ((F.min, "low"), (F.max, "high"))],
    )


def _verified(groups: DataFrame) -> bool:
    differ = F.lit(False)
    for c in ("x1", "x2", "g1", "g2", "bytes", "upto"):
        differ = differ | (F.col(f"{c}_low") != F.col(f"{c}_high"))
    return groups.where(differ).isEmpty()


def ends_of(starts: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end in each node, ascending and comma-joined."""
    spark = starts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = starts.where(F.col("depth") == F.col("size")).select(*NODE, "conv_id")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(4)]
            out: list[list] = []
            for d, a, b, conv in zip(*rows):
                last = out[-1] if out else None
                if last is not None and last[:3] == [d, a, b] and last[5] < BLOCK_CHARS:
                    last[4].append(str(conv))
                    last[5] += len(last[4][-1]) + 1
                else:
                    out.append([d, a, b, conv, [str(conv)], 0])
            if out:
                columns = [pa.array([r[k] for r in out], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([",".join(r[4]) for r in out])], names=[*NODE, "least", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def done():
            columns = [pa.array([x], pa.int64()) for x in node]
            return pa.RecordBatch.from_arrays([*columns, pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *one, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if one != node:
                    if node is not None:
                        yield done()
                    node, sha = one, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node is not None:
            yield done()

    layout = "depth long, f1 long, f2 long"
    ordered = ends.repartitionByRange(parts, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = ordered.mapInArrow(blocks, f"{layout}, least long, ids string")
    dealt = joined.repartition(parts, *NODE).sortWithinPartitions(*NODE, "least")
    return dealt.mapInArrow(digest, f"{layout}, ends_sha256 string")


def nodes(
    conversations: DataFrame,
    base_of: Callable[[Column], Column] = lambda c: c - F.pmod(c, F.lit(5)),
    head_of: Callable[[Column], Column] = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9)),
) -> DataFrame:
    """One row per distinct beginning of the rebuilt conversations, with sums over its subtree.

    A conversation is rebuilt from the first ``head_of(id)`` turns (at most ``LONGEST_HEAD``) of the
    conversation ``base_of(id)`` and its own turns after as many.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c)
    turns = conversations.select(
        F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"), text("role"), text("text")
    ).where(F.col("conv_id").isNotNull())
    turns = through_table(turns.mapInArrow(_digests, TURNS), "trie-turns")
    for seed in range(TRIES):
        base = bases(seed)
        stored = through_table(stored_turns(turns, base), "trie-stored")
        starts, convs = beginnings(stored, base_of, head_of, base)
        groups = through_table(_groups(starts), "trie-groups")
        if _verified(groups):
            return _summed(conversations.sparkSession, starts, convs, groups)
    raise RuntimeError("fingerprints of different beginnings met with every base")


def _summed(spark: SparkSession, starts: DataFrame, convs: DataFrame, groups: DataFrame) -> DataFrame:
    leaf = F.count_if(F.col("deepest") == F.col("depth"))
    owned = groups.groupBy(F.col("owner").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("owned"), F.sum("bytes_low").alias("own_bytes"), leaf.alias("leaves")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    shares = convs.join(owned, "conv_id", "left").select(
        "conv_id", "total", zero("own_bytes"), zero("leaves"), (F.col("size") - F.coalesce("owned", F.lit(0))).alias("shared")
    )
    depth, shared = F.col("depth"), F.col("shared")
    owner = depth > shared  # true for one member of each node
    goes_on = F.col("size") > depth
    sums = starts.join(shares, "conv_id").groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.count_if(((shared == depth) | owner) & goes_on).alias("n_children"),
        F.sum("leaves").alias("n_leaves"),
        F.sum("total").alias("totals"),
        F.sum(F.when(owner, F.col("total")).otherwise(F.col("own_bytes"))).alias("distinct_bytes"),
        F.max(F.col("upto") - F.col("bytes")).alias("before"),
        F.max(F.when(owner, shared)).alias("shared"),
        F.max("g1").alias("g1"), F.max("g2").alias("g2"),
    )
    saved = F.col("totals") - F.col("n_convs") * F.col("before") - (F.col("distinct_bytes") - F.col("before"))
    sums = through_table(sums.withColumn("saved_tokens", saved), "trie-sums")
    attached = (F.col("depth") > 0) & (F.col("depth") - 1 == F.col("shared"))
    straight = sums.where(~attached).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    parents = groups.select(
        (F.col("depth") + 1).alias("depth"), F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("owner").alias("parent_conv_id")
    )
    # all that hang on the root have the same parent and need no join
    root = groups.where(F.col("depth") == 0).agg(F.min("owner").alias("r")).first()["r"]
    top = sums.where(attached & (F.col("depth") == 1)).withColumn("parent_conv_id", F.lit(root).cast("long"))
    hung = sums.where(attached & (F.col("depth") > 1)).join(parents.where(F.col("depth") > 1), ["depth", "g1", "g2"])
    whole = straight.unionByName(top).unionByName(hung)
    empty = hashlib.sha256(b"").hexdigest()
    return whole.join(ends_of(starts), NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )
