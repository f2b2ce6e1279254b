"""Best-fit packing of tokenised documents into sequences of bounded length, by rounds over residual bins.

Documents are tokenised once, whole, and only the lengths of their pieces go on. In the first
round every task packs a bounded number of pieces best-fit decreasing. Of its bins the one that is at most
half full, and the roomiest others that could take such bins in, become items of the next round,
in which the bins of ``FAN_IN`` tasks meet in one; all others are done. Rounds go on until one task is left.

Defined results: a null or empty text is a document with the end id alone; repeated rows are
documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import documents_of, slices, text_bytes, word_spans
from tidegauge.llm.vocab import WordEncoder, distinct_words, gathered
from tidegauge.session import through_table

CAPACITY = 2048
END_ID = 0
# Items in one task of a round, tasks whose bins meet in one task of the next, and the room left
# in a bin that counts as nearly full.
TASK_ITEMS = 20_000
FAN_IN = 8
NEARLY_FULL = 8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = f"size long, done boolean, task int, members array<struct<{PIECES.replace(' long', ':long').replace(' int', ':int')}>>"

_ENCODERS: dict[str, WordEncoder] = {}


def _word_encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tool = Tokenizer.from_file(path)

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            one = tool.encode(words, is_pretokenized=True, add_special_tokens=False)
            return np.array(one.ids, np.int32), np.bincount(np.array(one.word_ids, np.int64), minlength=len(words))

        _ENCODERS[path] = WordEncoder(encode)
    return _ENCODERS[path]


# Kinds of bytes in a word: what is not a letter, digit or other ASCII sign keeps its word whole.
_LETTER, _DIGIT, _OTHER, _WHOLE = 1, 2, 3, 4
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[ord("'"), ord("|")]] = _WHOLE  # contractions, special tokens
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Second bytes of the letters from U+00C0 to U+00FF, which follow the byte C3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False


def split_words(letters: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with A-Z lower-cased, and the starts of their pieces with the end of the last.

    The tokenizer lower-cases, and takes runs of letters, single digits and runs of other signs
    apart; a word of these signs alone can be cut there beforehand without changing its ids.
    """
    if not len(letters):
        return letters, cuts
    kind = _KIND[letters]
    pairs = np.flatnonzero((letters[:-1] == 0xC3) & _LATIN[letters[1:]])
    kind[pairs] = kind[pairs + 1] = _LETTER
    whole = np.logical_or.reduceat(kind == _WHOLE, cuts[:-1])
    free = np.repeat(~whole, np.diff(cuts))
    begins = np.zeros(len(letters) + 1, bool)
    begins[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)) & free[1:] & free[:-1]
    begins[cuts] = True
    return np.where(free, _LOWER[letters], letters), np.flatnonzero(begins)


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut every ``capacity`` ids.

    The tokenizer must drop white space and take words apart as :func:`split_words` says (the
    given one does). ``tokenizer`` is a path that every worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _word_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch):
                data, offsets = text_bytes(part.column(1))
                starts, ends, words_at = word_spans(data, offsets)
                inside = np.zeros(len(data) + 1, np.int8)
                inside[starts] += 1
                inside[ends] -= 1
                letters = np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8) > 0])
                cuts = np.concatenate([[0], np.cumsum(ends - starts)])
                letters, begins = split_words(letters, cuts)
                words, codes = distinct_words(letters, begins)
                pieces_at = np.searchsorted(begins, cuts)[words_at]
                ids, first, counts = tool.table(words)
                ids, first, counts = np.append(ids, np.int32(END_ID)), np.append(first, len(ids)), np.append(counts, 1)
                codes = np.insert(codes, pieces_at[1:], len(counts) - 1)
                flat, piece_offsets = gathered(ids, first, counts, codes)
                bounds = piece_offsets[pieces_at + np.arange(len(pieces_at))]
                flat = flat.astype("<u4")
                rows: list[tuple[int, int, int, int]] = []
                for k in range(part.num_rows):
                    for n, at in enumerate(range(int(bounds[k]), int(bounds[k + 1]), capacity)):
                        stop = min(at + capacity, int(bounds[k + 1]))
                        rows.append((k, n, stop - at, zlib.crc32(flat[at:stop].tobytes())))
                owner, piece, length, crc = (pa.array(list(c)) for c in zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(owner), piece.cast(pa.int32()),
                        pc.multiply(piece, capacity), length, crc,
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return documents_of(docs).mapInArrow(run, PIECES)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the places of the items in each bin."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist()
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r is set if a bin has room r
    for item in order:
        size = sizes[item]
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            place = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[place].append(item)
        else:
            room, place = capacity, len(bins)
            bins.append([item])
        room -= size
        if room:
            by_room[room].append(place)
            open_rooms |= 1 << room
    return bins


def _round(frame: DataFrame, capacity: int, nearly_full: int) -> DataFrame:
    """One round over the frame's tasks: their bins, done or not.

    After best-fit at most one bin of a task is no more than half full, and bins that are more can
    only take in such ones. So that bin stays open, and with it as many of the
    roomiest others as there are tasks that meet in the next round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if table.num_rows == 0:
            return
        table = table.combine_chunks()
        sizes, members = table.column("size").to_pylist(), table.column("members").combine_chunks()
        bins = best_fit(sizes, capacity)
        order = pa.array([k for one in bins for k in one])
        moved = members.take(order)
        counts = pc.list_value_length(moved).to_numpy(zero_copy_only=False)
        upto = np.concatenate([[0], np.cumsum(counts)])
        cuts = upto[np.concatenate([[0], np.cumsum([len(one) for one in bins])])]
        filled = np.array([sum(sizes[k] for k in one) for one in bins])
        done = np.ones(len(bins), bool)
        done[np.argsort(filled, kind="stable")[:FAN_IN + 1]] = False
        done |= capacity - filled <= nearly_full
        done &= filled > capacity // 2
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(filled, pa.int64()), pa.array(done),
                pa.array(np.full(len(bins), TaskContext.get().partitionId(), np.int32)),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), moved.flatten()),
            ],
            names=["size", "done", "task", "members"],
        )
        for start in range(0, out.num_rows, 1000):
            yield out.slice(start, 1000)

    return frame.select("size", "members").mapInArrow(run, BINS)


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, task_items: int = TASK_ITEMS, nearly_full: int = NEARLY_FULL
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: gapless from 0 in sequences of at most ``capacity``.

    Pieces are read once and each round's bins are kept as a table, so a lost executor costs the
    round at hand only.
    """
    pieces = through_table(pieces, "packing-pieces")
    item = F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members")
    items = pieces.select(F.col("length").alias("size"), item)
    full = items.where(F.col("size") == capacity)
    items = items.where(F.col("size") < capacity)
    finished = [full.select("members")]
    parts = math.ceil(items.count() / task_items)
    items = items.repartition(max(1, parts))
    while parts:
        bins = through_table(_round(items, capacity, nearly_full), "packing-bins")
        if parts == 1:
            finished.append(bins.select("members"))
            break
        finished.append(bins.where("done").select("members"))
        parts = math.ceil(parts / FAN_IN)
        meet = F.floor(F.col("task") / FAN_IN).cast("int")
        items = bins.where(~F.col("done")).repartitionById(parts, meet)
    whole = finished[0]
    for more in finished[1:]:
        whole = whole.unionAll(more)
    numbered = whole.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    placed = F.transform(
        "members",
        lambda m, k: F.struct(
            m.alias("m"),
            F.aggregate(F.slice("members", 1, k), F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("offset"),
        ),
    )
    return numbered.select("sequence_id", F.explode(placed).alias("p")).select(
        "p.m.doc_id", "p.m.piece", "p.m.start", "p.m.length", "p.m.ids_crc32", "sequence_id", "p.offset"
    )
