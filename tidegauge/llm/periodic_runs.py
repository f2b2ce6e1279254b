"""Periodic runs of words: suffix trees of a word sequence and its reversal, and longest common extensions by lowest common ancestors.

A run is a maximal stretch of words with a smallest period q, at least ``LEAST_WORDS`` words and
``LEAST_TURNS`` periods long. Every run has a Lyndon root, for the order of the words or for the reversed order:
the longest Lyndon word at some place of it is one period long. So candidates are the longest Lyndon words at
all places, for both orders, found from the order of the suffixes, which is the order of the leaves of the
suffix tree. Each is extended to the right by the longest common extension of two suffixes and to the left by
that of two prefixes. Both are depths of lowest common ancestors, read in constant time from the Euler tours of
the trees of the sequence and of its reversal, which Ukkonen's algorithm builds.

A run repeats each of its strings of ``_GRAM`` words at distance q, so only stretches of
such strings that occur twice in the document can hold one; the trees are built of these stretches, one by one.
Choosing them by hashes can only add stretches. A tree takes some 1 kB a word, for the longest
repetitive stretch of one document at a time.

Defined results: a null or empty text has no words and no runs; repeated rows get equal results; texts are
taken whole, one at a time; an empty table gives no rows; there is no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.common import documents_of, pair, slices, text_bytes, word_hashes, word_spans

LEAST_WORDS = 24
LEAST_TURNS = 3
# Words in the strings that must occur twice: a run of LEAST_WORDS words has at least 2 q + _GRAM - 1 words.
_GRAM = 8

Run = tuple[int, int, int]

MEASURED = (
    "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string, runs array<struct<start:long,length:long,period:long>>"
)


class SuffixTree:
    """Ukkonen's tree of a sequence of whole numbers from 1 on, closed by 0, with the Euler tour of its nodes."""

    def __init__(self, word: list[int]) -> None:
        self.word = [*word, 0]
        self._build()
        self._tour()

    def _build(self) -> None:
        word, n = self.word, len(self.word)
        width = max(word) + 1
        # the root is node 0; an edge is named by its upper node and first symbol
        first, last, link = [0], [0], [0]
        child: dict[int, int] = {}
        node = edge = length = pending = 0
        for i, symbol in enumerate(word):
            pending += 1
            waiting = -1
            while pending:
                if not length:
                    edge = i
                at = node * width + word[edge]
                below = child.get(at)
                if below is None:
                    child[at] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if waiting >= 0:
                        link[waiting] = node
                        waiting = -1
                else:
                    span = min(last[below], i + 1) - first[below]
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if word[first[below] + length] == symbol:
                        if waiting >= 0 and node:
                            link[waiting] = node
                        length += 1
                        break
                    split = len(first)
                    first.append(first[below])
                    last.append(first[below] + length)
                    link.append(0)
                    child[at] = split
                    child[split * width + symbol] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    first[below] += length
                    child[split * width + word[first[below]]] = below
                    if waiting >= 0:
                        link[waiting] = split
                    waiting = split
                pending -= 1
                if not node and length:
                    length -= 1
                    edge = i - pending + 1
                elif node:
                    node = link[node]
        self.first, self.last = np.array(first), np.array(last)
        keys = np.fromiter(child, np.int64, len(child))
        self.lower = np.fromiter(child.values(), np.int64, len(child))
        self.upper, self.symbol = keys // width, keys % width

    def _children(self, descending: bool) -> tuple[np.ndarray, list[int]]:
        """Children by node in the order of their symbols, and where those of each node begin; 0 is always the least."""
        rank = np.where(self.symbol == 0, -1, -self.symbol if descending else self.symbol)
        if descending:
            rank = np.where(self.symbol == 0, -int(self.symbol.max()) - 1, rank)
        order = np.lexsort((rank, self.upper))
        return self.lower[order], np.searchsorted(self.upper[order], np.arange(len(self.first) + 1)).tolist()

    def _tour(self) -> None:
        """Depths of the nodes in the order in which a walk around the tree meets them, with a table of least ones."""
        lower, begins = self._children(False)
        children, n = lower.tolist(), len(self.word)
        size = (self.last - self.first).tolist()
        depths: list[int] = []
        place = [0] * n
        self.leaves: list[int] = []
        stack, depth_of = [0], [0] * len(size)
        nexts = begins[:-1]
        nexts = list(nexts)
        while stack:
            node = stack[-1]
            k = nexts[node]
            depth = depth_of[node]
            if begins[node] == begins[node + 1]:
                start = n - depth
                place[start] = len(depths)
                self.leaves.append(start)
                stack.pop()
            elif k < begins[node + 1]:
                nexts[node] = k + 1
                below = children[k]
                depth_of[below] = depth + size[below]
                stack.append(below)
            else:
                stack.pop()
                continue
            depths.append(depth)
        self.depth_of = depth_of
        self.place = np.array(place)
        self.table = [np.array(depths, np.int32)]
        step = 1
        while 2 * step <= len(depths):
            above = self.table[-1]
            self.table.append(np.minimum(above[:-step], above[step:]))
            step *= 2

    def suffixes(self, descending: bool = False) -> list[int]:
        """Starts of all suffixes in the order of the symbols or of the reversed symbols; an end comes before any symbol."""
        if not descending:
            return self.leaves
        lower, begins = self._children(True)
        children, out, stack, n = lower.tolist(), [], [0], len(self.word)
        while stack:
            node = stack.pop()
            if begins[node] == begins[node + 1]:
                out.append(n - self.depth_of[node])
            else:
                stack += children[begins[node]:begins[node + 1]][::-1]
        return out

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning of the suffixes that start at a and at b, a and b being different."""
        x, y = self.place[a], self.place[b]
        low, high = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            one = level == k
            out[one] = np.minimum(self.table[k][low[one]], self.table[k][high[one] - (1 << k)])
        return out


def lyndon_lengths(order: list[int]) -> np.ndarray:
    """Length of the longest Lyndon word at each place, from the order of the suffixes: up to the next smaller suffix."""
    n = len(order)
    rank = [0] * n
    for k, start in enumerate(order):
        rank[start] = k
    out, stack = [0] * n, []
    for i in range(n - 1, -1, -1):
        while stack and rank[stack[-1]] > rank[i]:
            stack.pop()
        out[i] = (stack[-1] if stack else n) - i
        stack.append(i)
    return np.array(out)


def runs_of(word: list[int], least: int = LEAST_WORDS, turns: int = LEAST_TURNS) -> list[Run]:
    """``(start, length, period)`` of all runs of a sequence of whole numbers from 1 on, by start and then period."""
    n = len(word)
    if n < max(least, 2):
        return []
    ahead, behind = SuffixTree(word), SuffixTree(word[::-1])
    found: set[Run] = set()
    for descending in (False, True):
        root = lyndon_lengths(ahead.suffixes(descending))[:n]
        start = np.arange(n)
        fits = start + root < n
        start, root = start[fits], root[fits]
        right = ahead.extension(start, start + root)
        left = np.zeros(len(start), np.int64)
        inner = start > 0
        left[inner] = behind.extension(n - start[inner], n - start[inner] - root[inner])
        length = left + root + right
        long = length >= np.maximum(least, turns * root)
        found.update(zip((start - left)[long].tolist(), length[long].tolist(), root[long].tolist()))
    return sorted(found, key=lambda r: (r[0], r[2]))


def repetitive_stretches(hashes: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """``(text, first word, end)`` of the stretches whose strings of ``_GRAM`` words all occur twice in their text."""
    counts = np.diff(offsets)
    grams = hashes.copy()
    step = 1
    while step < _GRAM:
        grams[:-step] = pair(grams[:-step], grams[step:])
        step *= 2
    owner = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    own = pair(grams, owner)
    usable = np.arange(len(hashes)) <= np.repeat(offsets[1:] - _GRAM, counts)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = np.zeros(len(own) + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    twice = np.zeros(len(own), bool)
    twice[order] = same[1:] | same[:-1]
    twice &= usable
    edges = np.flatnonzero(np.diff(np.concatenate([[False], twice, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        # no string crosses texts, so neither does a stretch of more than one
        if b - a + _GRAM - 1 >= LEAST_WORDS:
            text = int(owner[a])
            out.append((text, a - int(offsets[text]), b + _GRAM - 1 - int(offsets[text])))
    return out


def find_runs(words: list[bytes], stretches: list[tuple[int, int]]) -> list[Run]:
    """Runs of a document, from its repetitive stretches."""
    runs: list[Run] = []
    for first, end in stretches:
        number: dict[bytes, int] = {}
        coded = [number.setdefault(w, len(number) + 1) for w in words[first:end]]
        runs += [(first + start, length, period) for start, length, period in runs_of(coded)]
    return sorted(set(runs), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those after the first period of a run."""
    if not runs:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        cover[start + period] += 1
        cover[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes] | None:
    """The document's words with a period from some place on, if its number asks for it."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10 or not words:
        return None
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    whole, rest = divmod(n - a, p)
    return words[:a] + words[a:a + p] * whole + words[a:a + rest]


def _measured(part: pa.RecordBatch, edit) -> pa.RecordBatch:
    ids = part.column(0).to_pylist()
    raw = [t.as_py() for t in part.column(1).cast(pa.large_binary())]
    words: list[list[bytes] | None] = [None] * len(raw)
    for k, one in enumerate(raw):
        if edit is not None and (new := edit(ids[k], one.split())) is not None:
            words[k], raw[k] = new, b" ".join(new)
    data, offsets = text_bytes(pa.array(raw, pa.large_binary()))
    starts, ends, words_at = word_spans(data, offsets)
    stretches: dict[int, list[tuple[int, int]]] = {}
    for text, first, end in repetitive_stretches(word_hashes(data, starts, ends), words_at):
        stretches.setdefault(text, []).append((first, end))
    rows = []
    for k, one in enumerate(raw):
        own = words[k] if words[k] is not None else one.split()
        runs = find_runs(own, stretches[k]) if k in stretches else []
        text = b" ".join(collapsed(own, runs))
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        listed = "".join("%d,%d,%d\n" % r for r in runs)
        rows.append(
            (
                ids[k], len(own), len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode(),
                [dict(zip(("start", "length", "period"), r)) for r in runs],
            )
        )
    names = [c.split()[0] for c in MEASURED.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string(), pa.large_string(),
             pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names=names)


def measure(docs: DataFrame, edit=None) -> DataFrame:
    """Runs of every document, the one of the greatest exponent, and the text without repeated periods.

    ``edit`` may replace a document's words: it takes the id and the words and returns new words or None.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield _measured(part, edit)

    return documents_of(docs).mapInArrow(run, MEASURED)
