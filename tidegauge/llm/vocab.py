"""Encoding a batch of texts through its distinct words, with a bounded cache per worker."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa

# Words kept per Python worker, and the longest word worth keeping.
CACHE_WORDS = 300_000
CACHE_WORD_BYTES = 64


class WordEncoder:
    """Ids of words by a given encoder of lists; frequent words, which come early, stay cached.

    The encoder returns the ids of all words one after the other and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.known: dict[bytes, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.filled = 0
        self.first = np.zeros(CACHE_WORDS, np.int64)
        self.counts = np.zeros(CACHE_WORDS, np.int64)

    def table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it those of each given word begin and how many they are."""
        raw = words.to_pylist()
        found = np.fromiter(map(self.known.get, raw, repeat(-1)), np.int64, len(raw))
        first, counts = self.first[found], self.counts[found]
        missing = np.flatnonzero(found < 0)
        if not len(missing):
            return self.pool, first, counts
        ids, sizes = self.encode([raw[k].decode() for k in missing.tolist()])
        places = np.cumsum(sizes) - sizes
        keep = [k for k, m in enumerate(missing.tolist()) if len(raw[m]) <= CACHE_WORD_BYTES][:CACHE_WORDS - len(self.known)]
        if keep:
            new, at = np.array(keep), len(self.known)
            kept = ids[np.arange(sizes[new].sum()) + np.repeat(places[new] - (np.cumsum(sizes[new]) - sizes[new]), sizes[new])]
            while self.filled + len(kept) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.int32)])
            self.pool[self.filled:self.filled + len(kept)] = kept
            span = slice(at, at + len(keep))
            self.first[span] = self.filled + np.cumsum(sizes[new]) - sizes[new]
            self.counts[span] = sizes[new]
            self.filled += len(kept)
            self.known.update(zip([raw[m] for m in missing[new].tolist()], range(at, at + len(keep))))
        first[missing], counts[missing] = self.filled + places, sizes
        return np.concatenate([self.pool[:self.filled], ids.astype(np.int32)]), first, counts


def distinct_words(data: np.ndarray, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct pieces of the bytes between neighbouring cuts, and the number of each piece."""
    pieces = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data)]
    )
    coded = pieces.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def gathered(
    ids: np.ndarray, first: np.ndarray, counts: np.ndarray, codes: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the coded words one after the other, and the n + 1 offsets of the words in them."""
    offsets = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(counts[codes], out=offsets[1:])
    place = np.arange(offsets[-1]) + np.repeat(first[codes] - offsets[:-1], counts[codes])
    return ids[place], offsets
