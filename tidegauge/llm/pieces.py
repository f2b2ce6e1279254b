"""SentencePiece encoding and decoding with byte spans of the original text.

The text is normalised here by longest-prefix replacement through the model's compiled character
map, and every normalised byte keeps the place of the original byte it came from. Ids are those of
the sentencepiece library; the length of each piece then projects it to a span of original bytes.

No piece of the usual vocabularies goes on after a word into the next white-space mark, so a text
is encoded through its distinct words (a mark run and what follows it). A vocabulary with such
pieces, or a model that is not BPE, is encoded text by text; results are the same.

Defined results: a null or empty text has no ids and decodes to the empty text. Equal rows get
equal results. Texts of any length are encoded whole; memory per task is a small multiple of the
longest text. There is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidegauge.llm.common import documents_of, slices, text_bytes
from tidegauge.llm.vocab import WordEncoder, distinct_words, gathered

MARK = "▁"
_MARK_BYTES = np.frombuffer(MARK.encode(), np.uint8)

ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at:at + size], at + size
        yield key >> 3, value


class CharacterMap:
    """A compiled character map: longest key at a place, and what replaces it.

    The map is a double array over bytes. The first four bytes give the array's size; after the
    array come the replacements, each ended by a zero byte.
    """

    def __init__(self, blob: bytes) -> None:
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4:4 + size], np.uint32).tolist()
        self.replacements = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that starts at a byte."""
        if not self.units:
            return None
        best = None
        place = self._child(0, self.units[0])
        for k in range(at, len(data)):
            place ^= data[k]
            if place >= len(self.units):
                break
            unit = self.units[place]
            if unit & 0x800000FF != data[k]:
                break
            place = self._child(place, unit)
            if unit >> 8 & 1:
                best = (self.units[place] & 0x7FFFFFFF, k + 1 - at)
        if best is None:
            return None
        start = best[0]
        return self.replacements[start:self.replacements.index(b"\0", start)], best[1]

    @staticmethod
    def _child(place: int, unit: int) -> int:
        return place ^ ((unit >> 10) << ((unit & 512) >> 6))


class Normalizer:
    """A model's normalisation, with the original place of every normalised byte."""

    def __init__(self, model: bytes) -> None:
        spec: dict[int, int | bytes] = {}
        for number, value in _fields(model):
            if number == 3:
                spec = dict(_fields(value))
        self.map = CharacterMap(bytes(spec.get(2, b"")))
        self.dummy_prefix = bool(spec.get(3, 1))
        self.trim = bool(spec.get(4, 1))
        self.escape = bool(spec.get(5, 1))
        self.plain = not self.map.units and not self.trim and self.escape and self.dummy_prefix

    def normalise(self, text: str) -> tuple[bytes, list[int]]:
        """Normalised bytes, and the original byte of each plus the end."""
        data = text.encode()
        out, places = bytearray(), []
        space = MARK.encode() if self.escape else b" "

        def put(piece: bytes, place: int) -> None:
            out.extend(piece)
            places.extend([place] * len(piece))

        parts: list[tuple[bytes, int, int]] = []
        at = 0
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:
                width = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                found = data[at:at + width], width
            parts.append((found[0], at, found[1]))
            at += found[1]
        if self.trim:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
        if not parts:
            return b"", [len(data)]
        if self.dummy_prefix:
            put(space, parts[0][1])
        after_space = self.trim
        for piece, place, width in parts:
            while after_space and piece.startswith(b" "):
                piece = piece[1:]
            one_to_one = len(piece) == width
            for k in range(len(piece)):
                byte = piece[k:k + 1]
                put(space if byte == b" " else byte, place + k if one_to_one else place)
            if piece:
                after_space = self.trim and piece.endswith(b" ")
        end = len(data)
        if self.trim:
            while out.endswith(space):
                end = places[-len(space)]
                del out[-len(space):], places[-len(space):]
        return bytes(out), [*places, end]

    def normalise_all(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Normalised bytes of all texts, their n + 1 offsets, and each byte's place in its text.

        For a map without entries: spaces become marks and a mark is put before each text.
        """
        spaces = data == 32
        width = np.where(spaces, 3, 1)
        filled = offsets[:-1] < offsets[1:]
        sizes = np.diff(np.concatenate([[0], np.cumsum(width)])[offsets]) + 3 * filled
        new = np.concatenate([[0], np.cumsum(sizes)])
        shift = np.repeat(new[:-1] + 3 * filled - offsets[:-1], np.diff(offsets))
        extra = np.concatenate([[0], np.cumsum(2 * spaces)])
        at = np.arange(len(data)) + shift + extra[:-1] - np.repeat(extra[offsets[:-1]], np.diff(offsets))
        out = np.empty(new[-1], np.uint8)
        places = np.zeros(new[-1], np.int64)
        local = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
        out[at], places[at] = data, local
        heads = np.concatenate([at[spaces], new[:-1][filled]])
        for k in range(3):
            out[heads + k] = _MARK_BYTES[k]
        for k in (1, 2):
            places[at[spaces] + k] = local[spaces]
        return out, new, places


class PieceEncoder:
    """Ids and original byte spans of texts under one model file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as file:
            model = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalizer = Normalizer(model)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(k) for k in range(n)]
        self.widths = np.array(
            [1 if self.library.is_byte(k) else len(name.encode()) for k, name in enumerate(names)], np.int64
        )
        kinds = [value for number, value in _fields(model) if number == 2]
        trainer = dict(_fields(kinds[0])) if kinds else {}
        joins = any(MARK in name.lstrip(MARK) for name in names)
        special = any(self.library.is_unused(k) for k in range(n))
        self.by_word = (
            self.normalizer.plain and trainer.get(3, 1) == 2 and bool(trainer.get(35, 0)) and not joins and not special
        )
        self.mark_id = self.library.piece_to_id(MARK)
        self.words = WordEncoder(self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word begins with a mark, which the library puts there again by itself."""
        plain = [w[1:].replace(MARK, " ") for w in words]
        ids = [one if text else [self.mark_id] for one, text in zip(self.library.encode(plain, num_threads=1), plain)]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum())), counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the n + 1 offsets of the texts in them, and each id's span of bytes."""
        if not self.by_word:
            return self._encode_whole(texts)
        data, offsets = text_bytes(texts)
        normal, new, places = self.normalizer.normalise_all(data, offsets)
        if len(normal) == 0:
            none = np.zeros(0, np.int64)
            return none.astype(np.int32), np.zeros(len(texts) + 1, np.int64), none, none
        marks = np.zeros(len(normal) + 3, bool)
        marks[:-5] = (normal[:-2] == _MARK_BYTES[0]) & (normal[1:-1] == _MARK_BYTES[1]) & (normal[2:] == _MARK_BYTES[2])
        starts = marks[:-3].copy()
        starts[3:] &= ~marks[:-6]
        starts[new[:-1][new[:-1] < new[1:]]] = True
        cuts = np.append(np.flatnonzero(starts), len(normal))
        words, codes = distinct_words(normal, cuts)
        ids, id_offsets = gathered(*self.words.table(words), codes)
        text_offsets = id_offsets[np.searchsorted(cuts[:-1], new)]
        ends = np.cumsum(self.widths[ids])
        begins = ends - self.widths[ids]
        sizes = np.repeat(np.diff(offsets), np.diff(text_offsets))
        last = np.repeat(new[1:], np.diff(text_offsets))
        after = np.append(places, 0)[np.minimum(ends, len(normal))]
        return ids, text_offsets, places[begins], np.where(ends == last, sizes, after)

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, offsets, begins, ends = [], [0], [], []
        for text in texts.to_pylist():
            own = self.library.encode(text)
            normal, places = self.normalizer.normalise(text)
            at = 0
            for k in own:
                width = len(normal) - at if k == self.library.unk_id() and k == own[-1] else int(self.widths[k])
                if k == self.library.unk_id() and k != own[-1]:
                    width = self._unknown_width(normal, at, own[len(begins) - offsets[-1] + 1])
                begins.append(places[at])
                at = min(at + width, len(normal))
                ends.append(places[at])
            ids.extend(own)
            offsets.append(len(ids))
        as_long = np.array(begins, np.int64), np.array(ends, np.int64)
        return np.array(ids, np.int32), np.array(offsets, np.int64), *as_long

    def _unknown_width(self, normal: bytes, at: int, following: int) -> int:
        """An unknown piece goes as far as the next place where the following piece stands."""
        stop = normal.find(self.library.id_to_piece(following).encode(), at + 1)
        return (stop if stop > 0 else len(normal)) - at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The library's decoded text of each text's ids."""
        flat = ids.tolist()
        return [self.library.decode(flat[a:b]) if b > a else "" for a, b in zip(offsets[:-1], offsets[1:])]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """One encoder per model file and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode(docs: DataFrame, model: str, decode: bool = False) -> DataFrame:
    """``(doc_id, ids, starts, ends[, decoded])`` per document; spans are in bytes of its text.

    ``model`` is the path of a model file that every worker can read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model)
        for batch in batches:
            for part in slices(batch):
                ids, offsets, starts, ends = tool.encode(part.column(1))
                where = pa.array(offsets.astype(np.int32))
                columns = [part.column(0)] + [
                    pa.ListArray.from_arrays(where, pa.array(x.astype(np.int32))) for x in (ids, starts, ends)
                ]
                names = ["doc_id", "ids", "starts", "ends"]
                if decode:
                    columns.append(pa.array(tool.decode(ids, offsets), pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return documents_of(docs).mapInArrow(run, ENCODED + (", decoded string" if decode else ""))
