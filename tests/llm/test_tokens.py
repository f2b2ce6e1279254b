import random
import zlib
from collections import defaultdict

import pytest

from tidegauge.llm import packing, pieces

vocabularies = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")


def test_encoding_equals_the_library(odd_docs, no_docs):
    path = vocabularies.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = pieces.encode(odd_docs, path, decode=True).collect()
    texts = sorted((r.doc_id, r.text or "") for r in odd_docs.where("doc_id is not null and doc_id != 7").collect())
    found = sorted((r.doc_id, list(r.ids), r.decoded) for r in rows if r.doc_id not in (None, 7))
    assert found == [(i, library.encode(t), library.decode(library.encode(t))) for i, t in texts]
    assert len(rows) == odd_docs.count()
    assert pieces.encode(no_docs, path).count() == 0


def test_spans_are_those_of_the_library(odd_rows):
    import pyarrow as pa

    path = vocabularies.path("piece_bpe_32k.model")
    tool, library = pieces.PieceEncoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for _, t in odd_rows]
    for by_word in (True, False):
        tool.by_word = by_word
        ids, offsets, starts, ends = tool.encode(pa.array(texts))
        for k, text in enumerate(texts):
            own = slice(offsets[k], offsets[k + 1])
            assert ids[own].tolist() == library.encode(text)
            spans = [(int(a), int(b)) for a, b in zip(starts[own], ends[own])]
            data = text.encode()
            assert all(0 <= a <= b <= len(data) for a, b in spans)
            assert [b for _, b in spans[:-1]] == [a for a, _ in spans[1:]]
            if spans:
                assert spans[0][0] == 0 and spans[-1][1] == len(data)
            for one, (a, b) in zip(ids[own].tolist(), spans):
                if not library.is_byte(one):
                    piece = library.id_to_piece(one).replace("▁", " ")
                    assert data[a:b].decode().replace("▁", " ") in (piece, piece[1:])


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc_cf"])
def test_compiled_map_normalises_as_the_library(odd_rows, rule):
    if not hasattr(sentencepiece, "SentencePieceNormalizer"):
        pytest.skip("no normaliser in this library")
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normalizer(library.serialized_model_proto())
    own.dummy_prefix, own.escape = False, False
    for _, text in odd_rows:
        normal, places = own.normalise(text or "")
        library_text = library.normalize(text or "")
        if not own.trim:
            assert normal.decode() == library_text
        assert len(places) == len(normal) + 1 and places == sorted(places)


def test_pieces_and_sequences(odd_docs, no_docs):
    path = vocabularies.path("word_bpe_49k.json")
    tool = tokenizers.Tokenizer.from_file(path)
    rows = packing.pack(packing.cut_documents(odd_docs, path), task_items=7, nearly_full=3).collect()
    expected = []
    for r in odd_docs.collect():
        ids = tool.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            part = b"".join(i.to_bytes(4, "little") for i in ids[k:k + 2048])
            expected.append((r.doc_id, k // 2048, k, len(part) // 4, zlib.crc32(part)))
    found = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(sequences) <= -(-total // 2048) + 2
    assert packing.pack(packing.cut_documents(no_docs, path)).count() == 0


def test_split_words_have_the_library_s_ids(spark, monkeypatch):
    path = vocabularies.path("word_bpe_49k.json")
    tool = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(11)
    signs = [*"abcXYZ019.,-_()/<>|'\"\u00e9\u00c9\u00d7\u00f7\u00ff\u0130\u0301\u03a3\u0435\u4e2d\x01\x1f\x7f\xa0\u2028", "'s", "'LL", "I\u0307", "e\u0301",
             "<|endoftext|>", "<|ENDOFTEXT|>", " ", "\n", "ing", "The"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(3000)]
    texts.append("Some words, 12.5 of them (\u00e9t\u00c9). " * 60_000)
    monkeypatch.setattr(packing, "CAPACITY", 1 << 30)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = sorted((r.doc_id, r.length, r.ids_crc32) for r in packing.cut_documents(docs, path, 1 << 30).collect())
    expected = []
    for k, text in enumerate(texts):
        ids = tool.encode(text, add_special_tokens=False).ids + [0]
        expected.append((k, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
    assert found == expected


def test_small_bins_of_far_tasks_meet(spark):
    # every task is left with one small bin, and only one task has bins with room for them
    sizes = [1500] * 30 + [2047] * 3000
    rows = [(k, 0, 0, size, 0) for k, size in enumerate(sizes)] + [(9000 + k, 0, 0, 40, 0) for k in range(60)]
    pieces_ = spark.createDataFrame(rows, packing.PIECES)
    packed = packing.pack(pieces_, task_items=50)
    assert packed.count() == len(rows)
    assert packed.select("sequence_id").distinct().count() == 3030


def test_best_fit_takes_the_tightest_bin():
    assert packing.best_fit([5, 6, 4, 5], 10) == [[1, 2], [0, 3]]
    bins = packing.best_fit([1100] * 5 + [948] * 5, 2048)
    assert len(bins) == 5


def test_query_digests_the_spans_of_all_pieces(spark):
    import hashlib
    import os

    from tidegauge.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    library = sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))
    found = {r.doc_id: r for r in QUERIES["op9_sentencepiece"](spark, folder).collect()}
    checked = 0
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        text, ends, at = row.text or "", [], 0
        pieces_ = library.encode(text, return_type="proto").pieces
        if any(library.is_byte(p.id) for p in pieces_):
            continue
        for piece in pieces_:
            at += len(piece.surface.encode())
            ends.append(at)
        assert found[row.doc_id].ends_sha256 == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        checked += 1
    assert checked > 20
