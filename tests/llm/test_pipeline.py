import random
import re
from collections import defaultdict

import pytest

import corpus_pipeline
from conftest import words
from test_jaccard import brute as classes
from test_secrets import brute_base
from test_substrings import _ORDER, brute_chunks
from tidegauge.llm import gear_chunks

pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


def plain_good(text):
    """The quality rules written out for one text."""
    from tidegauge.llm import quality_rules as q

    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = defaultdict(list)
    for k in range(len(w) - 7):
        windows[tuple(w[k:k + 8])].append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    n, chars = len(w), sum(map(len, w))
    if n < 20 or 100 * len(covered) > 30 * n:
        return False
    ratios = {
        "mean_word_chars": chars / n, "symbols_per_char": sum(text.count(c) for c in q.SYMBOLS) / chars,
        "shouts_per_word": text.count("!") / n, "capitals_per_char": sum(c.isupper() for c in text) / chars,
        "stop_words_per_word": sum(x in q.STOP_FORMS for x in w) / n,
        "dup_lines_per_line": (len(lines) - len(set(lines))) / len(lines),
    }
    return all(r.low <= ratios[r.ratio] <= r.high for r in q.RULES if n >= r.from_words)


@pytest.fixture(scope="module")
def docs(spark, odd_rows):
    rng = random.Random(31)
    passage, base = words(rng, 60), words(rng, 120)
    texts = [words(rng, rng.randint(10, 120)) for _ in range(60)]
    texts += [f"{words(rng, 50)} {passage} {words(rng, 40)}" for _ in range(6)]
    texts += [base, base, base.replace(" ", "  ", 1), base + " more words at the end", "LOUD WORDS!! " * 30]
    texts += [f"{words(rng, 40)} token = \"{'%040x' % rng.getrandbits(160)}\" {words(rng, 30)}" for _ in range(5)]
    rows = [(300 + k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(i, t, "xx", None, None) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)


def test_every_stage_against_its_plain_form(spark, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "jaccard_join", "substring_dedup", "secret_scan", "best_fit_packing"]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(stage(spark, frames[-1], "").cache())
    rows = [sorted(((r.doc_id, r.text) for r in f.collect()), key=repr) for f in frames[:5]]
    assert all(f.columns == docs.columns for f in frames[:5])

    assert rows[1] == [r for r in rows[0] if plain_good(r[1])]
    kept = defaultdict(int)
    for _, class_id, _ in classes(rows[1]):
        kept[class_id] += 1
    assert sorted(i for i, _ in rows[2]) == sorted(kept) and set(rows[2]) <= set(rows[1])
    for r in gear_chunks._document_key(gear_chunks.documents_of(frames[2])).collect():
        _ORDER[r.doc_id, r.text] = r.dk
    assert rows[3] == sorted(((r[0], r[4]) for r in brute_chunks(rows[2])), key=repr)
    before = dict(rows[3])
    for i, text in rows[4]:
        assert not brute_base(text)
        pieces = text.split("[secret]")
        at = 0
        for piece in pieces:
            at = before[i].index(piece, at) + len(piece)
    tool = tokenizers.Tokenizer.from_file(corpus_pipeline.vocabulary("word_bpe_49k.json"))
    packed = frames[5].collect()
    totals, sequences = defaultdict(int), defaultdict(int)
    for r in packed:
        totals[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert totals == {i: len(tool.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows[4]}
    assert max(sequences.values()) <= 2048


def test_run_over_the_table_and_an_empty_one(spark, tmp_path):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
