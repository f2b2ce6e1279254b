import random

import pytest

# Rows with nulls, empty and white-space texts, repeated rows, ties, long and unusual texts.
ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "  two  spaces ", "line\r\nline\n\nline", "ünïcödé ñandú ▁mark  nbsp",
    "emoji \U0001f600\U0001f680 and ́ mark", "AKIA" * 10, "x" * 5000, "tab\tand\x0bother\x0cspaces",
    "<|endoftext|> and <s> </s> <unk>", "Å ẛ̣ ﬁ ǅ", "don't we'll I'd 12,345 a.b,c",
]
SYLLABLES = ["the", "of", "an", "er", "tion", "ing", "le", "ou", "sch", "ai", "on", "re", "th", "ed"]


def words(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """``(doc_id, text)`` rows that need care."""
    rng = random.Random(5)
    rows = [(k, text) for k, text in enumerate(ODD_TEXTS)]
    rows += [(100 + k, words(rng, rng.randint(1, 300))) for k in range(30)]
    rows += [rows[-1], rows[-1], (None, "no id"), (None, None), (200, words(rng, 6000)), (7, "another text of id seven")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with further columns whose names clash with those the operators use."""
    rows = [(i, t, "x", None, 1, "y") for i, t in odd_rows]
    names = "doc_id long, text string, _words string, `n.words` int, kept int, class_id string"
    return spark.createDataFrame(rows, names).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept int")
