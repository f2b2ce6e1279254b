"""Quality rules: one projection of counts and ratios against a threshold table, all in the JVM.

Windows of eight words are compared by 64-bit hashes that are built by doubling, inside one text
only. Everything is computed from the row's own text with built-in functions, so there is no shuffle,
no Python and no state; memory per row is a small multiple of its text.

Defined results: a null or empty text has no words, fails the base rules and is not kept;
equal rows get equal results; extra columns are ignored by :func:`measure` and kept by
:func:`keep_good`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm.common import documents_of, fresh, quoted

# White space, symbols and the two base rules.
SPACES = " \\t\\n\\x0B\\f\\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30

# Very common words of English, French, German and Spanish.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "that", "for", "it", "was", "are", "with", "on", "be", "at", "by", "or",
    "de", "la", "le", "les", "des", "et", "en", "un", "une", "est", "du", "que", "qui", "dans", "pour", "par", "sur",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "ist", "dem", "für", "auf", "ein", "eine", "im", "nicht",
    "el", "los", "las", "del", "se", "y", "a", "con", "no", "su", "al", "lo", "como", "más", "por", "para",
]

# As written inside a sentence and at its start.
STOP_FORMS = STOP_WORDS + [w.capitalize() for w in STOP_WORDS]


@dataclass(frozen=True)
class Rule:
    """A ratio and the range in which a text passes; shorter texts are not judged by it."""

    ratio: str
    low: float
    high: float
    from_words: int = LEAST_WORDS


# The threshold table. Ratios are over whole texts.
RULES = [
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbols_per_char", 0.0, 0.10),
    Rule("shouts_per_word", 0.0, 0.50),
    Rule("capitals_per_char", 0.0, 0.50),
    Rule("stop_words_per_word", 0.005, 0.80, 100),
    Rule("dup_lines_per_line", 0.0, 0.50),
]


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1)).cast("double")


def _without(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _lists(text: Column) -> dict[str, Column]:
    return {
        "_words": F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != ""),
        "_lines": F.filter(F.split(text, "\\n"), lambda line: line.rlike(f"[^{SPACES}]")),
    }


def _joined(hashes: Column, step: int) -> Column:
    """At each place the hash of its own run of words and the run ``step`` words on: runs of twice the length."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def _sorted_windows(windows: Column) -> Column:
    """Windows by hash and place; empty when no two are equal, which most texts skip the sort by."""
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    by_hash = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), none).otherwise(by_hash)


def _repeated_places(ordered: Column) -> Column:
    """Places of windows that have an equal one, ascending."""
    def twice(x: Column, k: Column) -> Column:
        before = F.get(ordered, k - 1).getField("h") == x.getField("h")
        after = F.get(ordered, k + 1).getField("h") == x.getField("h")
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    return F.array_sort(F.transform(F.filter(ordered, twice), lambda x: x.getField("i")))


def _covered(places: Column) -> Column:
    """Words under windows that start at the given ascending places."""
    reach = F.transform(
        places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
    )
    return F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n)


def measure(docs: DataFrame) -> DataFrame:
    """Counts, ratios and verdict of every document, as one chain of projections.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the ratios of
    the threshold table, base_failed, failed_rules (their names) and kept.
    """
    return _judge(documents_of(docs))


def _judge(frame: DataFrame) -> DataFrame:
    text = F.col("text")
    rest = [c for c in frame.columns if c != "text"]
    frame = frame.select(*rest, "text", *[c.alias(n) for n, c in _lists(text).items()])
    hashed = F.transform(F.col("_words"), lambda w: F.xxhash64(w))
    frame = frame.select(*rest, "text", "_words", "_lines", hashed.alias("_windows"))
    for step in (1, 2, 4):
        frame = frame.select(*rest, "text", "_words", "_lines", _joined(F.col("_windows"), step).alias("_windows"))
    whole = F.slice("_windows", 1, F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0)))
    frame = frame.select(*rest, "text", "_words", "_lines", whole.alias("_windows"))
    frame = frame.select(*rest, "text", "_words", "_lines", _sorted_windows(F.col("_windows")).alias("_ordered"))
    frame = frame.select(*rest, "text", "_words", "_lines", _repeated_places(F.col("_ordered")).alias("_places"))
    words, lines = F.col("_words"), F.col("_lines")
    frame = frame.select(
        *rest,
        F.size(words).cast("long").alias("n_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _without(text, f"[{SYMBOLS}]+").cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _covered(F.col("_places")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _without(text, "!+").cast("long").alias("n_shouts"),
        _without(text, "\\p{Lu}+").cast("long").alias("n_capitals"),
        F.size(F.filter(words, lambda w: w.isin(STOP_FORMS))).cast("long").alias("n_stop_words"),
    )
    n = F.col("n_words")
    frame = frame.select(
        "*",
        _share(F.col("word_chars"), n).alias("mean_word_chars"),
        _share(F.col("n_symbols"), F.col("word_chars")).alias("symbols_per_char"),
        _share(F.col("n_shouts"), n).alias("shouts_per_word"),
        _share(F.col("n_capitals"), F.col("word_chars")).alias("capitals_per_char"),
        _share(F.col("n_stop_words"), n).alias("stop_words_per_word"),
        _share(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_lines_per_line"),
        ((n < LEAST_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED_PERCENT) * n))
        .alias("base_failed"),
    )
    broken = [
        F.when((n >= rule.from_words) & ~F.col(rule.ratio).between(rule.low, rule.high), F.lit(rule.ratio))
        for rule in RULES
    ]
    frame = frame.withColumn("failed_rules", F.array_compact(F.array(*broken)))
    # A filter on the verdict must not be moved below the projections: it would repeat each of them
    # inside the next. A row number in the verdict, always true here, holds it back.
    stays = F.monotonically_increasing_id() >= 0
    return frame.withColumn("kept", stays & ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    (packed,) = fresh(docs, "_row")
    frame = docs.select(
        F.struct(*quoted(docs.columns)).alias(packed), F.coalesce(F.col("`text`").cast("string"), F.lit("")).alias("text")
    )
    kept = _judge(frame).where("kept")
    inner = [F.col(packed).getField(c).alias(c) for c in docs.columns]
    return kept.select(*inner)
