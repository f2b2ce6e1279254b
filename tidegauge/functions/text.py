"""Text and JSON helpers as column expressions.

Every helper stays in the JVM except accent stripping, for which Spark has no
built-in Unicode decomposition.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Whitespace as text splitting understands it: Unicode white space plus the four
# ASCII separators.
_SPACE = r"(?U)[\s\x{1c}-\x{1f}]"


def collapse_whitespace(text: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return F.trim(F.regexp_replace(text, _SPACE + "+", " "))


def normalize_document(text: Column) -> Column:
    """Trimmed lines with single inner spaces and at most one blank line in a row."""
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    spaced = F.regexp_replace(unix, r"(?U)[\s\x{1c}-\x{1f}&&[^\n]]+", " ")
    lines = F.regexp_replace(spaced, " ?\n ?", "\n")
    return trim_block(F.regexp_replace(lines, "\n{3,}", "\n\n"))


def trim_block(text: Column) -> Column:
    """Remove spaces and line breaks at both ends."""
    return F.btrim(text, F.lit(" \n"))


def word_list(text: Column) -> Column:
    """Lower-cased words in order, repeats kept."""
    words = F.split(collapse_whitespace(F.lower(text)), " ")
    return F.filter(words, lambda w: w != "")


def lexical_overlap(query: Column, passage: Column) -> Column:
    """Query words (with repeats) found in the passage over the distinct query words."""
    terms, words = word_list(query), F.array_distinct(word_list(passage))
    hits = F.size(F.filter(terms, lambda t: F.array_contains(words, t)))
    distinct = F.greatest(F.lit(1), F.size(F.array_distinct(terms)))
    return hits.cast("double") / distinct


# Words that carry no meaning in reference answers.
STOP_WORDS = [
    "a", "ao", "aos", "as", "com", "como", "da", "das", "de", "do", "dos", "e", "em",
    "na", "nas", "no", "nos", "o", "os", "ou", "para", "por", "que", "se", "um", "uma",
]
# What counts as a term, what is cut from its ends, its least length.
TERM_PATTERN = r"(?iu)[a-z0-9_./*-]+"
TERM_EDGES = ".,:;!?"
LONGEST_DROPPED_TERM = 2


def reference_terms(text: Column) -> Column:
    """Distinct key terms of a reference text, in order of first use."""
    found = F.regexp_extract_all(collapse_whitespace(F.lower(text)), F.lit(TERM_PATTERN), 0)
    cleaned = F.transform(found, lambda t: F.btrim(t, F.lit(TERM_EDGES)))
    kept = F.filter(
        cleaned,
        lambda t: ~t.isin(STOP_WORDS)
        & ((F.length(t) > LONGEST_DROPPED_TERM) | t.startswith("/")),
    )
    return F.array_distinct(kept)


def matched_terms(terms: Column, answer: Column) -> Column:
    """Terms that occur as substrings of the answer."""
    flat = collapse_whitespace(F.lower(answer))
    return F.filter(terms, lambda t: F.instr(flat, t) > 0)


def coverage_share(matched: Column, terms: Column) -> Column:
    """Share of matched terms at four decimals; no terms gives 0."""
    return F.when(F.size(terms) > 0, F.round(F.size(matched) / F.size(terms), 4)).otherwise(0.0)


def short_text(text: Column, limit: int = 220) -> Column:
    """Collapsed text cut to ``limit`` characters with an ellipsis."""
    flat = collapse_whitespace(text)
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(flat) > limit, cut).otherwise(flat)


def format_context(source: Column, source_type: Column, chunk_id: Column, text: Column) -> Column:
    """A passage under its source header."""
    return F.format_string("[Fonte: %s | tipo: %s | chunk: %d]\n%s", source, source_type, chunk_id, text)


def sanitize_name(name: Column) -> Column:
    """Lower-case name with underscores for spaces."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""

    def plain(value):
        if value is None or value.isascii():
            return value
        return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))

    return text.map(plain, na_action="ignore")


# --- safety ---------------------------------------------------------------

# Phrases that mark an attempt to override instructions.
INJECTION_PATTERNS = [
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"you\s+are\s+now\s+a",
    r"developer:\s*",
    r"assistant:\s*",
    r"system:\s*",
    r"<\|im_start\|>",
    r"\[INST\]",
    r"forget\s+(everything|all|your\s+instructions)",
]
MAX_INPUT_CHARS = 4096
# Verdict texts.
BLOCKED_PATTERN = "Input bloqueado: padrão suspeito detectado."
BLOCKED_LENGTH = "Input bloqueado: excede tamanho máximo ({limit} chars)."
ACCEPTED = "OK"

# Personal-data patterns and their masks, in order of application.
PII_PATTERNS = [
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL_REDACTED]"),
    ("phone", r"\b(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)?\d{4,5}-?\d{4}\b", "[PHONE_REDACTED]"),
    ("cpf", r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "[CPF_REDACTED]"),
]


def printable(text: Column) -> Column:
    """Text without control, format and separator characters other than the space."""
    return F.trim(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}]|(?! )\p{Zs}", ""))


def guardrail_message(text: Column, limit: int = MAX_INPUT_CHARS) -> Column:
    """Verdict text; the pattern check comes before the length check."""
    clean = printable(text)
    suspicious = clean.rlike("(?iU)" + "|".join(f"(?:{p})" for p in INJECTION_PATTERNS))
    return (
        F.when(suspicious, F.lit(BLOCKED_PATTERN))
        .when(F.length(clean) > limit, F.lit(BLOCKED_LENGTH.format(limit=limit)))
        .otherwise(F.lit(ACCEPTED))
    )


def redact_pii(text: Column) -> Column:
    """Mask e-mails, then phone numbers, then CPF numbers."""
    for _, pattern, mask in PII_PATTERNS:
        text = F.regexp_replace(text, "(?U)" + pattern, mask)
    return text


def pii_counts(text: Column) -> dict[str, Column]:
    """Hits per kind, each counted on what the earlier masks left."""
    counts = {}
    for kind, pattern, mask in PII_PATTERNS:
        counts[kind] = F.regexp_count(text, F.lit("(?U)" + pattern))
        text = F.regexp_replace(text, "(?U)" + pattern, mask)
    return counts


# --- attributes in free text ----------------------------------------------

# How each attribute is worded, and the defaults of a request.
ATTRIBUTE_PATTERNS = {
    "Age": (r"\b(\d{2})\s+anos\b", "int"),
    "CreditScore": (r"(?:credit score|score)\s*(\d{3})\b", "int"),
    "Balance": (r"\bsaldo(?:\s+de)?\s*(\d+(?:[.,]\d+)?)\b", "double"),
    "NumOfProducts": (r"\b(\d)\s+produt", "int"),
    "Tenure": (r"(?:tenure|relacionamento|anos de conta|anos no banco)\s*(\d+)\b", "int"),
}
COUNTRY_TERMS = {
    "alemanha": "Germany", "espanha": "Spain", "franca": "France", "frança": "France",
    "germany": "Germany", "spain": "Spain", "france": "France",
}
GENDER_TERMS = {"feminino": "Female", "female": "Female", "masculino": "Male", "male": "Male"}
INACTIVE_TERMS = ["inativo", "sem atividade", "sem atividade recente"]
ACTIVE_TERMS = ["ativo", "atividade recente", "engajado"]
SAME_CUSTOMER_TERMS = ["mesmo cliente", "mesma cliente", "same customer"]
REQUEST_DEFAULTS = {
    "CreditScore": 600, "Geography": "France", "Gender": "Female", "Age": 40, "Tenure": 5,
    "Balance": 0.0, "NumOfProducts": 1, "HasCrCard": 1, "IsActiveMember": 1,
    "EstimatedSalary": 50000.0, "Card Type": "SILVER", "Point Earned": 100,
}
BASELINE_PATTERN = r"baseline(?:_scenario)?\s*[:=]?\s*(.*?)\s+improved(?:_scenario)?\s*[:=]?\s*(.*)"
PAIR_PATTERN = r"\bum com\b\s*(.*?)\s*\boutro com\b\s*(.*)"


def _any_of(text: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for term in terms:
        found = found | text.contains(term)
    return found


def _first_of(text: Column, terms: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.contains(t), F.lit(v)) for t, v in terms.items()])


def extract_attributes(text: Column) -> dict[str, Column]:
    """Customer attributes named in a message; null where a message is silent."""
    return flat_attributes(flat_message(text))


def flat_message(text: Column) -> Column:
    """A message in lower case with single spaces."""
    return F.lower(collapse_whitespace(text))


def flat_attributes(flat: Column) -> dict[str, Column]:
    """Customer attributes named in a message from :func:`flat_message`, which each of them reads."""
    found = {}
    for name, (pattern, kind) in ATTRIBUTE_PATTERNS.items():
        raw = F.regexp_extract(flat, "(?U)" + pattern, 1)
        found[name] = F.replace(raw, F.lit(","), F.lit(".")).try_cast(kind)
    found["Geography"] = _first_of(flat, COUNTRY_TERMS)
    found["Gender"] = _first_of(flat, GENDER_TERMS)
    found["IsActiveMember"] = F.when(_any_of(flat, INACTIVE_TERMS), F.lit(0)).when(
        _any_of(flat, ACTIVE_TERMS), F.lit(1)
    )
    return found


def comparison_halves(text: Column) -> tuple[Column, Column]:
    """Baseline and improved part of a comparison message, null when it is none."""
    flat = strip_accents(F.lower(collapse_whitespace(text)))

    def half(group: int) -> Column:
        return F.trim(
            F.when(flat.rlike("(?U)" + BASELINE_PATTERN), F.regexp_extract(flat, "(?U)" + BASELINE_PATTERN, group))
            .when(flat.rlike("(?U)" + PAIR_PATTERN), F.regexp_extract(flat, "(?U)" + PAIR_PATTERN, group))
        )

    return half(1), half(2)


def same_customer(text: Column) -> Column:
    """Whether the second half speaks of the first half's customer."""
    return _any_of(text, SAME_CUSTOMER_TERMS)


# --- JSON inside text -----------------------------------------------------


def fenced_json(text: Column) -> Column:
    """The JSON part of a model answer, with or without a code fence."""
    clean = trim_space(text)
    pattern = r"(?U)```(?:json)?\s*([\s\S]*?)\s*```"
    return F.when(clean.rlike(pattern), trim_space(F.regexp_extract(clean, pattern, 1))).otherwise(clean)


def lenient_json(text: Column) -> Column:
    """As the agent loop reads an answer: outer backticks and the first 'json' cut."""
    clean = trim_space(text)
    bare = F.btrim(clean, F.lit("`"))
    at = F.instr(bare, "json")
    without = F.when(at > 0, F.concat(F.left(bare, at - 1), F.substr(bare, at + 4))).otherwise(bare)
    return F.when(clean.startswith("```"), trim_space(without)).otherwise(clean)


def trim_space(text: Column) -> Column:
    """Cut white space of every kind at both ends."""
    return F.regexp_replace(text, r"^" + _SPACE + r"+|" + _SPACE + r"+$", "")


def json_status(text: Column) -> Column:
    """'ok' for a JSON object, 'json_non_dict' for other JSON, else 'json_invalid'.

    The parser stops at the end of the first value, so the text is parsed as the
    first of two array items: only then do glued records show.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"#end"]')))
    whole = F.try_variant_get(pair, "$[1]", "string").eqNullSafe(F.lit("#end")) & F.try_variant_get(
        pair, "$[2]", "string"
    ).isNull()
    return (
        F.when(~whole, F.lit("json_invalid"))
        .when(text.startswith("{"), F.lit("ok"))
        .otherwise(F.lit("json_non_dict"))
    )


OBSERVATION = T.StructType(
    [
        T.StructField("retrieved_contexts", T.ArrayType(T.StringType())),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)


def trace_contexts(trace: Column) -> Column:
    """Contexts seen by the search steps of an agent trace, blanks dropped."""
    steps = F.filter(trace, lambda s: s["action"] == "rag_search")
    parsed = F.transform(steps, lambda s: F.from_json(s["observation"], OBSERVATION))
    lists = F.transform(
        parsed,
        lambda p: F.coalesce(p["retrieved_contexts"], p["evidence"], F.array().cast("array<string>")),
    )
    texts = F.transform(F.flatten(lists), lambda c: trim_space(c))
    return F.filter(texts, lambda c: c.isNotNull() & (c != ""))
