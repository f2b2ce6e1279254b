"""The registered queries over ``documents`` and ``labels``, one per operator, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegauge.llm import (
    gear_chunks,
    jaccard_join,
    line_runs,
    packing,
    periodic_runs,
    pieces,
    prefix_trie,
    quality_rules,
    rule_ensemble,
    secret_grammar,
    suffix_buckets,
    toxicity,
    winnowing,
)
from tidegauge.llm.common import prepare, read_documents
from tidegauge.llm.toxicity import crc_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of one of the public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    """Register a query under its name."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return add


_STOP = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)

# The WITH parts that give ``judged``: every document with its counts and verdict.
JUDGED_SQL = f"""
split0 AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents),
split1 AS (
  SELECT *, row_number() OVER () AS r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM split0),
places AS (
  SELECT r, unnest(range(len(words) - 7)) AS i, words FROM split1 WHERE len(words) >= 8),
wins AS (SELECT r, i, list_slice(words, i + 1, i + 8) AS w FROM places),
twice AS (SELECT *, count(*) OVER (PARTITION BY r, w) AS c FROM wins),
hit AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM twice WHERE c > 1),
cover AS (SELECT r, sum(least(8, coalesce(j - i, 8))) AS n FROM hit GROUP BY r),
counted AS (
  SELECT doc_id, text, r, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(list_aggregate(list_concat(words, ['']), 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines,
         length(regexp_replace(text, '[^!]+', '', 'g')) AS n_shouts,
         length(regexp_replace(text, '\\P{{Lu}}+', '', 'g')) AS n_capitals,
         len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop
  FROM split1 LEFT JOIN cover USING (r)),
failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         greatest(n_words, 1)::DOUBLE AS w1, greatest(word_chars, 1)::DOUBLE AS c1
  FROM counted),
judged AS (
  SELECT *, NOT base_failed AND word_chars / w1 BETWEEN 2.0 AND 12.0 AND n_symbols / c1 <= 0.10
            AND n_shouts / w1 <= 0.50 AND n_capitals / c1 <= 0.50
            AND (n_words < 100 OR n_stop / w1 BETWEEN 0.005 AND 0.80)
            AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.50 AS kept
  FROM failed)"""


@query("op3_suffix_buckets")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document under strings of 200 bytes that start anywhere else."""
    return suffix_buckets.remove_repeats(read_documents(spark, folder))


def _judged(scored: DataFrame, held_out, threshold: float) -> DataFrame:
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query("op4_toxicity")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; learned from the labels that are not held out."""
    docs, labels = read_documents(spark, folder), spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    held_out = crc_remainder(F.col("doc_id"), 3) == 1
    return _judged(toxicity.score(docs, toxicity.learn(docs, labels, ~held_out)), held_out, 0.7)


@query("op5_rule_ensemble")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document; learned from the labels that are not held out."""
    docs, labels = read_documents(spark, folder), spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    return _judged(rule_ensemble.score(docs, rule_ensemble.learn(docs, labels, ~held_out)), held_out, 0.3)


@query("op6_quality_rules", f"""
WITH {JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of every document, the base rules and the threshold table's verdict."""
    return quality_rules.measure(read_documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# The WITH parts that give ``classes``: every row of ``docs0`` with its class and links.
CLASSES_SQL = """
ws AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM docs0),
plc AS (SELECT r, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM ws),
sh AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i + 1, i + 5) END AS s FROM plc),
num AS (SELECT s, row_number() OVER () AS k FROM (SELECT s FROM sh GROUP BY s HAVING count(*) > 1)),
sized AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
inv AS (SELECT r, k FROM sh JOIN num USING (s)),
met AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM inv a JOIN inv b ON a.k = b.k AND a.r <> b.r GROUP BY ALL),
pairs AS (
  SELECT a, b FROM met JOIN sized x ON x.r = a JOIN sized y ON y.r = b WHERE 9 * c >= 4 * (x.n + y.n)
  UNION ALL
  SELECT x.r, y.r FROM ws x JOIN ws y ON x.r <> y.r WHERE len(x.w) = 0 AND len(y.w) = 0),
reach AS (
  SELECT r, r AS q FROM ws
  UNION
  SELECT reach.r, b FROM reach JOIN pairs ON a = q),
lowest AS (SELECT reach.r, min(ws.doc_id) AS class_id FROM reach JOIN ws ON ws.r = q GROUP BY reach.r),
linked AS (SELECT a AS r, count(*) AS n_links FROM pairs GROUP BY a),
classes AS (
  SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
  FROM ws JOIN lowest USING (r) LEFT JOIN linked USING (r))"""


@query("op1_jaccard_join", f"""
WITH RECURSIVE docs0 AS (SELECT doc_id, text FROM documents), {CLASSES_SQL}
SELECT doc_id, class_id, n_links FROM classes""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Class of every document by links of 0.8 Jaccard similarity on five-word shingles, and its links."""
    return jaccard_join.link(read_documents(spark, folder)).select("doc_id", "class_id", "n_links")


@query("op2_secret_grammar")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and spans of secrets in every document: fixed patterns, and tokens the inferred automata accept."""
    found = secret_grammar.find(read_documents(spark, folder))
    base = F.col("base")

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_grammar.joined(base), 256).alias("base_sha256"),
        secret_grammar.joined(secret_grammar.by_start(F.concat("base", "added"))).alias("spans"),
    )


@query("op7_gear_chunks")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the stretches of chunks that came before in the corpus."""
    return gear_chunks.remove_repeats(read_documents(spark, folder))


@query("op8_winnowing")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    compared = winnowing.compare_with_next(read_documents(spark, folder))
    return compared.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next", "n_fingerprints",
    )


@query("op9_sentencepiece")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of what they decode to."""
    encoded = pieces.encode(read_documents(spark, folder), vocabulary("piece_bpe_32k.model"), decode=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.array_max("ends"), F.lit(0)).cast("long").alias("last_byte"),
        # pieces follow each other without gaps, so their ends are their spans
        F.sha2(F.array_join(F.col("ends").cast("array<string>"), ","), 256).alias("ends_sha256"),
    )


@query("op10_best_fit_packing")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces with their sequence and place in it."""
    return packing.pack(packing.cut_documents(read_documents(spark, folder), vocabulary("word_bpe_49k.json")))


# CRC-32 of the decimal digits of ``c``, byte by byte and bit by bit.
_CRC_SQL = """xor(list_reduce(
  list_concat([4294967295::BIGINT], list_transform(range(1, len(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda s, b: list_reduce(list_concat([xor(s, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                           lambda t, z: xor(t // 2, 3988292384 * (t % 2)))), 4294967295)"""


@query("op11_prefix_trie", f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT c, l, {_CRC_SQL} % 9 AS h, c - ((c % 5) + 5) % 5 AS b FROM own),
rebuilt AS (
  SELECT a.c, list_concat(list_slice(coalesce(o.l, []), 1, a.h), list_slice(a.l, a.h + 1, len(a.l))) AS l
  FROM headed a LEFT JOIN own o ON o.c = a.b),
starts AS (SELECT c, len(l) AS n, unnest(range(len(l) + 1)) AS d, l FROM rebuilt),
placed AS (
  SELECT c, n, d, min(c) OVER (PARTITION BY d, list_slice(l, 1, d)) AS m,
         CASE WHEN d > 0 THEN strlen(l[d].t) ELSE 0 END AS size
  FROM starts),
walked AS (SELECT *, lag(m) OVER (PARTITION BY c ORDER BY d) AS p FROM placed),
nodes AS (
  SELECT m, d, min(p) AS p, count(*) AS k, max(n) AS deepest, max(size) AS size,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends
  FROM walked GROUP BY m, d),
children AS (SELECT p AS m, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
trees AS (
  SELECT u.m, u.d, count_if(v.d = v.deepest) AS n_leaves, sum((v.k - 1) * v.size) AS saved
  FROM placed u JOIN nodes v ON v.m = u.c AND v.d >= u.d GROUP BY u.m, u.d)
SELECT m AS conv_id, d AS depth, p AS parent_conv_id, k AS n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM nodes LEFT JOIN children USING (m, d) JOIN trees USING (m, d)""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, with what each subtree holds."""
    prepare(spark)
    return prefix_trie.nodes(spark.read.parquet(f"{folder.rstrip('/')}/conversations.parquet"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of words in every document, some of which are made periodic, and the text without repeated periods."""
    return periodic_runs.measure(read_documents(spark, folder), periodic_runs.planted).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words"
    )


@query("op13_line_runs", """
WITH rows0 AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
each AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM rows0),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM each),
often AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key
  HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 5),
judged AS (
  SELECT r, doc_id, i, line, keeper IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone
  FROM keyed LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r, doc_id""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the long lines that five documents or more hold, but for the largest one."""
    cut = line_runs.drop_repeated(read_documents(spark, folder))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
