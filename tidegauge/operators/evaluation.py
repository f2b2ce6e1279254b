"""Golden items, judge scores and prompt-variant comparison as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.functions.numeric import clamp_score
from tidegauge.functions.text import coverage_share, matched_terms, reference_terms, trim_space

# Criteria of the judge.
CRITERIA = ["adequacao_negocio", "correcao_conteudo", "clareza_utilidade"]


def normalize_golden(items: DataFrame) -> DataFrame:
    """Golden items with query, category and contexts filled and trimmed."""
    text = {
        "query": F.coalesce(F.nullif(F.col("query"), F.lit("")), F.col("question"), F.lit("")),
        "expected_answer": F.coalesce("expected_answer", F.lit("")),
    }
    return items.withColumns({n: trim_space(c) for n, c in text.items()}).withColumns(
        {
            "category": F.coalesce(F.nullif(F.col("category"), F.lit("")), F.col("metadata.category")),
            "contexts": F.transform(
                F.coalesce("contexts", F.array().cast("array<string>")), lambda c: trim_space(c)
            ),
            "expected_tools": F.coalesce("expected_tools", F.array().cast("array<string>")),
        }
    )


def require_golden(items: DataFrame) -> DataFrame:
    """Raise when there is no item or one lacks its query."""
    row = items.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("query") == "").alias("empty")).first()
    if row["n"] == 0:
        raise ValueError("the golden set has no items")
    if row["empty"]:
        raise ValueError(f"{row['empty']} golden items have no query")
    return items


def join_responses(golden: DataFrame, responses: DataFrame) -> DataFrame:
    """Golden items with the answers generated for them, unanswered ones kept."""
    return golden.join(responses, "id", "left")


def keyword_coverage(df: DataFrame, answer: str, reference: str) -> DataFrame:
    """Key terms of the reference, those found in the answer, and their share."""
    terms = df.withColumn("required_terms", reference_terms(F.col(reference)))
    hits = terms.withColumn("matched_terms", matched_terms(F.col("required_terms"), F.col(answer)))
    return hits.withColumns(
        {
            "missing_terms": F.array_except("required_terms", "matched_terms"),
            "keyword_coverage": coverage_share(F.col("matched_terms"), F.col("required_terms")),
        }
    )


def judge_means(rows: DataFrame, criteria: Sequence[str], failed: str | None = None) -> DataFrame:
    """Mean clamped score per criterion at four decimals, and their overall mean.

    Failed rows count as 1 on every criterion.
    """
    bad = F.col(failed) if failed else F.lit(False)
    scores = {c: F.when(bad, F.lit(1)).otherwise(clamp_score(F.col(c))) for c in criteria}
    means = rows.agg(
        F.count(F.lit(1)).alias("n_judged"),
        *[F.round(F.avg(s), 4).alias(c) for c, s in scores.items()],
    )
    total = F.lit(0.0)
    for c in criteria:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return means.withColumn("overall_mean", F.round(total / F.lit(float(len(criteria))), 4))


def rank_variants(rows: DataFrame, variant: str, coverage: str, judge: str) -> DataFrame:
    """Mean coverage and judge score per variant, best first."""

    def mean(column: str) -> Column:
        # summed as decimals, so that the rounded mean does not depend on the order of rows
        return F.round(F.avg(F.col(column).cast("decimal(22,8)")), 4).cast("double")

    means = rows.groupBy(variant).agg(
        F.count(F.lit(1)).alias("n"),
        mean(coverage).alias("mean_coverage"),
        mean(judge).alias("mean_judge"),
    )
    return means.orderBy(
        F.coalesce("mean_judge", F.lit(-1.0)).desc(), F.col("mean_coverage").desc(), F.col(variant)
    )
