"""Quality classifier: rules read off small trees, weighted by a lasso, compiled into one column.

Boosted trees are grown over the statistics of :mod:`tidegauge.llm.quality_rules`. Each path from a
root becomes a conjunction of thresholds; logistic regression with an L1 penalty keeps few of them.
The kept rules and weights become a single Spark expression, so scoring runs in the JVM in the
same projection as the statistics, over whole texts and without a shuffle.

Sample: per class, the ``SAMPLE`` labelled training rows with the smallest hashes of their ids; the
intercept is corrected to the class shares among all training labels.

Defined results: a null or empty text has statistics 0 and is scored by the rules like any other;
rows without an id read as the empty text, whose crc32 is 0, so the query holds them out, and they are
never learned from; repeated rows get equal scores; without labels of both
classes every score is the share of good labels, or 0.5 without labels.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from tidegauge.llm import quality_rules
from tidegauge.llm.toxicity import sample_texts, training_rows
from tidegauge.session import through_table

STATISTICS = [
    "n_words", "mean_word_chars", "symbols_per_char", "shouts_per_word", "capitals_per_char", "stop_words_per_word",
    "dup_lines_per_line", "repeats_per_word", "words_per_line",
]
SAMPLE = 8000
TREES, DEPTH = 12, 3
PENALTY = 0.002


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame) -> DataFrame:
    """``(doc_id, statistics...)`` of every document, as doubles."""
    frame = quality_rules.measure(docs)
    words = F.greatest(F.col("n_words"), F.lit(1))
    frame = frame.withColumn("repeats_per_word", F.col("n_repeat_words") / words).withColumn(
        "words_per_line", F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))
    )
    return frame.select("doc_id", *[F.col(c).cast("double").alias(c) for c in STATISTICS])


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+0-9.Ee]+)\)$")


def paths(description: str) -> list[Rule]:
    """Every path from a root of the described trees, to inner nodes and leaves alike."""
    rules: dict[Rule, None] = {}
    stack: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        found = _BRANCH.match(line)
        if not found:
            continue
        depth = len(found[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, Condition(int(found[2]), found[3] == ">", float(found[4]))))
        rules[tuple(sorted({c for _, c in stack}, key=lambda c: (c.feature, c.above, c.threshold)))] = None
    return list(rules)


def holds(rule: Rule) -> Column:
    """Whether all conditions of a rule hold."""
    out: Column | None = None
    for c in rule:
        column = F.col(STATISTICS[c.feature])
        one = column > F.lit(c.threshold) if c.above else column <= F.lit(c.threshold)
        out = one if out is None else out & one
    return out


class Ensemble:
    """Weighted rules and an intercept."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]) -> None:
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The compiled score over the statistics' columns."""
        z = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            z = z + F.when(holds(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def learn(docs: DataFrame, labels: DataFrame, keep: Column, sample: int = SAMPLE) -> Ensemble:
    """Rules and weights from the labelled rows for which ``keep`` (over ``doc_id``) holds."""
    rows, sizes = training_rows(labels, "quality", keep, sample)
    if len(sizes) < 2:
        share = sizes.get(1, 0) / sum(sizes.values()) if sizes else 0.5
        return Ensemble(math.log((share + 1e-6) / (1 - share + 1e-6)), [])
    texts = sample_texts(docs, rows)
    data = through_table(
        statistics(texts).join(texts.select("doc_id", "label").distinct(), "doc_id"), "training-statistics"
    )
    own = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    if len(own) < 2:
        return Ensemble(math.log(sizes[1] / sizes[0]), [])
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(data).cache()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, labelCol="label", cacheNodeIds=False).fit(vectors)
    vectors.unpersist()
    rules = paths(trees.toDebugString)
    prior = math.log(sizes[1] / sizes[0]) - math.log(own[1] / own[0])
    if not rules:
        return Ensemble(math.log(own[1] / own[0]) + prior, [])
    truth = array_to_vector(F.array(*[holds(r).cast("double") for r in rules])).alias("features")
    hits = data.select("label", truth).cache()
    lasso = LogisticRegression(maxIter=80, regParam=PENALTY, elasticNetParam=1.0, standardization=False).fit(hits)
    hits.unpersist()
    weights = lasso.coefficients.toArray().tolist()
    return Ensemble(lasso.intercept + prior, [(r, w) for r, w in zip(rules, weights) if w])


def score(docs: DataFrame, ensemble: Ensemble) -> DataFrame:
    """``(doc_id, score)`` of every document."""
    return statistics(docs).select("doc_id", ensemble.score().alias("score"))
