"""Quality scores by a regularised quadratic discriminant over document statistics.

The statistics of a text are DataFrame expressions.  Spark sums their class moments over all
training rows, so that only two small matrices come to the driver; there each covariance is
shrunk towards the pooled one and towards its diagonal and is factored once.  A score is the
logistic of the difference of two Mahalanobis log-densities, again an expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import SPACES, words_of
from .scratch import Scratch

FEATURES = ("length", "word_length", "symbols", "bangs", "bars", "digits", "upper", "distinct", "adjacent", "line_words", "stops")


def statistics(docs: DataFrame) -> DataFrame:
    """``doc_id`` and one double per name in FEATURES; a null or empty text has all 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    drawn = docs.select("doc_id", text.alias("body"), words_of(text).alias("words"))
    count = lambda chars: F.length("body") - F.length(F.translate("body", chars, ""))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    words = F.size("words")
    solid = F.length(F.translate("body", SPACES, ""))
    changed = F.length("body") - F.length(F.regexp_replace("body", "\\p{Lu}", ""))
    same = F.size(F.filter("words", lambda w, i: F.coalesce(F.get(F.col("words"), i - 1) == w, F.lit(False))))
    per_word = lambda n: F.log1p(100 * share(n, words))
    return drawn.select(
        "doc_id",
        F.log1p(words).alias("length"),
        F.log1p(share(solid, words)).alias("word_length"),
        per_word(count("#*$%&<>")).alias("symbols"),
        per_word(count("!?")).alias("bangs"),
        per_word(count("|")).alias("bars"),
        per_word(count("0123456789")).alias("digits"),
        F.log1p(100 * share(changed, solid)).alias("upper"),
        F.pow(share(F.size(F.array_distinct("words")), words), F.lit(0.5)).alias("distinct"),
        per_word(same).alias("adjacent"),
        F.log1p(share(words, count("\n") + 1)).alias("line_words"),
        per_word(count(".,")).alias("stops"),
    )


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log priors less half log determinants, by class."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def log_density(self, k: int) -> Column:
        total = F.lit(float(self.offsets[k]))
        for row in range(len(FEATURES)):
            z = F.lit(0.0)
            for j in range(row + 1):
                z = z + F.lit(float(self.factors[k][row, j])) * (F.col(FEATURES[j]) - F.lit(float(self.means[k][j])))
            total = total - F.lit(0.5) * z * z
        return total

    def score(self) -> Column:
        gap = self.log_density(1) - self.log_density(0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.least(-gap, F.lit(500.0)), F.lit(-500.0))))


def fit(rows: DataFrame, pooled: float = 0.1, diagonal: float = 0.1, ridge: float = 0.05) -> Discriminant | float:
    """From rows with ``label`` (0 or 1) and FEATURES; other labels and null features are left out.

    A class without rows gives a constant: 0.5 if both lack them, else the label there is.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    made = (
        rows.where("label in (0, 1)").groupBy("label").agg(
            F.count("*").alias("n"), *(F.sum(c).alias(f"s_{c}") for c in FEATURES),
            *(F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p_{i}_{j}") for i, j in pairs),
        ).collect()
    )
    by = {r["label"]: r for r in made}
    if len(by) < 2:
        return float(next(iter(by))) if by else 0.5
    means, spreads, sizes = [], [], []
    for k in (0, 1):
        n = by[k]["n"]
        mean = np.array([by[k][f"s_{c}"] for c in FEATURES], float) / n
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = by[k][f"p_{i}_{j}"] / n
        means.append(mean)
        spreads.append(second - np.outer(mean, mean))
        sizes.append(n)
    common = (sizes[0] * spreads[0] + sizes[1] * spreads[1]) / sum(sizes)
    between = np.subtract(*means) ** 2 * sizes[0] * sizes[1] / sum(sizes) ** 2
    scale = np.diag(common) + between + 1e-6
    factors, offsets = [], []
    for k in (0, 1):
        s = (1 - pooled) * spreads[k] + pooled * common
        s = (1 - diagonal) * s + diagonal * np.diag(np.diag(s)) + ridge * np.diag(scale)
        low = np.linalg.cholesky(s)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(sizes[k] / sum(sizes)) - np.log(np.diag(low)).sum())
    return Discriminant(np.array(means), np.array(factors), np.array(offsets))


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row of docs.

    docs needs doc_id and text, labels doc_id and label (0 or 1; others are ignored); further
    columns are ignored.  ``held_out`` is a condition on doc_id; such rows, and rows of null
    doc_id, are scored but never learnt from.  Rows that repeat a doc_id are scored each by
    its own text, an empty or null one too; a score of just 0.5 predicts 1.  An empty table
    gives an empty result.
    """
    stats = Scratch(spark).save(statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))))
    learnt = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"))
    model = fit(stats.where(~held_out).join(learnt, "doc_id"))
    score = F.lit(model) if isinstance(model, float) else model.score()
    return stats.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by :func:`classify`, whose docstring defines nulls, empties, ties and repeats."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumnRenamed("quality", "label")
    return classify(spark, docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
