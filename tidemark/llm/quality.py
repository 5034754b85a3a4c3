"""A regularised quadratic discriminant over document statistics.

Each class has a mean and a covariance over transformed statistics, shrunk towards its diagonal and towards
the pooled covariance. The score is the posterior of label 1 from the difference of the log densities, whose
Mahalanobis distances come from Cholesky factors computed once per model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK, fold, stored

#: Ranges of the statistics before they are scaled; values beyond are drawn in, so that no text leaves the model's reach.
FEATURES = (
    "log_words", "word_length", "symbols", "exclamation", "upper", "different_words", "punctuation", "repeated_lines", "digits",
)


def statistics(text: Column, words: Column) -> list[Column]:
    """Statistics of a whole text, all finite; a null or empty text gives the statistics of no words."""
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(F.array_join(words, "")), F.lit(1)).cast("double")
    runs = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    shrunk = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    n_lines = F.greatest(F.size(lines), F.lit(1)).cast("double")
    root = lambda c: F.sqrt(F.least(c, F.lit(4.0)))
    return [
        F.log1p(F.size(words).cast("double")).alias("log_words"),
        F.log(F.least(chars / n, F.lit(40.0))).alias("word_length"),
        root(shrunk("[#*$%&|<>]+") / n).alias("symbols"),
        root(runs("!") / n).alias("exclamation"),
        root(shrunk(r"\p{Lu}+") / chars).alias("upper"),
        # Longer texts repeat more of their words; the root of the length evens that out.
        F.log(F.size(F.array_distinct(words)) / n + F.lit(0.01)).alias("different_words"),
        root(runs(r"[.,;:?]") / n).alias("punctuation"),
        (F.lit(1.0) - F.greatest(F.size(F.array_distinct(lines)), F.lit(1)) / n_lines).alias("repeated_lines"),
        root(shrunk("[0-9]+") / chars).alias("digits"),
    ]


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics of every row, from one pass over the texts."""
    raw = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(raw, F.lit(" \t\n\x0b\x0c\r"))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{BLANK}+"))
    rows = df.withColumn("__text", raw).withColumn("__words", words)
    return rows.select(*[F.col(c) for c in df.columns], *statistics(F.col("__text"), F.col("__words")))


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of both classes, with log determinants and log priors."""

    means: np.ndarray
    inverse: np.ndarray
    offsets: np.ndarray

    def log_density(self, x: np.ndarray, label: int) -> np.ndarray:
        z = (x - self.means[label]) @ self.inverse[label].T
        return self.offsets[label] - 0.5 * (z * z).sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        odds = np.clip(self.log_density(x, 1) - self.log_density(x, 0), -500, 500)
        return 1.0 / (1.0 + np.exp(-odds))


def moments(labelled: DataFrame, label: str, features: Sequence[str]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Count, mean and covariance per class: sums combined on the map side, one row per class to the driver."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    rows = labelled.filter(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"p{i}_{j}") for i, j in pairs],
    ).collect()
    out = {}
    for r in rows:
        mean = np.array([r[f"s{i}"] for i in range(len(features))]) / r["n"]
        cov = np.zeros((len(features), len(features)))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"p{i}_{j}"] / r["n"] - mean[i] * mean[j]
        out[int(r[label])] = (r["n"], mean, cov)
    return out


def fit(stats: dict[int, tuple[int, np.ndarray, np.ndarray]], to_pooled: float = 0.2, to_diagonal: float = 0.2, floor: float = 0.02) -> Discriminant | None:
    """Shrink the covariances and factor them once. None unless both classes have rows.

    ``floor`` is added to every variance: a statistic that hardly ever varies within a class must not decide alone.
    """
    if set(stats) != {0, 1}:
        return None
    total = stats[0][0] + stats[1][0]
    pooled = sum(n * c for n, _, c in stats.values()) / total
    means, inverses, offsets = [], [], []
    for label in (0, 1):
        n, mean, cov = stats[label]
        cov = (1 - to_pooled) * cov + to_pooled * pooled
        cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        means.append(mean)
        inverses.append(np.linalg.inv(factor))
        offsets.append(np.log(n / total) - np.log(np.diag(factor)).sum())
    return Discriminant(np.array(means), np.array(inverses), np.array(offsets))


def scored(table: DataFrame, model: Discriminant | None, features: Sequence[str] = FEATURES) -> DataFrame:
    """Add ``score``; without a model every row scores 0.5."""
    if model is None:
        return table.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(model.score(np.column_stack(columns)))

    return table.withColumn("score", score(*features))


def learn(table: DataFrame, labels: DataFrame, label: str = "quality") -> Discriminant | None:
    """Fit on all labelled rows outside the held-out fold. ``table`` has doc_id and the statistics."""
    marks = labels.filter(fold(F.col("doc_id")) != 2).select(F.col("doc_id").alias("__id"), F.col(label).alias("__label"))
    return fit(moments(table.join(marks, F.col("doc_id") == F.col("__id")), "__label", FEATURES))


def narrow(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return stored(with_statistics(ids).drop("text"), "statistics")


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.7, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Only labelled rows outside the held-out fold (crc32 of the id modulo 4 is 2) teach the model, all of them.
    Label rows of null or other values are ignored, repeated ones count repeatedly. Null and empty texts score
    by the statistics of no words; repeated rows score alike; other columns are ignored.
    """
    table = narrow(docs, doc_id, text)
    out = scored(table, learn(table, labels, label))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= least, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.7, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` scored at ``least`` and more, with their columns as they were.

    The decision is made beside the text, which is not shuffled. Without a model nothing is rejected.
    """
    model = learn(narrow(docs, doc_id, text), labels, label)
    if model is None:
        return docs
    names = [f"__{f}" for f in FEATURES]
    raw = with_statistics(docs.select(F.struct("*").alias("__row"), F.col(text).alias("__t")), "__t").withColumnsRenamed(dict(zip(FEATURES, names)))
    return scored(raw, model, names).filter(F.col("score") >= least).select("__row.*")
