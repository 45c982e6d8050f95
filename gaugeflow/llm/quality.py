"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text becomes a dozen transformed statistics, computed once and kept.  Class means and
covariances come from sums over all labelled rows of the learning folds, which Spark adds
up; the driver sees only those few hundred numbers.  Covariances are shrunk towards the
pooled one and towards its diagonal, and a score is the Mahalanobis log-density difference
of the classes, with the Cholesky factors computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.common import Columns, batchwise, fold, materialized, text_or_empty, whole

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

STATISTICS = (
    "log_words", "upper", "symbols", "adjacent_repeats", "distinct", "word_length",
    "symbol_ends", "digits", "stops", "lone_symbols", "line_length", "top_word",
)

# Byte classes of UTF-8 text.
_UPPER, _LOWER, _DIGIT, _STOP, _SPACE, _SYMBOL, _HIGH = range(7)
_CLASS = np.full(256, _SYMBOL, np.uint8)
for _chars, _kind in (
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER),
    (b"abcdefghijklmnopqrstuvwxyz", _LOWER),
    (b"0123456789", _DIGIT),
    (b".,;:'\"?()-", _STOP),
    (b" \t\r\n\x0b\x0c", _SPACE),
    (bytes(range(128, 256)), _HIGH),
):
    _CLASS[list(_chars)] = _kind


def statistics(text: str) -> tuple[float, ...]:
    """Transformed statistics of a whole text; additive terms pull short texts to common values."""
    kinds = _CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)]
    n = np.bincount(kinds, minlength=7)
    words = text.split()
    many, size = len(words), len(kinds)
    counts: dict[str, int] = {}
    for word in words:
        counts[word] = counts.get(word, 0) + 1
    space = np.concatenate(([True], kinds == _SPACE, [True]))
    symbol = kinds == _SYMBOL
    ends = int(np.count_nonzero(symbol & space[2:]))
    lone = int(np.count_nonzero(symbol & space[2:] & space[:-2]))
    repeats = sum(map(eq, words, islice(words, 1, None)))
    return (
        np.log1p(many),
        np.log((n[_UPPER] + 2) / (n[_LOWER] + 40)),
        np.log((n[_SYMBOL] + 0.5) / (size + 50)),
        np.log((repeats + 0.5) / (many + 20)),
        np.log((len(counts) + 20) / (many**0.8 + 20)),
        np.log((size - n[_SPACE] + 50) / (many + 10)),
        np.log((ends + 0.5) / (many + 20)),
        np.log((n[_DIGIT] + 2) / (size + 200)),
        np.log((n[_STOP] + 2) / (many + 20)),
        np.log((lone + 0.5) / (many + 20)),
        np.log((many + 20) / (text.count("\n") + 2)),
        np.log((max(counts.values(), default=0) + 2) / (many + 40)),
    )


def _measure(batches: Iterator[Columns]) -> Iterator[Columns]:
    for batch in batches:
        rows = [[float(v) for v in statistics(t)] for t in batch["text"]]
        yield {"doc_id": batch["doc_id"], "x": rows}


@dataclass(frozen=True)
class Discriminant:
    """Per class 0 and 1: log prior, mean, inverse Cholesky factor of the covariance, log determinant."""

    prior: tuple[float, float]
    mean: np.ndarray
    whitening: np.ndarray
    log_det: np.ndarray

    @staticmethod
    def fit(n: np.ndarray, total: np.ndarray, products: np.ndarray, to_pooled: float, to_diagonal: float):
        """From counts, sums and sums of products of each class; ``to_*`` are shrinkage weights."""
        if (n == 0).any():
            return Constant(float((n[1] + 1) / (n.sum() + 2)) if n.sum() else 0.5)
        mean = total / n[:, None]
        own = products / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (own * n[:, None, None]).sum(0) / n.sum()
        whitening, log_det = [], []
        for k in (0, 1):
            # A class with few rows leans more on the pooled covariance.
            weight = min(1.0, to_pooled + len(mean[k]) / (n[k] + len(mean[k])))
            cov = (1 - weight) * own[k] + weight * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(pooled))
            factor = np.linalg.cholesky(cov + 1e-6 * np.eye(len(cov)))
            whitening.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
        prior = np.log(n / n.sum())
        return Discriminant(
            (float(prior[0]), float(prior[1])), mean, np.array(whitening), np.array(log_det)
        )

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        density = [
            self.prior[k]
            - 0.5 * self.log_det[k]
            - 0.5 * (((x - self.mean[k]) @ self.whitening[k].T) ** 2).sum(1)
            for k in (0, 1)
        ]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500)))


@dataclass(frozen=True)
class Constant:
    """Where a class has no labelled row."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def fit(measured: DataFrame, labels: DataFrame, to_pooled: float, to_diagonal: float):
    """Sums of every labelled row of the learning folds, added up by Spark."""
    d = len(STATISTICS)
    x = [F.col("x")[i] for i in range(d)]
    found = (
        measured.where(fold("doc_id", FOLDS) != HELD_OUT)
        .join(
            labels.where(F.col("quality").isin(0, 1))
            .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
            .agg(F.min("quality").alias("_label")),
            "doc_id",
        )
        .groupBy("_label")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.array(*[F.sum(v) for v in x]).alias("total"),
            F.array(*[F.sum(x[i] * x[j]) for i in range(d) for j in range(i, d)]).alias("products"),
        )
        .collect()
    )
    n, total, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    upper = np.triu_indices(d)
    for row in found:
        k = int(row["_label"])
        n[k], total[k] = row["n"], row["total"]
        products[k][upper] = row["products"]
        products[k] = products[k] + np.triu(products[k], 1).T
    return Discriminant.fit(n, total, products, to_pooled, to_diagonal)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    to_pooled: float = 0.1,
    to_diagonal: float = 0.1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score, predicted.

    Labels are learnt from the folds of ``fold(doc_id, 5)`` other than 0; scores depend on
    the text alone.  NULL and empty texts have the statistics of an empty text.  Repeated
    rows are scored each; a NULL id matches no label and counts as held out.  Labels that
    are NULL or other than 0 and 1 are ignored, contradicting ones count as 0.  With no
    label at all the score is 0.5, with one class only it is that class's smoothed share.
    """
    measured = materialized(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
        ).transform(batchwise(_measure, "doc_id long, x array<double>"))
    )
    model = fit(measured, labels, to_pooled, to_diagonal)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.vstack(x.to_numpy())) if len(x) else [], dtype=float)

    return predicted(measured, score(F.col("x")), threshold, FOLDS, HELD_OUT)


def predicted(df: DataFrame, score: Column, threshold: float, folds: int, held_out: int) -> DataFrame:
    return df.select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        score.alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **weights: float
) -> DataFrame:
    """Documents that the classifier accepts, with their own columns and rows as they are.

    The model is fitted first; then one scan scores and filters, so texts are not shuffled.
    """
    measured = materialized(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
        .where(fold("doc_id", FOLDS) != HELD_OUT)
        .transform(batchwise(_measure, "doc_id long, x array<double>"))
    )
    model = fit(measured, labels, weights.get("to_pooled", 0.1), weights.get("to_diagonal", 0.1))

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in whole(text)], float)
        return pd.Series(model.score(x) >= threshold if len(x) else [], dtype=bool)

    return docs.where(good(text_or_empty("text")))
