"""Small models fitted on the driver to bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import text_or_empty, written
from marlstone.shipping import ship


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, where: Column | None = None) -> DataFrame:
    """(text, y) of at most per_class labelled documents of either class, chosen by a hash of doc_id."""
    ship(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).alias("y")).where("doc_id is not null")
    if where is not None:
        known = known.where(where)
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    few = written(chosen[0].union(chosen[1]).dropDuplicates(["doc_id"]), "chosen")  # at most 2 * per_class rows of two numbers
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")
    return written(texts.select("text", F.col("y").cast("double").alias("y")), "sample")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients, the last one the intercept, by Newton's method; y may be probabilities. The intercept is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    beta = np.zeros(x.shape[1])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (shrink * b * b).sum())

    now = loss(beta)
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        gradient = x.T @ (weight * (p - y)) + shrink * beta
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + np.diag(shrink), gradient)
        size = 1.0
        while loss(beta - size * step) > now and size > 1e-4:
            size /= 2
        beta = beta - size * step
        before, now = now, loss(beta)
        if before - now < 1e-9 * (1 + abs(before)):
            break
    return beta
