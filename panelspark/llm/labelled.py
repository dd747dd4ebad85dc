"""Bounded samples of labelled documents, and the logistic curve that turns a score into a probability."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `rows` labelled documents, those with the smallest hashes of doc_id.

    Rows of labels with a null id or label don't count; an id with several labels has the largest. The ids are few by
    construction and so are broadcast; of documents, only those with these ids are shuffled. Of rows that share an id, the
    text with the smallest hash is taken; texts that repeat are kept once.
    """
    ids = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    ids = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "doc_id")
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")
    found = found.groupBy("doc_id").agg(text, F.first("label").alias("label"))
    # By hash and label: so few rows that their order decides nothing but which id stands for a text, the smallest.
    return found.groupBy("least.hash", "label").agg(F.min(F.struct("doc_id", "least.text")).alias("one")).select("one.doc_id", "one.text", "label")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights of a logistic regression with an intercept, the last one, by Newton's method; x has a row per example."""
    x = np.column_stack([x, np.ones(len(x))]) if len(x) else np.zeros((0, x.shape[1] + 1))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
