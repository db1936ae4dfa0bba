"""Bounded samples of labelled documents, and small models fitted on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def remainder(folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def sampled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents, chosen by a hash of their id: doc_id, text, label 0 or 1.

    An id with several labels is positive if one of them is. Null ids and null labels teach nothing.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    own = own.where(remainder(folds) != held).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(own.withColumnRenamed("doc_id", "id2")), F.col("doc_id") == F.col("id2")).select("doc_id", "text", "label")  # at most ``rows`` ids


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias, by Newton steps; a fixed ridge keeps them finite."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
