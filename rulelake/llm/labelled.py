"""Bounded training samples of labelled documents, and small model fits by Newton's method."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: rows of each class, and characters of text in all.
ROWS_PER_CLASS, SAMPLE_CHARS = 4_000, 64_000_000
FOLDS = 5


def fold(id_col: str) -> Column:
    """The crc32 of an id as text, modulo FOLDS; rows of fold 0 are held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", rows_per_class: int = ROWS_PER_CLASS, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """(text, label) of labelled rows outside fold 0, each text once: the rows of each class with the least id digests.

    Ids are chosen from the labels alone, so at most 2 * rows_per_class of them are sent to the scan of the documents.
    """
    known = labels.where(F.col(label).isin(0, 1) & (fold(id_col) != 0)).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.withColumn("rank", F.xxhash64("id", "label"))
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("rank", "id").limit(rows_per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.dropDuplicates(["id", "label", "text"]).orderBy("rank", "id", "text")  # a row that is repeated any number of times comes once
    sample, seen, total = [], set(), 0
    for row in rows.select("text", "label").toLocalIterator():
        text = row["text"] or ""
        if (key := (text, row["label"])) in seen:
            continue
        total += len(text)
        if total > chars:
            break
        seen.add(key)
        sample.append((text, row["label"]))
    return sample


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, intercept: bool, rounds: int = 30) -> np.ndarray:
    """Weights (the intercept last) of a ridge-penalised logistic fit by Newton's method; the intercept is free."""
    if intercept:
        x = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(x.shape[1], ridge)
    if intercept:
        penalty[-1] = 1e-6

    def sums(w):
        p = sigmoid(x @ w)
        return x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x

    return newton(sums, penalty, rounds)


def newton(sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], penalty: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights where a loss with a ridge penalty is least; ``sums`` gives the loss's gradient and curvature at weights."""
    w = np.zeros(len(penalty))
    for _ in range(rounds):
        gradient, curve = sums(w)
        step = np.linalg.solve(curve + np.diag(penalty), gradient + penalty * w)
        w -= step * min(1.0, 4.0 / (np.linalg.norm(step) + 1e-12))
        if np.linalg.norm(step) < 1e-8:
            break
    return w
