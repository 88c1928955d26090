"""Bounded samples of labelled texts for fitting, and the calibration that the classifiers share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, at most.
ROWS_PER_CLASS = 1500
#: Of a sampled text of more code points, so many windows of so many code points, evenly spaced, are fitted on, so the
#: sample is bounded whatever the texts' lengths. Texts are scored whole.
WINDOWS, WINDOW = 16, 4096
#: The share of label 1 that scores are calibrated for. Fixed, so that they move neither with the table's size, which
#: decides how far a sample evens out the classes, nor with how many labels of each kind were collected.
REFERENCE_SHARE = 0.5
#: Labels with crc32(doc_id as text) mod FOLDS = 0 are never learnt from.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


@dataclass(frozen=True)
class Sample:
    """rows: doc_id, text and y; share: of label 1 among all the labelled rows that rows were drawn from (None: no rows)."""

    rows: pd.DataFrame
    share: float | None


def excerpt(text: Column) -> Column:
    """The whole text, or of a longer one WINDOWS windows, the first and the last included."""
    step = (F.char_length(text) - WINDOW) / (WINDOWS - 1)
    windows = [F.substr(text, (step * k).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS)]
    return F.when(F.char_length(text) <= WINDOWS * WINDOW, text).otherwise(F.concat(*windows))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = ROWS_PER_CLASS) -> Sample:
    """At most per_class labelled rows a class, in the order of a hash of doc_id, and the true share of label 1.

    Rows without an id, a label or a text, and ids with both labels, are not used. Ids are chosen from the
    labels alone; the texts come by one pass over docs.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("z")).where("y = z").select("doc_id", "y")
    order = F.xxhash64("doc_id")
    ids = [r for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).collect()]
    if not ids:
        return Sample(pd.DataFrame({"doc_id": [], "text": [], "y": []}), None)
    share = known.agg(F.avg("y")).first()[0]
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")  # at most 2 * per_class rows
    texts = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return Sample(texts.select("doc_id", excerpt(F.col("text")).alias("text"), "y").toPandas().sort_values("doc_id", ignore_index=True), share)


def shift(y: np.ndarray, share: float = REFERENCE_SHARE) -> float:
    """What the intercept of a model fitted on labels y lacks for that share of label 1: the difference of log-odds."""
    if not 0 < y.sum() < len(y):
        return 0.0
    return float(np.log(share / (1 - share)) - np.log(y.sum() / (len(y) - y.sum())))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, intercept last; x is dense with few columns.

    Targets are Platt's smoothed ones, so that separable rows keep finite weights.
    """
    x = np.column_stack([x, np.ones(len(x))])
    pos, neg = y.sum(), len(y) - y.sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (p - t) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step * min(1.0, 10 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
