"""What the two classifiers share: the split of the documents, bounded labelled samples, and weighted logistic fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphflow.llm import runtime

#: Labelled rows of each class that a fit uses at most.
SAMPLE = 4000


def held_out(key: Column) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text leaves 1 by 3. A null id is never trained on."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, most: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """text and label of at most that many training rows of each class, and the weight of a row of each class.

    Rows are chosen by the hash of their id, so the choice doesn't depend on their order; a document with several labels
    counts with the largest, and one with several texts with each.
    """
    rows = labels.where(~held_out(labels[key])).groupBy(labels[key].alias("key")).agg(F.max(label).alias("label")).where("label in (0, 1)")
    rows = runtime.written(rows, "labelled")
    count = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for c in sorted(count):
        part = rows.where(F.col("label") == c).orderBy(F.xxhash64("key"), "key").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = rows
    chosen = runtime.written(chosen, "sample")  # 2 * most rows at most
    picked = docs.select(docs[key].alias("key"), runtime.utf8(docs[text]).alias("text")).join(F.broadcast(chosen), "key").select("key", "text", "label")
    return picked, {c: n / min(n, most) for c, n in count.items()}


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def lasso_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic fit, by accelerated proximal gradient."""
    weight = weight / weight.sum()
    scale = np.sqrt((weight[:, None] * (x - (weight[:, None] * x).sum(0)) ** 2).sum(0))
    used = scale > 1e-9
    z = np.where(used, x / np.where(used, scale, 1), 0)
    full = np.column_stack([z, np.ones(len(z))])
    step = 4 / max(np.linalg.eigvalsh((full * weight[:, None]).T @ full)[-1], 1e-9)
    w = v = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(steps):
        grad = full.T @ (weight * (sigmoid(full @ v) - y))
        new = v - step * grad
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return np.where(used, w[:-1] / np.where(used, scale, 1), 0), float(w[-1])
