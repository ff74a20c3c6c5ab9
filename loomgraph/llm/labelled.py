"""Labelled samples for the classifiers, and the logistic model that turns features into probabilities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.storage import stored

#: At most so many labelled documents teach a classifier, and of those the first whose texts make up so many bytes.
MOST_LABELLED, MOST_BYTES = 6000, 1 << 26


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts, labels and ids of at most `most` labelled documents that aren't held out, by hash of the id.

    Only this sample, of MOST_BYTES at most, is gathered, and only to fit; every document is scored. Of documents
    with equal texts that with the smallest id teaches, of several labels of one document the largest."""
    chosen = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    chosen = chosen.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("label")).groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen), "id").groupBy("text").agg(F.min_by("label", "id").alias("label"), F.min("id").alias("id"))
    rows = stored(rows.withColumn("bytes", F.octet_length("text").cast("long")), "labelled")
    # at most `most` rows are numbered, without their texts
    so_far = F.sum("bytes").over(Window.orderBy(F.xxhash64("id"), "id", "bytes"))
    fit = rows.select("id", "bytes").distinct().withColumn("total", so_far).where(F.col("total") <= MOST_BYTES).select("id", "bytes")
    rows = rows.join(F.broadcast(fit), ["id", "bytes"], "left_semi").select("id", "label", "text").collect()
    rows = sorted(rows, key=lambda r: (r.id, r.text))
    return [r.text for r in rows], np.array([r.label for r in rows], np.float64), np.array([r.id for r in rows], np.int64)


class Logistic:
    """Logistic regression on standardised features, by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-3
        for _ in range(50):
            p = self._sigmoid(z @ self.w)
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * self.w)
            self.w += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    @staticmethod
    def _sigmoid(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._sigmoid(self._design(x) @ self.w)
