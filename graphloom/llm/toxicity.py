"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of words, pairs of neighbours and pairs around one word. Training
goes through a bounded sample of labelled rows, one document at a time, with a learning rate for each
coordinate and an L1 threshold that leaves most weights at zero; what is not zero is sent to the
executors, which score whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import WordHash, bound_batches, fold, mix64, per_row, table, texts, to_arrow

BITS = 20
SAMPLE_ROWS = 12_000  # labelled rows that are learnt from, at most: those with the smallest hashed ids
EPOCHS = 8
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
#: A-Z to a-z, other ASCII but digits and a-z to a space.
TOKEN_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

_hash = WordHash()


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Indexes of the text's n-grams and skip-grams, with repeats; 0 is the bias and in every text."""
    h = _hash.of(text.translate(TOKEN_TABLE).split())
    parts = [mix64(h), mix64(h[:-1] * _PAIR + h[1:]), mix64(h[:-2] * _SKIP + h[2:] + np.uint64(1))]
    found = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)
    return np.append(found[found > 0], np.int32(0))


class Ftrl:
    """Per-coordinate FTRL-proximal."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        """``at``: distinct indexes."""
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        was = self.n[at]
        self.n[at] = was + g * g
        self.z[at] += g - (np.sqrt(was + g * g) - np.sqrt(was)) / self.alpha * w


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -500.0), 500.0)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights as pairs (index, weight), sorted by index. ``docs``: id, text; ``labels``: id, label, of training rows only.

    A null label is no label. An id with several labels or texts counts with each of them. No labels: no weights.
    """
    bound_batches(docs.sparkSession)
    order = F.xxhash64(F.lit(17), F.col("id"))
    sample = labels.filter(F.col("label").isNotNull() & F.col("id").isNotNull()).withColumn("o", order).orderBy("o", "id", "label").limit(sample_rows)
    rows = docs.join(F.broadcast(sample), "id").select("o", "label", "text").repartition(1).sortWithinPartitions("o", "label", "text")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = [(np.unique(features(t, bits)), int(y > 0)) for b in batches for t, y in zip(texts(b), b.column("label").to_pylist(), strict=True)]
        model = Ftrl(bits)
        for e in range(epochs):
            for i in np.random.default_rng(e).permutation(len(data)):
                model.learn(*data[i])
        w = model.weights()
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_pydict({"at": at.astype(np.int32), "w": w[at]}, schema=arrow)

    arrow = to_arrow(docs.sparkSession, "at int, w double")
    found = rows.mapInArrow(train, "at int, w double").toPandas().sort_values("at")
    return np.rec.fromarrays([found["at"].to_numpy(np.int32), found["w"].to_numpy(np.float64)], names="at,w")


def score(docs: DataFrame, model: np.ndarray, bits: int = BITS) -> DataFrame:
    """id, score, predicted for each row; null and empty texts have the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast((model.at.tobytes(), model.w.tobytes()))
    dense: list[np.ndarray] = []

    def run(b: pa.RecordBatch) -> dict:
        if not dense:
            dense.append(np.zeros(1 << bits))
            dense[0][np.frombuffer(sent.value[0], np.int32)] = np.frombuffer(sent.value[1])
        w, scores = dense[0], []
        for t in texts(b):
            at = features(t, bits)
            scores.append(float(sigmoid(w[np.unique(at[w[at] != 0])].sum())))
        return {"id": b.column("id"), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return per_row(docs, run, "id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, held_out: int = 0) -> DataFrame:
    """id, held_out, score, predicted for each row. Labels of the held-out fold are never read; null ids are scored and not learnt from."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).filter(fold(F.col("id"), folds) != held_out)
    out = score(rows, fit(rows, known))
    return out.select(F.col("id").alias(id_col), (fold(F.col("id"), folds) == held_out).alias("held_out"), "score", "predicted")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
