"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader.

Learning reads only labelled rows outside the held-out fold (crc32 of the id as text, modulo 3,
is 1), and of them at most ``MAX_ROWS``, the first by a hash of the id; that bound is the one
documented sample.  Scoring reads every whole text and is a sparse dot product.

Null and empty texts are scored by the bias alone.  Labels that are null or neither 0 nor 1 and
rows without a label teach nothing; repeated labels of a document count once.  With no usable
label every score is 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold_of, hash_place, map_batches, may_be_first, texts_of
from tidemark.llm.features import word_ngrams

BITS = 18
MAX_ROWS = 6000
EPOCHS = 4


@dataclass
class Leader:
    """Follow-the-regularised-leader state: z and n per slot, weights on demand."""

    bits: int = BITS
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05

    def __post_init__(self):
        self.z = np.zeros((1 << self.bits) + 1)
        self.n = np.zeros((1 << self.bits) + 1)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        p = sigmoid(w @ values)
        g = (p - label) * values
        grown = self.n[slots] + g * g
        self.z[slots] += g - (np.sqrt(grown) - np.sqrt(self.n[slots])) / self.alpha * w
        self.n[slots] = grown


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    known = labels.filter(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.max("quality").cast("int").alias("__label"))
    usable = known.filter(fold_of(F.col("doc_id")) != 1)
    chosen = usable.filter(may_be_first(F.col("doc_id"), limit, F.lit(max(usable.count(), 1)))
                           ).orderBy(hash_place(F.col("doc_id")), "doc_id").limit(limit)
    # at most ``limit`` rows of two numbers
    return docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS, bits: int = BITS,
          epochs: int = EPOCHS) -> np.ndarray:
    """Weights of the slots, the bias last.  The features are made by the executors."""
    def featurise(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        row, slot, value = word_ngrams(texts, bits)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2),
             pa.array([slot[a:b].astype(np.int32).tobytes() for a, b in zip(cut, cut[1:])]),
             pa.array([value[a:b].astype(np.float32).tobytes() for a, b in zip(cut, cut[1:])])],
            ["doc_id", "label", "slots", "values"])

    rows = training_rows(docs, labels, limit)
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = map_batches(rows, featurise,
                       f"doc_id {kind}, label int, slots binary, values binary").toPandas()
    leader = Leader(bits)
    if not len(made):
        return leader.weights()
    made = made.sort_values(["doc_id", "label"], kind="stable")
    labels_seen = made["label"].to_numpy()
    samples = [(np.append(np.frombuffer(s, np.int32), 1 << bits),
                np.append(np.frombuffer(v, np.float32), 1.0)) for s, v in
               zip(made["slots"], made["values"])]
    dice = np.random.default_rng(7)
    for _ in range(epochs):
        for i in dice.permutation(len(samples)):
            leader.learn(*samples[i], int(labels_seen[i]))
    return leader.weights()


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS) -> DataFrame:
    """(doc_id, score): the probability of label 1 for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        row, slot, value = word_ngrams(texts, bits)
        w = shared.value
        margin = np.bincount(row, w[slot] * value, len(texts)) + w[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sigmoid(margin))], ["doc_id", "score"])

    narrow = docs.select("doc_id", F.col("text").alias("__text"))
    return map_batches(narrow, rate, f"doc_id {kind}, score double")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels)).select(
        "doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
