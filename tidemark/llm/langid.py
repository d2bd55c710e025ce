"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte n-grams inside words; a linear softmax reads the
mean.  Both are trained by stochastic gradient descent in numpy on at most ``MAX_PER_LANG`` rows of
each language (the first by a hash of the id, outside the held-out fold) and at most ``MAX_ROWS`` rows,
shared evenly among languages; these bounds are the one documented sample.  Since the model is linear, scoring uses one row of class scores per slot.

A part of the sample is set aside to fit a temperature and the rejection limit: a low quantile of
the probability of its rightly named texts, at most one half, which does not fall as the sample grows.  Null texts and texts without
a letter get ``und`` with score 0 and are rejected.  With nothing to learn from, every text is
``und``.  Only lang values that were learned are predicted; ties go to the first in sorted order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import (fold_of, hash_place, map_batches, may_be_first, slices, stored,
                                 texts_of)
from tidemark.llm.features import subword_slots

BITS = 15
DIM = 12
MAX_PER_LANG = 1000
MAX_ROWS = 200_000
LIMIT_QUANTILE = 0.002
EPOCHS = 5
SLICE_BYTES = 1 << 18  # features take some hundred times the bytes of their texts
UNDEFINED = "und"
_ASCII_LETTER = re.compile(b"[A-Za-z]")


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # class scores of each slot
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def probabilities(self, texts: list[bytes], bits: int = BITS) -> np.ndarray:
        row, slot = subword_slots(texts, bits)
        counts = np.maximum(np.bincount(row, minlength=len(texts)), 1)
        sums = np.empty((len(texts), len(self.langs)))
        for k in range(len(self.langs)):
            sums[:, k] = np.bincount(row, self.table[:, k][slot], len(texts))
        return softmax((sums / counts[:, None] + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def training_rows(docs: DataFrame, per_lang: int, total: int = MAX_ROWS) -> DataFrame:
    """A bounded number of rows of each language, chosen by narrow rows before texts move.

    With many languages each gets ``total`` divided by their number.  Beyond ``total`` languages, those
    that come first by hash are learned.  Languages are counted in the map tasks and the counts
    sent to the rows, so rows are not shuffled by language before they are chosen.
    """
    usable = docs.filter((fold_of(F.col("doc_id")) != 1) & F.col("lang").isNotNull()
                         & F.col("text").isNotNull()).select(
        "doc_id", F.col("lang").cast("string").alias("__lang"), F.col("text").alias("__text"))
    narrow = usable.select("doc_id", "__lang")
    sizes = stored(narrow.groupBy("__lang").agg(F.count("*").alias("__rows")), "languages")
    bound = min(per_lang, max(1, total // max(sizes.count(), 1)))
    learned = sizes.orderBy(hash_place(F.col("__lang")), "__lang").limit(total)  # bounded
    order = Window.partitionBy("__lang").orderBy(hash_place(F.col("doc_id")), "doc_id")
    chosen = narrow.join(F.broadcast(learned), "__lang").filter(
        may_be_first(F.col("doc_id"), bound, F.col("__rows"))).withColumn(
        "__n", F.row_number().over(order)).filter(F.col("__n") <= bound).select(
        "doc_id", "__lang").distinct()
    return usable.join(F.broadcast(chosen), ["doc_id", "__lang"])


def train(docs: DataFrame, per_lang: int = MAX_PER_LANG, bits: int = BITS) -> Model:
    def featurise(batch: pa.RecordBatch):
        texts = texts_of(batch.column(2))
        row, slot = subword_slots(texts, bits)
        cut = np.searchsorted(row, np.arange(len(texts) + 1))
        slots, counts = [], []
        for a, b in zip(cut, cut[1:]):
            s, c = np.unique(slot[a:b], return_counts=True)
            slots.append(s.astype(np.int32).tobytes())
            counts.append(c.astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(slots, pa.binary()),
             pa.array(counts, pa.binary())], ["doc_id", "lang", "slots", "counts"])

    rows = training_rows(docs, per_lang).select("doc_id", "__lang", "__text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = map_batches(rows, featurise, f"doc_id {kind}, lang string, slots binary, counts binary"
                       ).toPandas().sort_values(["lang", "doc_id"], kind="stable")
    langs = sorted(made["lang"].unique())
    if not langs:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0))
    labels = made["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()
    samples = []
    for s, c in zip(made["slots"], made["counts"]):
        c = np.frombuffer(c, np.float32)
        samples.append((np.frombuffer(s, np.int32), c / max(float(c.sum()), 1.0)))
    return descend(samples, labels, langs, bits)


def descend(samples: list, labels: np.ndarray, langs: list[str], bits: int) -> Model:
    """Stochastic gradient descent, then calibration on every fifth row."""
    dice = np.random.default_rng(11)
    order = dice.permutation(len(samples))
    aside = order[::5] if len(samples) >= 50 else order[:0]
    rest = np.setdiff1d(order, aside)
    embed = dice.normal(0, 0.1, (1 << bits, DIM))
    out = np.zeros((DIM, len(langs)))
    bias = np.zeros(len(langs))
    weight = len(rest) / (len(langs) * np.maximum(np.bincount(labels[rest], minlength=len(langs)), 1))
    for epoch in range(EPOCHS):
        rate = 1.0 * (1 - epoch / EPOCHS)
        for i in dice.permutation(rest):
            slot, share = samples[i]
            mean = share @ embed[slot]
            g = softmax(mean @ out + bias)
            g[labels[i]] -= 1.0
            g *= min(weight[labels[i]], 5.0)
            back = out @ g
            out -= rate * np.outer(mean, g)
            bias -= rate * 0.1 * g
            embed[slot] -= rate * 5.0 * np.outer(share, back)
    model = Model(langs, embed @ out, bias)
    scores = np.array([samples[i][1] @ model.table[samples[i][0]] + bias for i in aside])
    if len(aside):
        truth = labels[aside]

        def loss(t):
            p = softmax(scores / t)[np.arange(len(truth)), truth]
            return -np.log(np.maximum(p, 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.5, 5.0, 40), key=loss))
        best = softmax(scores / model.temperature)
        right = best.argmax(axis=1) == truth
        if right.any():
            model.limit = float(min(0.5, np.quantile(best.max(axis=1)[right], LIMIT_QUANTILE)))
    return model


def judge(model: Model, texts: list[bytes], known: list[bool], bits: int = BITS
          ) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and rejection of every text."""
    if model.langs:
        p = model.probabilities(texts, bits)
        best = p.argmax(axis=1)
        top = p[np.arange(len(texts)), best]
    langs, scores, no = [], [], []
    for i, (body, there) in enumerate(zip(texts, known)):
        told = bool(model.langs) and there and has_letter(body)
        langs.append(model.langs[best[i]] if told else UNDEFINED)
        scores.append(float(top[i]) if told else 0.0)
        no.append(bool(not told or top[i] < model.limit))
    return langs, scores, no


def identify(docs: DataFrame, model: Model, bits: int = BITS, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def name(batch: pa.RecordBatch):
        column = batch.column(1)
        langs, scores, no = judge(shared.value, texts_of(column), column.is_valid().to_pylist(), bits)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
             pa.array(no, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return map_batches(docs.select("doc_id", F.col(f"`{text}`").alias("__text")), name,
                       f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def language_report(docs: DataFrame) -> DataFrame:
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"),
                        "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that the model does not reject, with their columns as they were.

    Only the texts meet Python; the other columns stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        kept: list[bool] = []
        for part in slices(pa.RecordBatch.from_arrays([text], ["text"]), SLICE_BYTES):
            column = part.column(0)
            kept += [not no for no in judge(shared.value, texts_of(column),
                                            column.is_valid().to_pylist())[2]]
        pa.default_memory_pool().release_unused()
        return pa.array(kept, pa.bool_())

    return docs.filter(accepted(F.col("text")))
