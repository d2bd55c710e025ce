"""Quality and language models: held-out accuracy, folds and odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tidemark.llm import langid, quality
from tidemark.llm.common import read_table
from tidemark.llm.features import subword_slots, word_ngrams


def fold(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 3


def test_quality_learns_from_its_fold_only(spark):
    docs, labels = read_table(spark, ROOT, "documents"), read_table(spark, ROOT, "labels")
    report = quality.quality_report(docs, labels)
    rows = {r.doc_id: r for r in report.collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (fold(k) == 1) and 0 <= r.score <= 1 and
               r.predicted == int(r.score >= 0.5) for k, r in rows.items())
    known = {r.doc_id: r.quality for r in labels.collect() if r.doc_id in rows}
    held = [(rows[k].predicted, q) for k, q in known.items() if rows[k].held_out]
    assert np.mean([p == q for p, q in held]) >= 0.85
    # labels, lang and source of held-out rows change nothing
    turned = labels.withColumn("quality", F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")
    ).otherwise(F.col("quality")))
    again = quality.quality_report(docs.drop("lang", "source"), turned)
    assert {r.doc_id: r.score for r in again.collect()} == {k: r.score for k, r in rows.items()}


def test_quality_of_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1), (0, 1), (2, 0), (3, None), (None, 1), (4, 9), (999, 1)],
                                   "doc_id long, quality int")
    assert quality.quality_report(docs, labels).filter("score between 0 and 1").count() == docs.count()
    nothing = quality.quality_report(docs, labels.limit(0))
    assert nothing.select("score").distinct().collect()[0][0] == 0.5
    assert quality.quality_report(no_docs, labels).count() == 0


def test_language_held_out(spark):
    docs = read_table(spark, ROOT, "documents")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (fold(r.doc_id) == 1) for r in rows)
    assert np.mean([r.lang_pred == r.lang for r in held]) >= 0.95
    # clean documents stay
    assert np.mean([r.rejected for r in rows]) <= 0.01


def test_language_of_odd_rows(spark, docs, no_docs):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "½²"), (5, "the river"), (6, "東京"), (7, "_")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model = langid.train(read_table(spark, ROOT, "documents"))
    got = {r.doc_id: r for r in langid.identify(frame, model).collect()}
    assert [k for k, r in got.items() if r.lang_pred == "und"] == [1, 2, 3, 4, 7]
    assert all(r.rejected and r.score == 0 for k, r in got.items() if k in (1, 2, 3, 4, 7))
    assert langid.language_report(docs).count() == docs.count()
    assert langid.language_report(no_docs).count() == 0
    unlearned = langid.language_report(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unlearned.filter("lang_pred <> 'und' or score <> 0").count() == 0
    assert langid.keep_identified(docs).columns == docs.columns


@pytest.mark.parametrize("texts", [[], [b""], [b"", b"one", b"One one two"], [b"x"] * 3])
def test_features_stay_in_their_text(texts):
    row, slot, weight = word_ngrams(texts, 16)
    for k, text in enumerate(texts):
        mine = row == k
        alone = word_ngrams([text], 16)
        assert np.array_equal(slot[mine], alone[1]) and np.allclose(weight[mine], alone[2])
    row, slot = subword_slots(texts, 12)
    for k, text in enumerate(texts):
        assert np.array_equal(slot[row == k], subword_slots([text], 12)[1])
