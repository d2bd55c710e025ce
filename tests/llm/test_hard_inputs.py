"""Inputs made to break operators: texts with equal polynomial hashes, clashing column names,
many languages, very long words."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import ROOT
from tests.llm.conftest import sentence
from tidemark.llm import bpe, decontaminate, jaccard_join, langid, line_dedup, suffix_dedup
from tidemark.llm.common import free_name, packed, range_hashes, read_table, unpacked


def thue_morse(n: int, a: str = "a", b: str = "b") -> str:
    return "".join(b if k.bit_count() & 1 else a for k in range(n))


WORD, OTHER = thue_morse(2048), thue_morse(2048, "b", "a")


def test_range_hashes_are_xxhash64(texts):
    data = "".join(t or "" for t in texts[:40]).encode() + (WORD + OTHER).encode()
    dice = np.random.default_rng(1)
    starts = dice.integers(0, len(data), 4000)
    ends = np.minimum(starts + dice.integers(0, 70, 4000), len(data))
    for seed in (0, bpe.SECOND_SEED):
        got = range_hashes(np.frombuffer(data, np.uint8), starts, ends, seed).tolist()
        assert got == [xxhash.xxh64_intdigest(data[a:b], seed) for a, b in zip(starts, ends)]


def test_encoding_tells_thue_morse_words_apart(spark):
    rows = [(1, WORD), (2, WORD), (3, OTHER), (4, WORD + " " + OTHER), (5, "x" * 70 + " " + "x" * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    plain = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                              special_tokens={})
    got = {r.doc_id: r for r in bpe.token_report(docs, path, public_tokenizers.PATTERN).collect()}
    for key, text in rows:
        ids = plain.encode(text)
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_joins_tell_thue_morse_words_apart(spark):
    rows = [(1, f"w1 w2 w3 w4 {WORD}"), (2, f"w1 w2 w3 w4 {OTHER}"), (3, f"W1 w2 w3 w4 {WORD}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_report(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


@pytest.mark.parametrize("width", [200, 199])
def test_byte_strings_tell_thue_morse_words_apart(spark, width):
    """Ranges of up to 200 bytes are hashed there, so strings of 200 bytes from both words."""
    words = [WORD[k:k + width] for k in (0, 256)] + [OTHER[k:k + width] for k in (0, 256)]
    rows = [(k, f"{k:03d}" * 5 + w + f"{k:04d}" * 5) for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.repeat_report(docs).collect()}
    bodies = {k: t.encode() for k, t in rows}
    seen = {}
    for k, b in bodies.items():
        for p in range(len(b) - 199):
            seen.setdefault(b[p:p + 200], []).append((k, p))
    hit = {k: set() for k in bodies}
    for places in seen.values():
        if len(places) > 1:
            for k, p in places:
                hit[k].update(range(p, p + 200))
    assert got == {k: len(v) for k, v in hit.items()}


ODD_NAMES = {"__row": 1, "__starts": 2, "__rest": 3, "__n_lines": 4, "__n_removed": 5, "__key": 6,
             "__text": 7, "__lang": 8, "__lang_pred": 9, "label": 10, "a.b": 11, "sid": 12, "hub": 13}


@pytest.fixture(scope="module")
def odd(docs):
    return docs.select("doc_id", "text", "lang", "source", "n_chars", *[
        F.lit(v).alias(n) for n, v in ODD_NAMES.items()])


def kept_as_they_were(made, odd):
    assert made.columns[:len(odd.columns)] == odd.columns
    fit = F.lit(True)
    for name, value in ODD_NAMES.items():
        fit = fit & (F.col(f"`{name}`") == value)
    assert made.filter(~fit).count() == 0


def test_columns_of_any_name_pass_through_stages(spark, odd):
    counts = line_dedup.count_names(odd)
    assert counts == ("___n_lines", "___n_removed")
    lines = line_dedup.dedup_lines(odd)
    assert lines.columns == [*odd.columns, *counts] and lines.count() == odd.count()
    kept_as_they_were(lines, odd)
    items = spark.createDataFrame([("i", "silver mountain"), ("j", "W1 w2")], "item_id string, text string")
    for block in (1, 1 << 20):
        kept_as_they_were(decontaminate.decontaminate(odd, items, block), odd)
    kept_as_they_were(jaccard_join.one_per_group(odd), odd)
    staged = corpus_pipeline.lines(spark, odd, ROOT)
    assert staged.columns == odd.columns
    kept_as_they_were(langid.keep_identified(odd), odd)


def test_blocks_and_one_pass_keep_the_same_documents(spark, docs):
    rows = [(str(k), t) for k, t in enumerate(["river12 stone3", "the the", "a b c d", "東京"])]
    items = spark.createDataFrame(rows + [("z", r[0]) for r in docs.select("text").limit(3).collect()],
                                  "item_id string, text string")
    one, many = (sorted((r.doc_id or -1, r.text or "") for r in decontaminate.decontaminate(
        docs, items, b).collect()) for b in (1 << 20, 1))
    assert one == many and len(one) < docs.count()


def test_packing_is_undone(odd):
    back = unpacked(packed(odd, "doc_id", "text"), odd, "doc_id", "text")
    assert back.columns == odd.columns and back.schema == odd.schema
    assert free_name("Ab", ["_ab", "aB"]) == "__Ab"


def test_many_languages_share_the_sample(spark):
    rows = [(k, f"w{k % 300} word{k % 300}", f"l{k % 300:03d}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    chosen = langid.training_rows(docs, 1000, total=600).groupBy("__lang").count().collect()
    assert len(chosen) == 300 and max(r["count"] for r in chosen) <= 2
    few = langid.training_rows(docs, 1000, total=100).select("__lang").distinct()
    first, again = sorted(r[0] for r in few.collect()), sorted(r[0] for r in few.collect())
    assert first == again and len(first) == 100
    assert len(langid.train(docs).langs) == 300
    plan = langid.training_rows(docs, 1000)._jdf.queryExecution().toString()
    assert "SortMergeJoin" not in plan.split("== Physical Plan ==")[1]


def test_a_language_that_was_not_learned_is_mostly_rejected(spark):
    model = langid.train(read_table(spark, ROOT, "documents"))
    rows = [(1, "Это совсем другой язык, которого модель не видела никогда"),
            (2, "これはモデルが一度も見たことのない言語です"), (3, "xqzk vvwq jjkx qqzx zzkq")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.rejected for r in langid.identify(frame, model).collect()) >= 2


def test_language_model_is_repeatable_and_limit_is_a_quantile():
    dice = __import__("random").Random(2)
    texts = [(sentence(dice, 30), 0) if k % 2 else ("der die das und ist nicht " * 4, 1) for k in range(120)]
    from tidemark.llm.features import subword_slots
    samples = []
    for text, _ in texts:
        _, slot = subword_slots([text.encode()], langid.BITS)
        s, c = np.unique(slot, return_counts=True)
        samples.append((s, c / c.sum()))
    labels = np.array([y for _, y in texts])
    one, two = (langid.descend(samples, labels, ["a", "b"], langid.BITS) for _ in range(2))
    assert np.array_equal(one.table, two.table) and 0 < one.limit <= 0.5
