"""Importance resampling, fill-in-middle and quality rules against brute force."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ROOT
from tests.llm.conftest import by_id
from tidemark.llm import fim, importance, rules
from tidemark.llm.common import read_table


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


ODD = ["<P>", "a<", "<<S", "S>x<", "x <M> y", "İstanbul 123 😀😀 a", "é" * 9, "abcdefgh", "abcdefg", "z" * 64,
       "\x00a\x00", "áb", "中文 text 中文", "-" * 17]


def test_fim_agrees_with_lists_of_units(spark, texts):
    rows = list(enumerate(ODD + texts)) + [(None, "null key"), (3, ODD[3]), (-7, "negative id")]
    made = fim.fim_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = []
    for k, t in rows:
        n, form, before, middle, output = fim.brute_force(k, t)
        want.append((k, n, form, before, middle, sha(output), sha(t or "")))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
    assert by_id(made, "n", "form", "prefix_chars", "middle_chars", "output_sha256",
                 "restored_sha256") == want


@pytest.mark.parametrize("rate, spm", [(0, 50), (100, 0), (100, 100)])
def test_fim_restores_all_forms(spark, texts, rate, spm):
    docs = spark.createDataFrame(list(enumerate(ODD + texts)), "doc_id long, text string")
    made = fim.fill_in_middle(docs, seed=9, rate=rate, spm=spm)
    back = made.select("text", "fim.form", fim.restored(F.col("fim.output"), F.col("fim.form")).alias("back"))
    assert all((r.text or "") == r.back for r in back.collect())
    forms = {r.form for r in back.collect()}
    assert forms == {"plain"} if rate == 0 else forms == {"plain", "spm" if spm else "psm"}


def test_fim_columns_long_text_and_empty_table(spark, docs, no_docs):
    odd = docs.select("doc_id", "text", F.lit(1).alias("fim"), F.lit(2).alias("__row"))
    made = fim.fill_in_middle(odd)
    assert made.columns == ["doc_id", "text", "fim", "__row"] or set(made.columns) == set(odd.columns)
    assert made.filter("fim.form is not null and __row = 2").count() == docs.count()
    assert fim.fim_report(no_docs).count() == 0
    long = spark.createDataFrame([(1, "word 中, " * 700_000)], "doc_id long, text string")
    row = fim.fim_report(long).first()
    n, form, before, middle, output = fim.brute_force(1, "word 中, " * 700_000)
    assert (row.n, row.form, row.prefix_chars, row.middle_chars, row.output_sha256) == (
        n, form, before, middle, sha(output))


def test_select_finds_every_mark():
    words = np.random.default_rng(3).integers(0, 256, 800, np.uint8).view("<u8")
    marks = fim.unit_ends(words)
    for word in marks.tolist():
        places = [k for k in range(8) if word >> (8 * k + 7) & 1]
        got = [int(fim.select_in_word(np.array([word], np.uint64), np.array([n + 1]))[0])
               for n in range(len(places))]
        assert got == places


def plain_resample(rows, benchmark, percent=5, min_words=20):
    raw, target = Counter(), Counter()
    grams = {i: importance.brute_grams(t) for i, (_, t) in enumerate(rows)}
    for g in grams.values():
        raw.update(zlib.crc32(x.encode()) % 10000 for x in g)
    for t in benchmark:
        target.update(zlib.crc32(x.encode()) % 10000 for x in importance.brute_grams(t))
    s_all, t_all = sum(raw.values()), sum(target.values())

    def gain(x):
        b = zlib.crc32(x.encode()) % 10000
        return math.floor(1000 * math.log(
            (target[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000))))

    out = []
    for i, (k, t) in enumerate(rows):
        weight = sum(map(gain, grams[i]))
        h = int(hashlib.sha256(f"42:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        words = len([g for g in grams[i] if " " not in g])
        out.append([k, len(grams[i]), weight, score, words >= min_words])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    ranks = {id(r): n + 1 for n, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in out]


def test_importance_agrees_with_brute_force(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts * 3)] + [(None, texts[6])]
    target = ["the river stone1 light2 " * 4, None, "", "Garden3 music garden3", texts[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = by_id(importance.importance_report(docs, items), "n_features", "weight", "score", "rank")
    want = sorted(plain_resample(rows, target), key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
    assert got == want
    assert sum(r[4] is not None for r in got) > 3


def test_importance_of_odd_tables(spark, docs, no_docs):
    items = spark.createDataFrame([], "text string")
    assert importance.importance_report(no_docs, items).count() == 0
    made = importance.importance_report(docs, items)
    assert made.count() == docs.count() and made.columns == [
        "doc_id", "n_features", "weight", "score", "rank"]
    few = docs.filter("length(text) < 10")
    assert importance.importance_report(few, docs).filter("rank is not null").count() == 0


def test_importance_ties_go_to_the_smaller_key(spark):
    frame = spark.range(400).selectExpr("399 - id as doc_id", "25L as n_words", "72L as n_features",
                                        "0L as weight", "5L as score").repartition(5)
    drawn = importance.draw(frame, percent=10).filter("rank is not null").orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in drawn] == [(k, k + 1) for k in range(40)]


@pytest.mark.parametrize("limit", [1, 2, 7, 1 << 17])
def test_tables_intern_every_gram_once(texts, limit):
    bodies = [(t or "").encode() for t in texts[:30]] + [b"x" * 700 + b" y " + b"x" * 700, b"q " * 50]
    grams = importance.Grams(bodies)
    seen = Counter()
    for of, starts, ends in grams.blocks(limit):
        table = importance.Table(grams, starts, ends)
        names = [grams.flat[a:b] for a, b in zip(starts, ends)]
        by_slot = {}
        for slot, name in zip(table.slot.tolist(), names):
            assert by_slot.setdefault(slot, name) == name
            assert table.bucket[slot] == zlib.crc32(name) % 10000
        assert len(by_slot) == len(set(names)) and table.count.sum() == len(names)
        seen.update(names)
    want = Counter(g.encode() for b in bodies for g in importance.brute_grams(b.decode()))
    assert seen == want


def test_equal_keys_of_different_grams_stay_apart(monkeypatch):
    monkeypatch.setattr(importance, "xxh64", lambda *a: np.zeros(len(a[2]), np.uint64))
    grams = importance.Grams([b"a b a b c abcdefghi abcdefghj a b"])
    (_, starts, ends), = grams.blocks()
    table = importance.Table(grams, starts, ends)
    names = [grams.flat[a:b] for a, b in zip(starts, ends)]
    assert len(set(table.slot.tolist())) == len(set(names))


RULE_TEXTS = ["a b c d e " * 2, "a b c d e a b c d", "one two three four five six", "x y " * 30 + "# $ | ok",
              "l1 a\nl1 a\n \n \nb\nl1 a", "a a a a a a", "p q r s t u v w x y z p q r s t k l m n o p q r s t",
              "中文 字　符 x y", "tab\tb\x0bc\x0cd\re\x1cf"]


def test_rule_counts_agree_with_brute_force(spark, texts):
    rows = list(enumerate(RULE_TEXTS + texts)) + [(None, RULE_TEXTS[0]), (0, RULE_TEXTS[0])]
    made = rules.rules_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = []
    for k, t in rows:
        n, chars, signs, lines, words = rules.brute_force(t)
        want.append((k, n, chars, signs, lines, words, n < 10 or 100 * words > 20 * n))
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
    assert by_id(made, *rules.COUNTS, "base_failed") == want
    assert made.filter("base_failed and kept").count() == 0


def test_em_finds_accuracies_and_keeps_good_documents(spark):
    docs, labels = read_table(spark, ROOT, "documents"), read_table(spark, ROOT, "labels")
    made = rules.rules_report(docs).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r.kept for r in made if r.quality == 1]
    bad = [r.kept for r in made if r.quality == 0]
    assert np.mean(good) >= 0.98 and (not bad or np.mean(bad) <= 0.2)


def plain_em(patterns, rounds):
    """The same model in plain Python over (votes, n)."""
    model = rules.LabelModel()
    for _ in range(rounds):
        sums = Counter()
        for votes, n in patterns:
            like = {c: model.share[c] * math.prod(
                1 if v == 0 else model.against[c, r] if v < 0 else 1 - model.against[c, r]
                for r, v in zip(rules.RULES, votes)) for c in rules.CLASSES}
            total = sum(like.values())
            for c in rules.CLASSES:
                w = n * like[c] / total
                sums[c] += w
                for r, v in zip(rules.RULES, votes):
                    sums[c, r, v] += w
        start, every = rules.LabelModel(), sum(n for _, n in patterns)
        against = {}
        for c in rules.CLASSES:
            for r in rules.RULES:
                yes, no = sums[c, r, -1], sums[c, r, 1]
                low, high = rules.BOUNDS[rules.role(c, r)]
                rate = (yes + start.against[c, r] * rules.PRIOR_VOTES) / (yes + no + rules.PRIOR_VOTES)
                against[c, r] = min(max(rate, low), high)
        model = rules.LabelModel(
            {c: (sums[c] + start.share[c] * rules.PRIOR_VOTES) / (every + rules.PRIOR_VOTES)
             for c in rules.CLASSES}, against)
    return model


def test_em_agrees_with_plain_python(spark, docs):
    narrow = rules.measured(docs.select("text")).select("measures")
    patterns = rules.patterns_of(narrow).cache()
    rows = [(list(r.votes), r.n) for r in patterns.collect()]
    assert sum(n for _, n in rows) == docs.count()
    got, want = rules.fit(patterns, rounds=4), plain_em(rows, 4)
    assert got.distance(want) < 1e-6
    patterns.unpersist()


def test_rules_keep_columns_and_take_empty_tables(spark, docs, no_docs):
    model = rules.learn(no_docs)
    assert model == rules.LabelModel()
    odd = docs.withColumn("rules", F.lit(1)).withColumn("measures", F.lit(2))
    made = rules.judged(odd, model)
    assert set(made.columns) == set(odd.columns) and made.filter("measures = 2").count() == docs.count()
    assert rules.rules_report(no_docs).count() == 0
    assert made.filter("rules.posterior between 0 and 1").count() == docs.count()
