"""Scalar tables for text, label and number functions."""

import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import labels as lb
from tidemark.functions import numeric as nu
from tidemark.functions import text as tx
from tidemark.operators import mining as mi
from tidemark.operators.annotation import parse_reply, validate_payload


def column(spark, values, fn, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_cleaner_order_and_unicode(spark):
    texts = ["ＨＴＴＰ://a.b/x 好", "说//@某人：转发 @小明 你好", "#话题#  真　棒 ",
             "這個國家 http://t.cn/@x", None, "[心] 保留", "a" * 600]
    assert column(spark, texts, tx.clean_text) == [
        "好", "说转发 你好", "话题 真 棒", "这个国家", "", "[心] 保留", "a" * 600]
    assert column(spark, texts[-1:], lambda c: tx.clean_text(c, tx.MAX_CHARS)) == ["a" * 512]
    assert column(spark, ["a" * 600], lambda c: tx.clean_text(c, None)) == ["a" * 600]


def test_legacy_cleaner(spark):
    texts = ["mail me@x.com now http://a.b/c?d @bob #tag#", None]
    assert column(spark, texts, tx.clean_text_legacy) == ["mail now /c?d #tag#", None]


def test_nfkc_matches_python_on_every_block(spark):
    texts = ["".join(chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000)
             for a in range(0, 0x30000, 256) if not 0xD800 <= a < 0xE000]
    got = column(spark, texts, tx.nfkc)
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


def test_default_keyword_buckets(spark):
    rows = [(1, "官方通报火灾事故，真的可怕", "post"), (2, "居然离谱", "comment"), (3, "今天吃饭", "post")]
    df = spark.createDataFrame(rows, "id int, content string, source string")
    out = {r["id"]: r for r in mi.add_buckets(df).withColumn(
        "score", mi.heuristic_score()).collect()}
    assert set(out) == {1, 2}
    assert out[1]["target_buckets"] == "fear,hard_negative"
    assert out[1]["matched_keywords"] == "fear:火灾|可怕|事故;hard_negative:objective_cue|可怕"
    assert out[2]["target_buckets"] == "surprise,anger_sad_boundary"
    assert out[2]["keyword_count"] == 3
    assert out[2]["score"] == 105 + 0 + 4 + 12


def test_quota_table():
    assert mi.quotas_for(7500) == {
        "fear": 2200, "surprise": 1800, "anger_sad_boundary": 2500, "hard_negative": 1000}
    for target in (4, 5, 7, 100, 6001, 7999):
        assert sum(mi.quotas_for(target).values()) == target


def test_levels_and_labels(spark):
    assert column(spark, [79.9, 80.0, 60.0, 40.0, 0.0], nu.risk_level, "double") == [
        "medium_high", "high", "medium_high", "medium", "low"]
    assert column(spark, [0.125, -0.03, 0.0, -0.001], nu.growth_label, "double") == [
        "+12%", "-3%", "+0%", "-0%"]
    assert column(spark, [12345, 230000000, 999], nu.compact_count, "bigint") == [
        "1.2万", "2.3亿", "999"]
    assert column(spark, ["nan", "inf", "x", None, "1.5"], nu.to_number) == [0, 0, 0, 0, 1.5]
    assert column(spark, ["开心", "愤怒", " 惊喜 ", "？", ""], lb.normalize_label) == [
        "积极", "愤怒", "惊讶", None, ""]
    assert nu.clamp_argument("99", 20, 50) == 50 and nu.clamp_argument("x", 20, 50) == 20
    assert nu.topic_argument("all") is None and nu.topic_argument("7") == 7


def test_search_folds_ascii_only(spark):
    assert column(spark, ["ABC é", "É"], lambda c: tx.contains_ignore_case("é", c)) == [
        True, False]
    assert column(spark, ["a'b%_", "ab"], lambda c: tx.contains_ignore_case("A'B%", c)) == [
        True, False]


def test_reply_validation(spark):
    replies = ['```json\n{"label": "生气", "second_label": "愤怒", "confidence": 0.8}\n```',
               'x {"label": "高兴", "confidence": "0.5", "needs_human_review": "no"} y',
               '{"label": "疯狂", "confidence": 0.9}', '{"label": "中性", "confidence": 2}', "none"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, reply string")
    out = validate_payload(parse_reply(df)).orderBy("i").collect()
    assert [r["label"] for r in out] == ["愤怒", "积极", None, "中性", None]
    assert out[0]["second_label"] == "" and out[0]["needs_human_review"] is False
    assert out[1]["needs_human_review"] is False
    assert [r["error"] for r in out] == [None, None, "label", "confidence", "label"]
