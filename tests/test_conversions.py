"""Phrases, VARIANT columns, keyset reads, month folders, digests as keys, confusions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import phrases as ph
from tidemark.functions import variants as vr
from tidemark.operators import evaluation as ev
from tidemark.operators import quality as q
from tidemark.sources import io, tables
from tidemark.sources.keyset import even_ranges


# -------------------------------------------------------------------------- phrases
def plain_convert(text, table):
    longest = max(map(len, table))
    out, k = [], 0
    while k < len(text):
        for n in range(min(longest, len(text) - k), 0, -1):
            if text[k:k + n] in table:
                out.append(table[text[k:k + n]])
                k += n
                break
        else:
            out.append(text[k])
            k += 1
    return "".join(out)


def test_longest_phrases_win_from_the_left(spark):
    table = {"頭": "头", "髮": "发", "發": "发", "頭髮": "头发", "頭髮絲兒": "头发丝儿", "a": "1", "ab": "2", "abcd": "3",
             "^": "caret", "]": "[", "\\": "/", "-": "~", "😀": "smile", "x.y": "dot"}
    dice = random.Random(4)
    texts = ["頭髮絲", "頭髮絲兒頭", "abc", "abcd", "aab", "", None, "none", "^]-\\", "😀ab", "x.y xzy", "頭" * 5000]
    texts += ["".join(dice.choice("頭髮絲兒abcd發^]x.y ") for _ in range(40)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(3)
    got = {r.id: r.content for r in ph.convert_frame(df, table).collect()}
    assert got == {k: None if t is None else plain_convert(t, table) for k, t in enumerate(texts)}
    assert ph.convert_frame(df, {}).collect() == df.collect()


def test_trie_pattern_shares_beginnings():
    assert ph.trie_pattern(["ab", "ac", "b"]) == "(?:a[bc]|b)"
    words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)]
    assert ph.trie_pattern(words) == "[ab](?:[ab](?:[ab])?)?" or len(ph.trie_pattern(words)) < 80


def test_dictionaries_are_read_from_files(spark, tmp_path):
    (tmp_path / "one.txt").write_text("頭髮\t头发 頭发\n髮\t发\nbroken line\n\t\n", encoding="utf-8")
    (tmp_path / "two.txt").write_text("髮\t发\n髮\t髪\n", encoding="utf-8")
    assert ph.read_phrases(spark, [str(tmp_path / "one.txt"), str(tmp_path / "two.txt")]) == {
        "頭髮": "头发", "髮": "发"}


def test_too_large_dictionaries_are_refused(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ph, "MOST_PHRASES", 2)
    (tmp_path / "d.txt").write_text("a\tb\nb\tc\nc\td\n")
    with pytest.raises(ValueError, match="more than 2"):
        ph.read_phrases(spark, str(tmp_path / "d.txt"))


# --------------------------------------------------------------------------- variant
def test_json_is_parsed_once_and_types_are_kept(spark):
    rows = [(1, '{"a": 1, "b": [1, "x", null], "o": {"p": 2.5}}'), (2, '{"a": "1"}'), (3, "no json"),
            (4, None), (5, '{"a": null, "b": {}}'), (6, '{"a": true, "b": []}'), (7, '[1]')]
    df = spark.createDataFrame(rows, "id long, raw string").withColumn("_variant", F.lit("kept"))
    made = vr.add_paths(df, "raw", {"n": ("$.a", "bigint"), "s": ("$.a", "string"), "p": ("$.o.p", "double"),
                                    "x": ("$.b[1]", "string")}, {"kind": "$.a", "b": "$.b"}, {"size": "$.b"})
    got = {r.id: (r.n, r.s, r.p, r.x, r.kind, r.b, r["size"]) for r in made.collect()}
    assert got[1] == (1, "1", 2.5, "x", "number", "array", 3)
    assert got[2][1] == "1" and got[2][4] == "string"
    assert got[3] == got[4] == (None, None, None, None, "null", "null", None)
    assert got[5][4:] == ("null", "object", None) and got[6][1] == "true" and got[6][6] == 0
    assert made.filter("_variant = 'kept'").count() == len(rows)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 2  # one call, named twice
    mixed = vr.stringify_json(df.select("id", "raw"), "raw", ["a"])
    assert [r.a for r in mixed.orderBy("id").collect()] == ["1", "1", None, None, None, "true", None]


# ---------------------------------------------------------------------------- keyset
def test_ranges_cover_all_keys_once():
    for after, upto, parts in ((-1, 99, 8), (5, 6, 8), (7, 7, 3), (-(1 << 40), 1 << 40, 5)):
        found = even_ranges(after, upto, parts)
        assert all(a.upto == b.after for a, b in zip(found, found[1:]))
        assert not found and upto <= after or (found[0].after, found[-1].upto) == (after, upto)


def test_keyset_batches_and_restarted_streams(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("table", "out", "state"))
    spark.range(100, 1100).withColumn("v", F.col("id") * 2).repartition(3).write.parquet(path)
    schema = "id long, v long"
    batch = io.read_keyset(spark, path, "id", schema, after=149, upto=899, partitions=4)
    assert batch.rdd.getNumPartitions() == 4
    assert sorted(r.id for r in batch.collect()) == list(range(150, 900))
    assert io.read_keyset(spark, path, "id", "v long").agg(F.sum("v")).first()[0] == sum(
        2 * k for k in range(100, 1100))

    def pull():
        io.read_keyset(spark, path, "id", schema, stream=True).writeStream.format("parquet").option(
            "path", out).option("checkpointLocation", state).trigger(
            availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    assert pull() == list(range(100, 1100))
    assert pull() == list(range(100, 1100))  # nothing new, nothing repeated
    spark.range(1100, 1130).withColumn("v", F.col("id") * 2).write.mode("append").parquet(path)
    assert pull() == list(range(100, 1130))


# ----------------------------------------------------------------------------- month
def test_dates_prune_month_folders(spark, tmp_path):
    path, days = str(tmp_path / "facts"), str(tmp_path / "days")
    facts = spark.range(3000).selectExpr("id", "timestamp_ntz '2024-01-01' + make_dt_interval(cast(id % 400 as int)) at")
    tables.write_by_month(facts.union(spark.sql("select 9999L, cast(null as timestamp_ntz)")), path, "at")
    spark.range(400).selectExpr("date '2024-01-01' + cast(id as int) day", "id % 31 k").write.parquet(days)
    wanted = spark.read.parquet(days).filter("k = 3 and month(day) = 5")
    found = tables.rows_of_dates(spark.read.parquet(path), wanted, "at")
    ids = {r.id for r in found.collect()}
    dates = {r.day for r in wanted.collect()}
    assert ids == {r.id for r in facts.collect() if r["at"].date() in dates} and ids
    assert found.columns == ["id", "at", "month"]
    assert "dynamicpruning" in found._jdf.queryExecution().toString().lower()


# --------------------------------------------------------------------------- digests
def test_forced_collisions_keep_different_texts(spark):
    rows = [(3, "a", "train"), (1, "a", "train"), (2, "b", "train"), (4, "b", "eval"), (5, "c", "test"),
            (6, "c", "test"), (7, "d", "train")]
    df = spark.createDataFrame(rows, "id long, content string, split string").repartition(3)
    same = lambda c: F.lit("x")

    def ids(frame):
        return sorted(r.id for r in frame.collect())
    assert ids(q.dedupe_content(df, "id", digest=same)) == ids(q.dedupe_content(df, "id")) == [1, 2, 5, 7]
    assert ids(q.dedupe_content(df, "id", ("split",), same)) == [1, 2, 4, 5, 7]
    assert ids(q.clean_splits(df, digest=same)) == ids(q.clean_splits(df)) == [1, 4, 5, 7]
    for made in (q.dedupe_content(df), q.clean_splits(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        for line in plan.splitlines():
            if "hashpartitioning" in line or "Sort [" in line:
                assert "content" not in line.split("hashpartitioning")[-1]
    assert q.dedupe_content(df).columns == df.columns


def test_unknown_labels_fail_or_are_dropped(spark):
    df = spark.createDataFrame([(1, "x", "happy"), (2, "y", "joyful?"), (3, "z", None)],
                               "id long, content string, label string")
    assert [r.id for r in q.clean_frame(df, unknown="drop").collect()] in ([1], [])
    with pytest.raises(ValueError):
        q.clean_frame(df, unknown="keep")


# ------------------------------------------------------------------------- confusions
def test_worst_confusions_and_absent_reports(spark):
    grid = [[5, 2, 0, 0, 0, 0], [2, 9, 4, 0, 0, 0], [0, 0, 0, 0, 0, 1]] + [[0] * 6] * 3
    rows = [("one", 23, 0.5, 0.4, [0.1] * 6, grid), ("none", None, None, None, None, None),
            ("right", 1, 1.0, 1.0, [1.0] * 6, [[1] + [0] * 5] + [[0] * 6] * 5)]
    reports = spark.createDataFrame(rows, "name string, samples long, accuracy double, macro_f1 double, "
                                    "per_class_f1 array<double>, confusion_matrix array<array<bigint>>")
    got = {r.name: r for r in ev.quality_payload(reports, reports.select("name")).collect()}
    names = [ev.LABELS[k] for k in range(6)]
    assert [tuple(c) for c in got["one"].top_confusions] == [
        (names[1], names[2], 4), (names[0], names[1], 2), (names[1], names[0], 2)]
    assert got["right"].top_confusions == [] and got["none"].top_confusions is None
    cells = ev.confusion_table(reports).collect()
    assert len(cells) == 72 and sum(c.n for c in cells) == 24
    assert {c.share for c in cells if c.name == "one" and c.true_label == names[0]} == {0.7143, 0.2857, 0.0}
