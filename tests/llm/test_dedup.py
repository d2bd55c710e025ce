"""Line, exact, near and byte-string dedup against brute force."""

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tests.llm.conftest import by_id, sentence
from tidemark.llm import exact_stream, jaccard_join, line_dedup, suffix_dedup


def unique_ids(docs):
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id"])


def in_duckdb(docs, sql):
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    with duckdb.connect() as db:
        db.register("documents", documents)
        return db.execute(sql).fetchall()


def test_lines_agree_with_sql(docs):
    plain = unique_ids(docs)
    got = by_id(line_dedup.line_report(plain), "n_lines", "n_removed", "kept_sha256")
    assert got == sorted(in_duckdb(plain, line_dedup.LINE_SQL))


def test_lines_keep_columns_and_odd_rows(docs, no_docs):
    done = line_dedup.dedup_lines(docs)
    assert done.columns == [*docs.columns, "__n_lines", "__n_removed"]
    assert done.count() == docs.count()
    assert done.filter("text is null").count() == docs.filter("text is null").count()
    assert line_dedup.line_report(no_docs).count() == 0


def test_later_passages_lose_their_lines(spark):
    rows = [(1, "a\nb\nc\nx"), (2, "y\na\nb\nc\nd"), (3, "a\nb"), (4, "q\nq\nq\nq\nq")]
    done = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in done.collect()} == {
        1: "a\nb\nc\nx", 2: "y\nd", 3: "a\nb", 4: "q"}


def test_exact_agrees_with_sql(docs):
    plain = unique_ids(docs)
    got = by_id(exact_stream.dedup_stream(plain), "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(in_duckdb(plain, """
        with g as (%s) select doc_id, keep_id, group_size, kept, text_sha256 from g"""
                                   % exact_stream.EXACT_SQL))


def test_colliding_digests_are_told_apart_by_bytes(docs):
    full = exact_stream.dedup_stream(docs)
    weak = exact_stream.dedup_stream(
        docs, digest=lambda t: F.substring(F.unhex(F.sha2(t.cast("binary"), 256)), 1, 1) )
    names = ("keep_id", "group_size", "kept", "text_sha256")
    assert by_id(weak, *names) == by_id(full, *names)
    assert full.count() == docs.count()


def test_stream_in_several_batches(spark, docs, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    prints = exact_stream.fingerprints(docs)
    prints.filter("doc_id % 2 = 0").coalesce(2).write.parquet(source)
    for _ in range(2):
        exact_stream.run_stream(spark, source, prints.schema, str(tmp_path / "state"), sink, 1)
        prints.filter("doc_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    exact_stream.run_stream(spark, source, prints.schema, str(tmp_path / "state"), sink, 1)
    like = spark.read.parquet(sink).drop("batch").schema
    groups = exact_stream.group_places(spark, sink, like)
    seen = prints.filter("doc_id is not null")
    assert groups.agg(F.sum("__n")).first()[0] == seen.count() + prints.filter(
        "doc_id % 2 = 1").count()
    largest = {bytes(r[0]): r[1] for r in seen.groupBy("__digest").agg(F.max("doc_id")).collect()}
    assert {bytes(r["__digest"]): r["__place"]["doc_id"] for r in groups.collect()} == largest


def test_exact_of_nothing(no_docs):
    assert exact_stream.dedup_stream(no_docs).count() == 0


@pytest.mark.parametrize("shard", [1 << 12, 8 << 20])
def test_near_agrees_with_all_pairs(docs, texts, shard):
    found = jaccard_join.near_duplicates(docs, shard_bytes=shard)
    want = jaccard_join.brute_force(list(enumerate(texts)))
    rows = by_id(found, "n_shingles", "component_id")
    assert len(rows) == docs.count()
    assert {r[0]: r[1:] for r in rows if r[0] is not None} == want
    # the null id repeats text 6, so it is in the same component
    assert [r[1:] for r in rows if r[0] is None] == [want[6]]


def test_near_group_without_a_common_hub(spark):
    """A chain of edits: neighbours link, the ends do not."""
    import random
    dice = random.Random(3)
    words = sentence(dice, 200).split()
    rows = []
    for k in range(60):
        words = [*words[:k * 3], "new", *words[k * 3 + 1:]]
        rows.append((100 - k, " ".join(words)))
    rows += [(200 + k, sentence(dice, 50)) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_duplicates(frame, shard_bytes=1 << 14).collect()}
    assert got == jaccard_join.brute_force(rows)
    assert jaccard_join.one_per_group(frame).count() == len({c for _, c in got.values()})


def template_texts(n, own):
    """Short texts of one template of 100 shingles and ``own`` others each, and two near copies."""
    dice = random.Random(11)
    template = sentence(dice, 104)
    rows = [(k, f"{template} " + " ".join(f"w{k}x{j}" for j in range(own))) for k in range(n)]
    return rows + [(n, rows[3][1] + " more"), (n + 1, rows[7][1] + " more")]


def test_short_texts_of_one_template_move_no_bodies(spark):
    """100 of 140 shingles are shared: no link, and no block of them all."""
    rows = template_texts(300, 20)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prefixes = jaccard_join.prefixes(frame, jaccard_join.common_shingles(frame))
    assert jaccard_join.block_members(prefixes).count() <= 8
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_duplicates(frame, shard_bytes=1 << 14).collect()}
    assert got == jaccard_join.brute_force(rows)


def test_sets_that_share_with_a_hub_only_move_no_bodies(spark):
    """Every text shares an eighth with each of 96 others: no link, and no block of texts around a hub."""
    dice = random.Random(19)
    passages = [[sentence(dice, 20) for _ in range(13)] for _ in range(8)]
    lines = [(a, b) for a in range(13) for b in range(13)]
    rows = [(k, " ".join(f"{passages[x][(a * x + b) % 13]} w{k}x{x}" for x in range(8)))
            for k, (a, b) in enumerate(lines)]
    rows += [(500, rows[3][1] + " more"), (501, rows[7][1] + " more")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    prefixes = jaccard_join.prefixes(frame, jaccard_join.common_shingles(frame))
    ids = {r.sid: r.doc_id for r in prefixes.select("sid", "doc_id").collect()}
    blocks = {}
    for r in jaccard_join.block_members(prefixes).collect():
        blocks.setdefault(r.hub, set()).add(ids[r.sid])
    assert sorted(map(sorted, blocks.values())) == [[3, 500], [7, 501]]


def test_blocks_are_cut_where_no_two_sets_may_link():
    """Candidate components against all pairs, and a block over the limit stays whole."""
    import numpy as np
    dice = np.random.default_rng(2)
    pool = dice.integers(0, 1 << 60, 60, np.int64)
    sets, sizes = [], []
    for k in range(200):
        grown = np.unique(np.concatenate((dice.choice(pool, 12, False), dice.integers(0, 1 << 60, 8))))
        sets.append(sets[-1].copy() if k % 3 == 1 else grown)
        sizes.append(int(dice.integers(40, 200)) if k % 3 != 1 else sizes[-1] + int(dice.integers(0, 20)))
    forest = jaccard_join.Forest()
    for a in range(200):
        for b in range(a):
            low, high = sorted((sizes[a], sizes[b]))
            if len(np.intersect1d(sets[a], sets[b])) >= 1 + low // 10 and 5 * low >= 4 * high:
                forest.join(a, b)
    counts = [len(s) for s in sets]
    labels = jaccard_join.candidate_labels(
        np.array(sizes), np.repeat(np.arange(200), counts), np.concatenate(sets))
    groups = {}
    for k in range(200):
        groups.setdefault(forest.root(k), []).append(k)
    assert 1 < len(groups) < 200
    assert labels.tolist() == [groups[forest.root(k)][0] for k in range(200)]
    lists = pa.ListArray.from_arrays(
        pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(np.concatenate(sets)))
    block = pa.RecordBatch.from_arrays(
        [pa.array([0] * 200), pa.array([0] * 200), pa.array(range(200)), pa.array(sizes), lists],
        ["hub", "band", "sid", "n", "hs"])
    found = [r for b in jaccard_join.candidate_blocks(iter([block])) for r in b.to_pylist()]
    assert found == [{"hub": k, "sid": s} for s, k in enumerate(labels.tolist())
                     if len([x for x in labels if x == k]) > 1]
    whole = [r for b in jaccard_join.candidate_blocks(iter([block[:90], block[90:]]), 1000)
             for r in b.to_pylist()]
    assert whole == [{"hub": 0, "sid": s} for s in range(200)]


def test_searching_sets_are_streamed_past_bounded_lists(spark, monkeypatch):
    """A block of many shards whose sizes differ: cells stay bounded and links are complete."""
    dice = random.Random(13)
    pool = sentence(dice, 400).split()
    rows = []
    for k in range(240):
        start = dice.randrange(40)
        body = pool[start:start + dice.choice((70, 90, 130, 200))]
        rows.append((k, " ".join([*body, *[f"w{k}x{j}" for j in range(dice.randrange(20))]])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    chunks = []
    plain = jaccard_join.dealt
    monkeypatch.setattr(jaccard_join, "dealt", lambda f: (chunks.append(f), plain(f))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in jaccard_join.near_duplicates(frame, shard_bytes=1 << 12).collect()}
    assert got == jaccard_join.brute_force(rows)
    cells = chunks[1].groupBy("hub", "shard", "chunk").agg(
        F.count_if(F.col("role") == 1).alias("asking")).agg(F.max("asking"), F.count("*")).first()
    assert cells[1] > 1 and cells[0] <= 60


def test_one_row_of_each_group_stays(spark):
    """Groups that repeat their smallest id, the row itself, or have null ids only."""
    dice = random.Random(17)
    a, b, c = (sentence(dice, 60) for _ in range(3))
    rows = [(1, a), (1, a), (1, a + " more"), (2, a), (None, b), (None, b), (None, b + " more"),
            (1, c), (None, c), (3, ""), (3, ""), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard_join.one_per_group(frame).collect()]
    full = [r for r in got if r[1]]
    assert len(full) == 3 and {r[0] for r in full if r[1].startswith(b)} == {None}
    assert [r[0] for r in full if not r[1].startswith(b)] == [1, 1]
    assert len(got) == 6


def test_near_of_nothing(no_docs):
    assert jaccard_join.jaccard_report(no_docs).count() == 0


def test_search_finds_every_similar_set():
    import numpy as np
    dice = np.random.default_rng(1)
    common = dice.integers(0, 1 << 60, 30, np.uint64)
    sets = []
    for _ in range(120):
        own = dice.integers(0, 1 << 60, 70, np.uint64) if len(sets) % 3 == 0 else sets[-1].copy()
        own = np.unique(np.concatenate((own[dice.random(len(own)) > 0.06], common)))
        sets.append(own)
    lists = jaccard_join.Lists(sets)
    for k, query in enumerate(sets):
        want = [j for j, s in enumerate(sets) if j != k and jaccard_join.linked(query, s)]
        assert lists.search(query, k).tolist() == want


def digest_rows(docs, texts):
    rows = docs.select("doc_id", "text").collect()
    return sorted(((r.doc_id, *x) for r, x in zip(
        rows, suffix_dedup.brute_force([r.text for r in rows]))),
        key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))


def test_byte_strings_agree_with_brute_force(docs, texts):
    got = by_id(suffix_dedup.repeat_report(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == digest_rows(docs, texts)


def test_byte_strings_at_the_threshold(spark):
    import random
    dice = random.Random(9)

    def noise(n):
        return "".join(dice.choice("abcdefghijklmnop") for _ in range(n))
    part = noise(260)
    rows = [(1, noise(150) + part[:200] + noise(90)), (2, part[:200]), (3, noise(40) + part[1:200]),
            (4, part[:199] + "é" + noise(300)), (5, noise(7) + part + noise(7)), (6, part[60:]),
            (7, "z" * 199), (8, "z" * 200), (9, "y" * 201), (10, "é" * 150), (11, noise(500))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(suffix_dedup.repeat_report(frame), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == digest_rows(frame, None)


def test_byte_strings_of_nothing(no_docs):
    assert suffix_dedup.repeat_report(no_docs).count() == 0


def test_spans_and_kept_bytes(spark):
    part = "".join(chr(97 + (i * i) % 26) + str(i) for i in range(100))
    frame = spark.createDataFrame([(1, "é" + part), (2, part + "ü")], "doc_id long, text string")
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(frame).collect()}
    assert bytes(rows[1].kept) == "é".encode() and [tuple(s) for s in rows[1].removed] == [
        (2, 2 + len(part))]
    assert hashlib.sha256(rows[2].kept).hexdigest() == hashlib.sha256("ü".encode()).hexdigest()


def test_packed_texts_are_cut_by_their_own_size():
    """Long runs of one byte pack to almost nothing; a slice still holds few of them."""
    pack = zstandard.ZstdCompressor().compress
    texts = [b"a" * 200_000, b"", b"b" * 200_000, b"c" * 10, b"d" * 900_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array([pack(t) for t in texts])],
                                       ["doc_id", "body"])
    parts = list(suffix_dedup.unpacked_slices(iter([batch]), 1))
    assert [t for _, part in parts for t in part] == texts
    assert [b.column(0).to_pylist() for b, _ in parts] == [[0, 1, 2], [3, 4]]
    assert all(sum(map(len, part[:-1])) < suffix_dedup.SLICE for _, part in parts)
