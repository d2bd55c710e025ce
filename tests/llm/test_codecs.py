"""BPE and WARC round trips, the pipeline, and the registered queries."""

import hashlib
import unicodedata

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from checks.compare import connect, normal
from tests.conftest import ROOT
from tests.llm.conftest import by_id
from tidemark.llm import bpe, decontaminate, jaccard_join, warc
from tidemark.llm.common import read_table
from tidemark.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
NAMES = ("n_tokens", "ids_sha256", "decoded_sha256")


@pytest.mark.parametrize("hot", [0, 50, 600_000])
def test_ids_are_those_of_the_library(docs, hot):
    rows = [(r.doc_id, *bpe.brute_force(r.text, PATH, PATTERN)) for r in docs.collect()]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, repr(r)))
    assert by_id(bpe.token_report(docs, PATH, PATTERN, hot), *NAMES) == want


def test_every_character_is_cut_as_the_library_does(spark):
    """All code points, between letters, digits, signs and spaces."""
    points = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    rows = []
    for k in range(0, len(points), 2000):
        part = points[k:k + 2000]
        rows.append((k, "".join(f"a{c} 1{c}{c}!{c}  {c}\n" for c in part)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = sorted((k, *bpe.brute_force(t, PATH, PATTERN)) for k, t in rows)
    assert by_id(bpe.token_report(frame, PATH, PATTERN), *NAMES) == want


def test_no_documents(no_docs):
    assert bpe.token_report(no_docs, PATH, PATTERN).count() == 0


def pages(spark):
    big = "x" * 300_000 + "é" * 200_000
    rows = [(1, "http://a/\r\nWARC/1.1", "<p>WARC/1.1\r\n\r\n</p>", 1), (2, None, "<p>1</p>", 2),
            (3, "u", "<p>1</p>", 3), (4, "u", None, 4), (5, "u", "", 5), (6, "u", big, 6),
            (7, "u", big, 7), (8, "u", big + "y", 8), (3, "u", "<p>1</p>", 3),
            (None, "u", "<p>1</p>", 9), (None, "u", "alone", 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


@pytest.mark.parametrize("smallest,chunk", [(0, 1000), (5, 64 << 10), (1 << 30, 1 << 20)])
def test_archives_come_back(spark, smallest, chunk):
    frame = pages(spark)
    rows = frame.collect()
    got = sorted((tuple(r) for r in warc.archive_report(frame, smallest, chunk).collect()), key=repr)
    keep = {}
    for r in rows:
        keep[r.html or ""] = max(keep.get(r.html or "") or -1, -1 if r.page_id is None else r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        to = keep[r.html or ""]
        again = len(body) >= smallest and to not in (-1, r.page_id)
        want.append((r.page_id, len(body), warc.base32_sha1(hashlib.sha1(body).digest()),
                     "revisit" if again else "response", to if again else None))
    assert got == sorted(want, key=repr)


def test_archives_are_warc(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write_archives(pages(spark), path, chunk=100_000)
    seen = []
    for file in sorted((tmp_path / "out").glob("*.gz")):
        seen += [f for f, _ in warc.Archive(file.read_bytes()).records()]
    kinds = {f["WARC-Type"] for f in seen}
    assert kinds == {"response", "revisit", "continuation"}
    assert warc.archive_report(pages(spark).limit(0)).count() == 0


def test_damaged_archives_are_noticed(spark, tmp_path):
    import gzip
    path = tmp_path / "out"
    warc.write_archives(pages(spark).filter("page_id = 2").coalesce(1), str(path))
    file = next(path.glob("*.gz"))
    text = gzip.decompress(file.read_bytes()).replace(b"<p>1", b"<p>2")
    next(path.glob(".*.crc"), file).unlink()
    file.write_bytes(gzip.compress(text))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archives(spark, str(path)).count()


def test_pipeline_against_plain_python(spark):
    """Each stage on its own input, by brute force where it is not a trained model."""
    docs = read_table(spark, ROOT, "documents").cache()
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language"](spark, docs, ROOT)
    assert named.columns == docs.columns and named.count() >= 0.99 * docs.count()
    lines = stages["lines"](spark, docs, ROOT).cache()
    assert lines.columns == docs.columns
    assert lines.filter(F.length("text") != F.col("n_chars")).count() == docs.filter(
        F.length("text") != F.col("n_chars")).count()
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    want = {c for _, c in jaccard_join.brute_force(rows).values()}
    near = stages["near_duplicates"](spark, lines, ROOT).cache()
    assert {r.doc_id for r in near.collect()} == want
    items = [(str(r.item_id), r.text) for r in read_table(spark, ROOT, "benchmark").collect()]
    clean = {r.doc_id for r in near.collect()
             if not decontaminate.brute_force(r.text, items)[4]}
    free = stages["benchmark_free"](spark, near, ROOT)
    assert {r.doc_id for r in free.collect()} == clean and len(clean) < near.count()
    out = corpus_pipeline.run(spark, ROOT)
    texts = {r.doc_id: r.text for r in lines.collect()}
    for r in out.collect():
        assert tuple(r)[1:] == bpe.brute_force(texts[r.doc_id], PATH, PATTERN)


def test_pipeline_stages_on_odd_rows(spark, docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        for frame in (docs, no_docs):
            out = stage(spark, frame, ROOT)
            assert name == "tokens" or out.columns == docs.columns
            assert out.count() <= frame.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_sql(spark, name):
    got = QUERIES[name](spark, ROOT).toPandas()
    with connect(ROOT) as db:
        want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_lists_every_query():
    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert duckdb.__version__
