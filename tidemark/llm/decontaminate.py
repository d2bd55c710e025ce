"""Benchmark decontamination by one Aho-Corasick automaton over item windows.

Texts are lower-cased for A-Z and cut into words (digits, letters a-z and everything beyond
ASCII).  A pattern is a window of ten consecutive words of an item, or the whole item when it
is shorter.  The automaton runs over word numbers instead of characters: each text is scanned
once, and a hit maps back to words and from there to the offsets of the original text.

Null and empty texts have no words and no hits; so have texts against an empty benchmark.  A null
item_id is written as an empty string.  Repeated items count once per id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import (ROW, map_batches, packed, same_document, stored, unpacked,
                                 with_row_key)

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
WINDOW_WORDS = 10
# An automaton is built per task from at most so many bytes of items; a larger benchmark is
# scanned in several blocks.
BLOCK_BYTES = 8 << 20


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


class Windows:
    """The automaton of a block of items and the numbers of their words."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.numbers: dict[str, int] = {}
        places: dict[tuple[int, ...], set[int]] = {}
        self.ids: list[str] = []
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            self.ids.append(name)
            row = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]
            span = min(size, len(row))
            for k in range(len(row) - span + 1):
                places.setdefault(tuple(row[k:k + span]), set()).add(len(self.ids) - 1)
        self.shortest = min(map(len, places), default=0)
        self.automaton = None
        if places:
            self.automaton = ahocorasick.Automaton(
                ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, owners in places.items():
                self.automaton.add_word(key, (len(key), tuple(owners)))
            self.automaton.make_automaton()

    def scan(self, words: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Covered word ranges (end exclusive, merged) and the ids of the items that occur."""
        if self.automaton is None or len(words) < self.shortest:
            return [], set()
        get = self.numbers.get
        row = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        # only runs of known words can hold a window
        gaps = np.concatenate(([-1], np.flatnonzero(row == 0), [len(row)]))
        long_enough = np.flatnonzero(np.diff(gaps) - 1 >= self.shortest)
        ranges: list[tuple[int, int]] = []
        owners: set[int] = set()
        for g in long_enough:
            begin = int(gaps[g]) + 1
            run = tuple(row[begin:int(gaps[g + 1])].tolist())
            for end, (length, who) in self.automaton.iter(run):
                owners.update(who)
                ranges.append((begin + end - length + 1, begin + end + 1))
        return merged(ranges), {self.ids[i] for i in owners}


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def item_blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES
                ) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about ``limit`` bytes; the driver holds one block at a time."""
    rows = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def scan_block(docs: DataFrame, items: list[tuple[str, str]], size: int) -> DataFrame:
    """(doc_id, row, n_words, covered word ranges, items) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    kind = docs.schema["doc_id"].dataType.simpleString()
    built: dict[int, Windows] = {}

    def find(batch: pa.RecordBatch):
        if 0 not in built:
            built[0] = Windows(shared.value, size)
        numbers, ranges, owners, offsets = [], [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            covered, who = built[0].scan(words)
            numbers.append(len(words))
            ranges.append([{"a": a, "b": b} for a, b in covered])
            owners.append(sorted(who))
            offsets.append(character_spans(text, covered) if covered else [])
        span = pa.struct([("a", pa.int32()), ("b", pa.int32())])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(numbers, pa.int64()),
             pa.array(ranges, pa.list_(span)), pa.array(offsets, pa.list_(span)),
             pa.array(owners, pa.list_(pa.string()))],
            ["doc_id", ROW, "n_words", "word_spans", "spans", "items"])

    narrow = with_row_key(docs).select("doc_id", ROW, F.col("text").alias("__text"))
    return map_batches(narrow, find, f"doc_id {kind}, {ROW} long, n_words long, "
                       "word_spans array<struct<a:int,b:int>>, spans array<struct<a:int,b:int>>, "
                       "items array<string>")


def character_spans(text: str, covered: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Offsets in code points of the original text; lower-casing A-Z keeps every offset."""
    places = [m.span() for m in WORD.finditer(ascii_lower(text))]
    return [{"a": places[a][0], "b": places[b - 1][1]} for a, b in covered]


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW_WORDS,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: n_words, word and character spans of the hits, and the items found.

    A benchmark of one block needs no shuffle.  More blocks are scanned one after the other and
    their narrow hits are merged per document.
    """
    parts = [scan_block(docs, items, size) for items in item_blocks(benchmark, block_bytes)]
    if not parts:
        parts = [scan_block(docs, [], size)]
    if len(parts) == 1:
        return parts[0]
    hits = stored(parts[0], "hits")
    for part in parts[1:]:
        hits = hits.unionByName(stored(part, "hits"))
    # a document is repeated once per block, so the lists of a group are bounded by its text;
    # repeated rows are equal, and merging them again changes nothing
    return merge_spans(hits.groupBy("doc_id", ROW).agg(
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_set("word_spans")).alias("word_spans"),
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")), docs)


def merge_spans(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """Union of the ranges found by several blocks, one row for each row of ``docs``."""
    def join(batch: pa.RecordBatch):
        columns = list(batch.columns)
        for k in (3, 4):
            columns[k] = pa.array(
                [[{"a": a, "b": b} for a, b in merged([(x["a"], x["b"]) for x in v])]
                 for v in columns[k].to_pylist()], columns[k].type)
        yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    whole = map_batches(hits, join, hits.schema)
    narrow = with_row_key(docs).select("doc_id", ROW)
    return same_document(narrow, whole, "inner")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    hit = F.aggregate("word_spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"))


def hit_by(spark: SparkSession, items: list[tuple[str, str]], size: int = WINDOW_WORDS):
    """An Arrow function: whether a text holds a window of the items.  Only texts meet Python."""
    shared = spark.sparkContext.broadcast(items)
    built: dict[int, Windows] = {}

    @F.arrow_udf("boolean")
    def hit(text: pa.Array) -> pa.Array:
        if 0 not in built:
            built[0] = Windows(shared.value, size)
        return pa.array([bool(built[0].scan(words_of(t.as_py()))[1]) for t in text], pa.bool_())
    return hit


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents without any hit; all columns as they were.

    With a benchmark of one block the scan itself filters; more blocks are scanned one after the
    other and the documents that any of them hits are joined out.
    """
    blocks = list(islice(item_blocks(benchmark, block_bytes), 2))
    if not blocks:
        return docs
    if len(blocks) == 1:
        return docs.filter(~hit_by(docs.sparkSession, blocks[0])(F.col("text")))
    found = find_contamination(docs, benchmark, block_bytes=block_bytes)
    bad = found.filter(F.size("items") > 0).select("doc_id", ROW).distinct()
    kept = same_document(with_row_key(packed(docs, "doc_id", "text")), bad, "left_anti")
    return unpacked(kept, docs, "doc_id", "text")


def brute_force(text: str | None, items: list[tuple[str, str]], size: int = WINDOW_WORDS):
    """The same row by comparing every window with every place; for small tests."""
    words = words_of(text)
    hit, found = set(), set()
    for name, body in items:
        row = words_of(body)
        span = min(size, len(row))
        for k in range(len(row) - span + 1) if row else ():
            for p in range(len(words) - span + 1):
                if words[p:p + span] == row[k:k + span]:
                    hit.update(range(p, p + span))
                    found.add(name)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)
