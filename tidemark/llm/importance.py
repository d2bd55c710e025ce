"""Importance resampling towards a target distribution over hashed n-grams.

Features are runs of one to three consecutive words.  Each batch interns its n-grams in an
open-addressed NumPy table: places come from xxhash64 keys, a match is verified byte by byte, and a
taken place sends the n-gram to the next.  The table's slots hold the n-gram's bucket and its count;
each occurrence keeps its slot id.  Corpus counts add the counts of slots; weights gather the gains of
slots through the occurrences.  Batches are cut into blocks of words, so a table is bounded whatever the
length of a text.

A document's draw is exact: the weight plus a Gumbel number from the hash of its id, ranked
over all documents that are long enough.

Results of odd cases: null and empty texts have no features, weight 0 and are not drawn; a null key
counts as the empty string in the hash and comes first among equal scores; rows that repeat a key
are drawn one by one, each with a rank of its own.  Empty tables give empty results, an empty target gives
gains from the smoothing alone.  Only the named columns are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, slices, stored, texts_of, wide_words, xxh64
from tidemark.llm.features import joined, lowered
from tidemark.operators.ranking import number_rows

BUCKETS = 10000
LONGEST = 3
SEED = 42
PERCENT = 5
MIN_WORDS = 20
BLOCK_WORDS = 1 << 17
QUANTILE_STEPS = 10000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
# keeps the first k bytes of a little-endian word
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


class Grams:
    """The words of many texts as one byte string, a single space behind each word."""

    def __init__(self, texts: list[bytes]):
        data, offsets = joined(texts)
        data = lowered(data)
        word = _WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False]))))
        begins, sizes = edge[::2], edge[1::2] - edge[::2]
        self.of = np.searchsorted(offsets, begins, "right") - 1
        keep = word.copy()
        keep[1:] |= word[:-1]
        flat = np.where(word, data, np.uint8(32))[keep]
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.flat = flat.tobytes()
        self.words = np.bincount(self.of, minlength=len(texts))
        self.wide = wide_words(self.flat)

    def blocks(self, limit: int = BLOCK_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, start, end) of the n-grams that start in each run of ``limit`` words."""
        for a in range(0, len(self.of), limit):
            of, start, end = [], [], []
            for n in range(LONGEST):
                first = np.arange(a, min(a + limit, len(self.of) - n))
                first = first[self.of[first] == self.of[first + n]]
                of.append(self.of[first])
                start.append(self.starts[first])
                end.append(self.ends[first + n])
            yield np.concatenate(of), np.concatenate(start), np.concatenate(end)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def crc32(grams: Grams, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """crc32 of many byte ranges: under 32 bytes in lockstep, longer ones by the library."""
    order = np.argsort(-np.minimum(sizes, 32), kind="stable")
    start, size = starts[order], sizes[order]
    long = int((size >= 32).sum())
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    data = np.frombuffer(grams.flat, np.uint8)
    for at in range(31):
        upto = len(size) - int(np.searchsorted(size[::-1], at, "right"))
        if upto <= long:
            break
        part = crc[long:upto]
        crc[long:upto] = _CRC[(part ^ data[start[long:upto] + at]) & np.uint32(255)] ^ (
            part >> np.uint32(8))
    out = np.empty(len(start), np.int64)
    out[order] = ~crc
    for k in range(long):
        out[order[k]] = zlib.crc32(grams.flat[start[k]:start[k] + size[k]])
    return out


class Table:
    """Open-addressed table of the n-grams of one block.

    ``slot`` holds the slot id of every occurrence; ``bucket`` and ``count`` lie in the slots.
    """

    def __init__(self, grams: Grams, starts: np.ndarray, ends: np.ndarray):
        total = len(starts)
        size = 1 << max(3, (2 * total).bit_length())
        sizes = ends - starts
        keys = xxh64(grams.flat, grams.wide, starts, sizes)
        place = (keys & np.uint64(size - 1)).astype(np.int64)
        owner = np.full(size, -1, np.int64)
        self.slot = np.empty(total, np.int64)
        waiting = np.arange(total)
        while len(waiting):
            at = place[waiting]
            free = owner[at] < 0
            owner[at[free]] = waiting[free]  # of several writers one stays, the others compare
            held = owner[at]
            same = keys[held] == keys[waiting]
            doubt = np.flatnonzero(same & (held != waiting))
            same[doubt] = same_bytes(grams, starts, sizes, held[doubt], waiting[doubt])
            self.slot[waiting[same]] = at[same]
            waiting = waiting[~same]
            place[waiting] = (place[waiting] + 1) & (size - 1)
        taken = np.flatnonzero(owner >= 0)
        first = owner[taken]
        self.bucket = np.zeros(size, np.int64)
        self.bucket[taken] = crc32(grams, starts[first], sizes[first]) % BUCKETS
        self.count = np.bincount(self.slot, minlength=size)


def same_bytes(grams: Grams, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray
               ) -> np.ndarray:
    """Whether the n-grams a[i] and b[i] are equal, eight bytes at a time, long rests at once."""
    ok = sizes[a] == sizes[b]
    live = np.flatnonzero(ok)
    for at in range(0, 256, 8):
        if not len(live):
            return ok
        left = sizes[a[live]] - at
        differ = (grams.wide[starts[a[live]] + at] ^ grams.wide[starts[b[live]] + at]
                  ) & _HEAD[np.minimum(left, 8)] != 0
        ok[live[differ]] = False
        live = live[~differ & (left > 8)]
    text = grams.flat
    for k in live.tolist():
        p, q, n = starts[a[k]], starts[b[k]], sizes[a[k]]
        ok[k] = text[p:p + n] == text[q:q + n]
    return ok


def bucket_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n): occurrences of n-grams per bucket, added up inside each task first."""
    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in slices(batch):
                grams = Grams(texts_of(part.column(0)))
                for _, starts, ends in grams.blocks():
                    table = Table(grams, starts, ends)
                    total += np.bincount(table.bucket, table.count, BUCKETS).astype(np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(
        count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def count_array(counts: DataFrame) -> np.ndarray:
    """At most BUCKETS rows, whatever the corpus."""
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio) per bucket, in doubles."""
    s_all, t_all = int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + BUCKETS) / ((s + 1) * (t_all + BUCKETS))))
                     for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight) of every row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    kind = docs.schema[key].dataType.simpleString()

    def rate(batch: pa.RecordBatch):
        texts = texts_of(batch.column(1))
        grams = Grams(texts)
        weight = np.zeros(len(texts))  # whole numbers below 2**53
        features = np.zeros(len(texts), np.int64)
        for of, starts, ends in grams.blocks():
            table = Table(grams, starts, ends)
            gain = shared.value[table.bucket]
            weight += np.bincount(of, gain[table.slot], len(texts))
            features += np.bincount(of, minlength=len(texts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(grams.words.astype(np.int64)), pa.array(features),
             pa.array(weight.astype(np.int64))], ["key", "n_words", "n_features", "weight"])

    narrow = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return map_batches(narrow, rate, f"key {kind}, n_words long, n_features long, weight long"
                       ).withColumnRenamed("key", key)


def gumbel(key: Column, seed: int) -> Column:
    """floor(-1000 * ln(-ln u)) with u from the first 32 bits of sha256('seed:key')."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))
                                         ).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
         key: str = "doc_id") -> DataFrame:
    """``weighed`` with ``rank``: 1, 2, 3, ... by falling score, then key; null if not drawn.

    ``weighed`` should be a stored table, it is read a few times.  A quantile with a proven error bound
    leaves little more than the drawn share to sort; the sort is by ranges over all tasks.
    """
    long_enough = F.col("n_words") >= min_words
    total, cut = weighed.filter(long_enough).agg(
        F.count("*"), F.percentile_approx(
            "score", max(0.0, 1 - percent / 100 - 4 / QUANTILE_STEPS), QUANTILE_STEPS)).first()
    wanted = percent * total // 100
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return weighed.select("*", none)
    in_reach = F.coalesce(long_enough & (F.col("score") >= cut), F.lit(False))
    ranked = number_rows(weighed.filter(in_reach), [
        F.col("score").desc(), F.col(key), F.col("weight"), F.col("n_features")])
    return ranked.select(*weighed.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
                         ).unionByName(weighed.filter(~in_reach).select("*", none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED,
             min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_features, weight, score, rank) of every document."""
    gains = bucket_gains(count_array(bucket_counts(docs, text)), count_array(bucket_counts(target, text)))
    weighed = stored(weigh(docs, gains, text, key).withColumn(
        "score", F.col("weight") + gumbel(F.col(key), seed)), "importance")
    return draw(weighed, percent, min_words, key)


def importance_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


_BRUTE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_grams(text: str | None) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = _BRUTE_WORD.findall(lower)
    return [" ".join(words[k:k + n]) for n in range(1, LONGEST + 1) for k in range(len(words) - n + 1)]
