"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into pre-tokens by the public pattern.  Pre-tokens with their positions are dealt by
word; a sorted partition encodes each distinct word once and sends the ids back, where they are put
into their document by position.  Words that a bounded sample shows to be frequent would be the hot
keys of that shuffle: their ids are sent to the tasks instead, in a table of at most ``HOT_WORDS``
entries, and their places stay in the document as numbers.  Which words are frequent only routes
rows, the ids are the same.  Decoding joins the ids with the token-byte table, which has the fixed
size of the vocabulary and is sent to the tasks.

The vocabulary is read on the driver from a rank file whose path is a parameter.  Null and empty
texts have no ids and decode to nothing.  Rows that repeat doc_id and text give equal rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (ROW, map_batches, range_hashes, slices, stored, texts_of,
                                 with_row_key)

HOT_WORDS = 600_000
SAMPLE_DOCS = 40_000
HOT_BYTES = 64  # longer words never count as frequent, which bounds the bytes of their table
SECOND_SEED = 0xA0761D6478BD642F


def read_ranks(path: str) -> list[bytes]:
    """The token bytes by id of a rank file (base64 token and rank per line)."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token)
                 for token, rank in (line.split() for line in lines if line.strip())}
    return [ranks[i] for i in range(len(ranks))]


@lru_cache(maxsize=2)
def encoder(tokens: tuple[bytes, ...], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("words", pat_str=pattern, special_tokens={},
                             mergeable_ranks={t: i for i, t in enumerate(tokens)})


class Pool:
    """Variable-length pieces in one array; ``gather`` concatenates chosen pieces."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray):
        self.sizes, self.values = sizes.astype(np.int64), values
        self.begin = np.cumsum(self.sizes) - self.sizes

    def gather(self, which: np.ndarray) -> np.ndarray:
        many = self.sizes[which]
        shift = self.begin[which] - (np.cumsum(many) - many)
        return self.values[np.arange(int(many.sum())) + np.repeat(shift, many)]


def token_pool(tokens: list[bytes]) -> Pool:
    return Pool(np.array([len(t) for t in tokens]), np.frombuffer(b"".join(tokens), np.uint8))


class Words:
    """The pre-tokens of some texts: their text number, position and bytes."""

    def __init__(self, texts: list[bytes], pattern: regex.Pattern):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        counts, sizes = [], []
        for body in texts:
            found = pattern.findall(body.decode("utf-8"))
            counts.append(len(found))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
        self.counts = np.array(counts, np.int64)
        # pre-tokens cover a text without gaps, so character counts give the byte places
        ends = np.cumsum(np.concatenate(sizes)) if sizes else np.zeros(0, np.int64)
        places = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        self.ends = places[ends]
        self.starts = np.concatenate(([0], self.ends[:-1])) if len(ends) else self.ends

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of every pre-token."""
        return (range_hashes(self.data, self.starts, self.ends),
                range_hashes(self.data, self.starts, self.ends, SECOND_SEED))

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def word_keys(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of separate words."""
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    return (range_hashes(data, ends - sizes, ends),
            range_hashes(data, ends - sizes, ends, SECOND_SEED))


class Frequent:
    """The frequent words by their hashes, with the pool of their ids."""

    def __init__(self, table: pa.Table):
        """``table``: first, second (hashes), count and ids of every word.

        Words are numbered by falling count, so the numbers in documents are small.
        """
        if not table.num_rows:
            self.first = self.second = np.zeros(0, np.uint64)
            self.rank = np.zeros(0, np.uint32)
            self.pool = Pool(np.zeros(0, np.int64), np.zeros(0, np.uint32))
            return
        first = table["first"].to_numpy().view(np.uint64)
        order = np.argsort(first, kind="stable")
        self.first = first[order]
        self.second = table["second"].to_numpy().view(np.uint64)[order]
        falling = np.argsort(-table["n"].to_numpy(), kind="stable")
        rank = np.empty(len(falling), np.uint32)
        rank[falling] = np.arange(len(falling), dtype=np.uint32)
        self.rank = rank[order]
        ids = pa.concat_arrays(table["ids"].chunks).take(pa.array(falling))
        offsets = np.frombuffer(ids.buffers()[1], np.int32)[:len(ids) + 1]
        values = ids.buffers()[2]
        self.pool = Pool(np.diff(offsets) // 4, np.frombuffer(values or b"", np.uint32)
                         [offsets[0] // 4:offsets[-1] // 4].copy())

    def number(self, words: Words) -> np.ndarray:
        """1 + the number of every word, 0 for one that is not here."""
        first, second = words.keys()
        if not len(self.first) or not len(first):
            return np.zeros(len(first), np.uint32)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        known = (self.first[at] == first) & (self.second[at] == second)
        return np.where(known, self.rank[at] + np.uint32(1), np.uint32(0))


def encode_words(tokens: tuple[bytes, ...], pattern: str, words: list[bytes]) -> list[bytes]:
    """Ids of each word as little-endian 32-bit integers."""
    piece = encoder(tokens, pattern)._encode_single_piece
    return [np.array(piece(w), "<u4").tobytes() for w in words]


def frequent_words(docs: DataFrame, tokens, pattern: str, limit: int = HOT_WORDS,
                   sample: int = SAMPLE_DOCS) -> Frequent:
    """Words that occur at least twice in a bounded sample, the most frequent up to ``limit``."""
    step = max(1, docs.count() // sample)
    chosen = with_row_key(docs).filter(F.pmod(F.xxhash64("doc_id", ROW), F.lit(step)) == 0)

    def count(batch: pa.RecordBatch):
        cut = regex.compile(pattern)
        seen: Counter = Counter()
        for body in texts_of(batch.column(0)):
            seen.update(cut.findall(body.decode("utf-8")))
        found = [(w, n) for w, n in ((w.encode(), n) for w, n in seen.items()) if len(w) <= HOT_BYTES]
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in found], pa.binary()),
             pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    counts = stored(map_batches(chosen.select("text"), count, "word binary, n long").groupBy(
        "word").agg(F.sum("n").alias("n")).filter("n > 1"), "word-counts")
    # a count is at most the words of the sample, and few counts are large
    levels = counts.groupBy("n").count().toPandas().sort_values("n", ascending=False)
    fit = levels[levels["count"].cumsum() <= limit]
    least = int(fit["n"].min()) if len(fit) else 1 << 62

    def encode(batch: pa.RecordBatch):
        words = batch.column(0).to_pylist()
        first, second = word_keys(words)
        yield pa.RecordBatch.from_arrays(
            [pa.array(first.view(np.int64)), pa.array(second.view(np.int64)),
             batch.column(1), pa.array(encode_words(tokens.value, pattern, words), pa.binary())],
            ["first", "second", "n", "ids"])

    return Frequent(map_batches(counts.filter(F.col("n") >= least).select("word", "n"), encode,
                                "first long, second long, n long, ids binary").toArrow())


def placed_words(docs: DataFrame, frequent, pattern: str) -> DataFrame:
    """(word, doc_id, row, position) of every pre-token that is not a frequent word."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def explode(batch: pa.RecordBatch):
        words = Words(texts_of(batch.column(2)), regex.compile(pattern))
        rare = np.flatnonzero(frequent.value.number(words) == 0)
        text = np.repeat(np.arange(batch.num_rows), words.counts)[rare]
        start = np.cumsum(words.counts) - words.counts
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words.bytes_of(rare), pa.binary()), batch.column(0).take(rows),
             batch.column(1).take(rows), pa.array((rare - start[text]).astype(np.int32))],
            ["word", "doc_id", ROW, "position"])

    return map_batches(docs.select("doc_id", ROW, "text"), explode,
                       f"word binary, doc_id {kind}, {ROW} long, position int")


def encoded_places(words: DataFrame, tokens, pattern: str) -> DataFrame:
    """(doc_id, row, position, ids): rows are dealt by word and each distinct word of a sorted
    partition is encoded once."""
    kind = words.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]):
        piece = encoder(tokens.value, pattern)._encode_single_piece
        last, ids = None, b""
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, ids = word, np.array(piece(word), "<u4").tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(out, pa.binary())],
                ["doc_id", ROW, "position", "data"])

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(
        encode, f"doc_id {kind}, {ROW} long, position int, data binary")


def documents_of_numbers(docs: DataFrame, frequent, pattern: str) -> DataFrame:
    """(doc_id, row, -1, data): the numbers of the frequent words of a document, 0 for others."""
    import zstandard
    kind = docs.schema["doc_id"].dataType.simpleString()

    def number(batch: pa.RecordBatch):
        words = Words(texts_of(batch.column(2)), regex.compile(pattern))
        numbers = frequent.value.number(words)
        ends = np.cumsum(words.counts)
        pack = zstandard.ZstdCompressor(level=3).compress
        data = [pack(planes(numbers[a:b])) for a, b in zip(ends - words.counts, ends)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(np.full(batch.num_rows, -1, np.int32)),
             pa.array(data, pa.binary())], ["doc_id", ROW, "position", "data"])

    return map_batches(docs.select("doc_id", ROW, "text"), number,
                       f"doc_id {kind}, {ROW} long, position int, data binary")


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


class Assembly:
    """Puts the ids of one document together from rows sorted by position."""

    def __init__(self, frequent: Frequent):
        self.frequent = frequent
        self.key = None
        self.reset()

    def reset(self):
        self.numbers, self.copies, self.rare, self.last = None, 0, [], -1

    def take(self, row: dict) -> None:
        if row["position"] < 0:
            import zstandard
            self.copies += 1
            self.numbers = from_planes(zstandard.ZstdDecompressor().decompress(row["data"]))
        elif row["position"] != self.last:  # repeated rows bring each position again
            self.rare.append(row["data"])
            self.last = row["position"]

    def ids(self) -> np.ndarray:
        missing = np.flatnonzero(self.numbers == 0)
        if len(missing) != len(self.rare):
            raise ValueError("the words of a document did not all come back")
        pool = self.frequent.pool
        which = self.numbers.astype(np.int64) - 1
        if not self.rare:
            return pool.gather(which)
        # the pieces of this document only, so the pool is not copied per document
        known = len(pool.sizes)
        which[missing] = known + np.arange(len(missing))
        used, place = np.unique(which, return_inverse=True)
        common = used[used < known]
        sizes = np.concatenate((pool.sizes[common], [len(r) // 4 for r in self.rare]))
        values = np.concatenate(
            (pool.gather(common), np.frombuffer(b"".join(self.rare), np.uint32)))
        return Pool(sizes, values).gather(place)


def encode(docs: DataFrame, path: str, pattern: str, hot_words: int = HOT_WORDS) -> DataFrame:
    """(doc_id, row, ids): ids as little-endian unsigned 32-bit integers, one row per document."""
    spark = docs.sparkSession
    vocabulary = tuple(read_ranks(path))
    tokens = spark.sparkContext.broadcast(vocabulary)
    docs = with_row_key(docs.select("doc_id", "text"))
    frequent = spark.sparkContext.broadcast(
        frequent_words(docs.drop(ROW), tokens, pattern, hot_words))
    rare = encoded_places(placed_words(docs, frequent, pattern), tokens, pattern)
    rows = documents_of_numbers(docs, frequent, pattern).unionByName(rare)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def assemble(batches: Iterator[pa.RecordBatch]):
        state = Assembly(frequent.value)
        for batch in (part for b in batches for part in slices(b)):
            out = []
            for row in batch.to_pylist():
                key = (row["doc_id"], row[ROW])
                if key != state.key:
                    out += finished(state)
                    state.reset()
                    state.key = key
                state.take(row)
            if out:
                yield id_rows(out, batch.schema)
        if left := finished(state):
            yield id_rows(left, batch.schema)

    def finished(state: Assembly) -> list[tuple]:
        if not state.copies:
            return []
        return [(*state.key, state.ids().astype("<u4").tobytes())] * state.copies

    def id_rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], schema.field("doc_id").type),
             pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.binary())], ["doc_id", ROW, "ids"])

    # one document per key, so the rows of a key are bounded by its text
    return rows.repartition("doc_id", ROW).sortWithinPartitions(
        "doc_id", ROW, "position").mapInArrow(assemble, f"doc_id {kind}, {ROW} long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``bytes``: its ids joined with the token-byte table of fixed size."""
    tokens = encoded.sparkSession.sparkContext.broadcast(token_pool(read_ranks(path)))
    schema = encoded.select("*", F.lit(b"").alias("bytes")).schema

    def join(batches: Iterator[pa.RecordBatch]):
        for batch in (part for b in batches for part in slices(b)):
            at = batch.schema.names.index("ids")
            out = [tokens.value.gather(np.frombuffer(v or b"", "<u4").astype(np.int64)).tobytes()
                   for v in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "bytes"])

    return encoded.mapInArrow(join, schema)


def token_report(docs: DataFrame, path: str, pattern: str,
                 hot_words: int = HOT_WORDS) -> DataFrame:
    """Per document: number and hash of the ids, and the hash of the bytes decoded from them."""
    return decode(encode(docs, path, pattern, hot_words), path).select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def brute_force(text: str | None, path: str, pattern: str) -> tuple[int, str, str]:
    """The digest columns by the tokenizer library; for tests."""
    ids = encoder(tuple(read_ranks(path)), pattern).encode_ordinary(text or "")
    raw = np.array(ids, "<u4").tobytes()
    return (len(ids), hashlib.sha256(raw).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())
