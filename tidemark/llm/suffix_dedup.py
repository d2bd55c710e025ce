"""Removal of repeated byte strings by prefix doubling over anchored positions.

A position is repeated when the 200 bytes from it also start anywhere else.  Plain prefix doubling
sorts one (rank, rank at the offset) pair per byte and round.  Here positions are first told apart in
groups, so most bytes never become a row, and ranks are 64-bit names of equal strings, since only
equality is asked:

1. *64 bytes.*  The smallest hash of a 64-byte string among the 137 that fit into the 200 bytes is the
   position's anchor.  Equal 200-byte strings have their anchors at the same place.  Each anchor is
   one row: the rank of its 64 bytes, which all its positions share, and the rank of the 336
   bytes that its positions reach.
2. *185 and 197 bytes.*  Anchors whose 64 bytes are unique go.  Where all anchors of a rank agree on
   the 336 bytes, all their positions are repeated.  The others are cut into blocks of 16, then of 4
   positions, ranked by their common 185 (197) bytes and by the 215 (203) bytes that they reach,
   in the same way.
3. *200 bytes.*  What is still undecided becomes one row per position with the pair (rank of 100
   bytes, rank of the 100 bytes at offset 100); pairs that occur twice are repeated.

Equal strings always stay in the same group up to the step that decides them, so the result is that
of comparing every pair of positions.  Null and empty texts have no positions.  Texts under 200
bytes stay whole.  Rows that repeat another row repeat its bytes too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (FILTER_BITS, ROW, Prefix, in_filter, key_filter, key_slot, mixed,
                                 same_document, slices, spans_where, stored, texts_of,
                                 with_row_key)

LENGTH = 200
GRAM = 64
REACH = LENGTH - GRAM  # positions are at most so far before their anchor
BLOCKS = (16, 4)
SLICE = 1 << 18  # bytes of text at once; hashes and places take about a hundred times as much


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.concatenate((values, np.full(-n % width, np.iinfo(np.uint64).max, np.uint64)))
    grid = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


class Bytes:
    """Some texts joined, with the hashes of their byte ranges."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        self.prefix = Prefix(self.data)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.prefix.ranges(starts, ends)

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Per anchor: text number, place, first and last position that it stands for."""
        none = np.zeros(0, np.int64)
        starts = [np.arange(a, b - LENGTH + 1) for a, b in zip(self.offsets, self.offsets[1:])
                  if b - a >= LENGTH]
        if not starts:
            return none, none, none, none
        where = np.concatenate(starts)
        places = np.arange(len(self.data) - GRAM + 1)
        grams = self.hashes(places, places + GRAM)
        packed = (grams & np.uint64(0xFFFFFFFF00000000)) | places.astype(np.uint64)
        least = window_minimum(packed, REACH + 1)[where] & np.uint64(0xFFFFFFFF)
        anchor = least.astype(np.int64)
        text = np.searchsorted(self.offsets, where, "right") - 1
        new = np.flatnonzero(np.concatenate(
            ([True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))))
        last = np.concatenate((new[1:], [len(where)])) - 1
        return text[new], anchor[new], where[new], where[last]

    def reach(self, text: np.ndarray, near: np.ndarray, far: np.ndarray, mark: np.ndarray
              ) -> np.ndarray:
        """Hash of [near, far) cut at the ends of the text; cuts are part of the hash."""
        low = np.maximum(near, self.offsets[text])
        high = np.minimum(far, self.offsets[text + 1])
        sizes = ((mark - low).astype(np.uint64) << np.uint64(20)) | (high - mark).astype(np.uint64)
        return mixed(self.hashes(low, high) + sizes)


def packed(place: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """place (40 bits) and its distances to the first and last position (12 bits each)."""
    return (place << 24) | ((place - first) << 12) | (place - last)


def unpacked(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = value >> 24
    return place, place - ((value >> 12) & 0xFFF), place - (value & 0xFFF)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def doc_type(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def group_rows(batch: pa.RecordBatch, text: np.ndarray, core: np.ndarray, full: np.ndarray,
               spot: np.ndarray, bitmap: np.ndarray | None) -> pa.RecordBatch:
    if bitmap is not None:
        keep = in_filter(bitmap, (core & np.uint64(FILTER_BITS - 1)).astype(np.int64))
        text, core, full, spot = text[keep], core[keep], full[keep], spot[keep]
    rows = pa.array(text)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(rows), batch.column(1).take(rows), signed(core), signed(full),
         pa.array(spot)], ["doc_id", ROW, "core", "full", "spot"])


def anchor_rows(docs: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """One row per anchor; with a bitmap only those whose 64 bytes may be repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch in (part for b in freed(batches) for part in slices(b, SLICE)):
            body = Bytes(texts_of(batch.column(2)))
            text, place, first, last = body.anchors()
            core = body.hashes(place, place + GRAM)
            full = body.reach(text, place - REACH, place + LENGTH, place)
            base = body.offsets[text]
            yield group_rows(batch, text, core, full,
                             packed(place - base, first - base, last - base), shared.value)

    return with_row_key(docs).select("doc_id", ROW, "text").mapInArrow(
        make, f"doc_id {doc_type(docs)}, {ROW} long, core long, full long, spot long")


def block_rows(undecided: DataFrame, size: int, bitmap: np.ndarray | None = None) -> DataFrame:
    """Blocks of ``size`` positions of the undecided ones (doc_id, row, body, spots), counted from
    their anchor."""
    shared = undecided.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch, texts in unpacked_slices(batches, 2):
            body = Bytes(texts)
            spots = batch.column(3)
            text = np.repeat(np.arange(batch.num_rows), list_sizes(spots))
            place, first, last = unpacked(spots.flatten().to_numpy(zero_copy_only=False))
            low, high = (place - last) // size, (place - first) // size
            many = high - low + 1
            of = np.repeat(np.arange(len(place)), many)
            step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            number = low[of] + step
            text, place = text[of], place[of]
            base = body.offsets[text]
            until = place - number * size  # the last position of the block
            since = until - size + 1
            begin = np.maximum(since, first[of])
            end = np.minimum(until, last[of])
            core = mixed(body.hashes(base + until, base + since + LENGTH)
                         + number.astype(np.uint64))
            full = body.reach(text, base + since, base + until + LENGTH, base + until)
            yield group_rows(batch, text, core, full, packed(place, begin, end), shared.value)

    return undecided.select("doc_id", ROW, "body", "spots").mapInArrow(
        make, f"doc_id {doc_type(undecided)}, {ROW} long, core long, full long, spot long")


def list_sizes(lists: pa.Array) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def position_rows(undecided: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """One row per undecided position: the ranks of its two halves of 100 bytes."""
    half = LENGTH // 2
    shared = undecided.sparkSession.sparkContext.broadcast(bitmap)

    def make(batches: Iterator[pa.RecordBatch]):
        for batch, texts in unpacked_slices(batches, 2):
            body = Bytes(texts)
            spots = batch.column(3)
            text = np.repeat(np.arange(batch.num_rows), list_sizes(spots))
            _, first, last = unpacked(spots.flatten().to_numpy(zero_copy_only=False))
            many = last - first + 1
            of = np.repeat(np.arange(len(first)), many)
            step = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            place, text = first[of] + step, text[of]
            at = body.offsets[text] + place
            yield group_rows(batch, text, body.hashes(at, at + half),
                             body.hashes(at + half, at + LENGTH), packed(place, place, place),
                             shared.value)

    return undecided.select("doc_id", ROW, "body", "spots").mapInArrow(
        make, f"doc_id {doc_type(undecided)}, {ROW} long, core long, full long, spot long")


def core_filter(ranks: DataFrame) -> np.ndarray:
    """Bitmap of the ranks in ``core``, by their low bits."""
    return key_filter(ranks.select(F.col("core").bitwiseAND(F.lit(FILTER_BITS - 1)).alias("slot")))


def decide(make, name: str) -> DataFrame:
    """(doc_id, row, spot, same) of the groups whose common string occurs more than once.

    ``same``: every place with that string agrees on all bytes of the group.  Ranks are folded
    in the map tasks; the join back is of two plain sides, so a hot rank is split at run time.
    """
    ranks = stored(make(None).groupBy("core").agg(
        F.count("*").alias("n"), F.min("full").alias("least"), F.max("full").alias("most"))
        .filter("n > 1").select("core", (F.col("least") == F.col("most")).alias("same")),
        f"{name}-ranks")
    return stored(make(core_filter(ranks)).join(ranks, "core").select(
        "doc_id", ROW, "spot", "same"), f"{name}-groups")


def with_texts(docs: DataFrame, groups: DataFrame, name: str) -> DataFrame:
    """(doc_id, row, body, spots): undecided groups with the packed texts that they are in."""
    lists = stored(groups.filter("not same").groupBy("doc_id", ROW).agg(
        F.array_distinct(F.collect_list("spot")).alias("spots")), f"{name}-lists")
    return stored(same_document(picked(docs, row_filter(lists)), lists, "inner"),
                  f"{name}-texts")


def row_filter(rows: DataFrame):
    return rows.sparkSession.sparkContext.broadcast(
        key_filter(rows.select(key_slot("doc_id", ROW).alias("slot"))))


def picked(docs: DataFrame, bitmap) -> DataFrame:
    """(doc_id, row, body): packed texts of the rows that may be in the bitmap."""
    def pick(batches: Iterator[pa.RecordBatch]):
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in (part for b in freed(batches) for part in slices(b)):
            found = in_filter(bitmap.value, batch.column(3).to_numpy(zero_copy_only=False))
            kept = batch.filter(pa.array(found))
            yield pa.RecordBatch.from_arrays(
                [kept.column(0), kept.column(1),
                 pa.array([pack(t) for t in texts_of(kept.column(2))], pa.binary())],
                ["doc_id", ROW, "body"])

    return with_row_key(docs).select(
        "doc_id", ROW, "text", key_slot("doc_id", ROW).alias("slot")).mapInArrow(
        pick, f"doc_id {doc_type(docs)}, {ROW} long, body binary")


def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; free Arrow memory goes back after each, since workers are kept."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def unpacked_slices(batches: Iterator[pa.RecordBatch], column: int
                    ) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with their texts, cut by the size of the unpacked texts: repeats pack very well."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in freed(batches):
        first, texts, size = 0, [], 0
        for k in range(batch.num_rows):
            texts.append(unpack(batch.column(column)[k].as_py()))
            size += len(texts[-1])
            if size >= SLICE or k + 1 == batch.num_rows:
                yield batch.slice(first, k + 1 - first), texts
                first, texts, size = k + 1, [], 0


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, row, spot): ranges of repeated positions."""
    anchors = decide(lambda bitmap: anchor_rows(docs, bitmap), "anchors")
    found, groups = [anchors], anchors
    for size in BLOCKS:
        texts = with_texts(docs, groups, f"blocks-{size}")
        groups = decide(lambda bitmap: block_rows(texts, size, bitmap), f"blocks-{size}")
        found.append(groups)
    texts = with_texts(docs, groups, "positions")
    pairs = stored(position_rows(texts).groupBy("core", "full").agg(
        F.count("*").alias("n")).filter("n > 1").select("core", "full"), "pairs")
    places = stored(position_rows(texts, core_filter(pairs)).join(
        pairs, ["core", "full"]).select("doc_id", ROW, "spot"), "places")
    for groups in found:
        places = places.unionByName(groups.filter("same").select("doc_id", ROW, "spot"))
    return places


def cover(size: int, spots: np.ndarray) -> np.ndarray:
    """Which bytes the ranges of positions cover."""
    _, first, last = unpacked(spots)
    edge = np.bincount(first, minlength=size + 1) - np.bincount(
        last + LENGTH, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, removed spans (byte offsets, end exclusive) and the bytes that stay."""
    docs = docs.select("doc_id", "text")
    lists = stored(repeated_ranges(docs).groupBy("doc_id", ROW).agg(
        F.collect_list("spot").alias("spots")), "repeats")
    bitmap = row_filter(lists)
    hit = same_document(picked(docs, bitmap), lists).select("doc_id", "body", "spots")
    schema = (f"doc_id {doc_type(docs)}, n_bytes long, removed array<struct<start:long,end:long>>, "
              "kept binary")

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch, texts in unpacked_slices(batches, 1):
            yield cut_rows(batch.column(0), texts, batch.column(2))

    def whole(batches: Iterator[pa.RecordBatch]):
        for batch in (part for b in freed(batches) for part in slices(b)):
            found = in_filter(bitmap.value, batch.column(2).to_numpy(zero_copy_only=False))
            rest = batch.filter(pa.array(~found))
            yield cut_rows(rest.column(0), texts_of(rest.column(1)), None)

    clean = with_row_key(docs).select("doc_id", "text", key_slot("doc_id", ROW).alias("slot"))
    return hit.mapInArrow(cut, schema).unionByName(clean.mapInArrow(whole, schema))


def cut_rows(ids: pa.Array, texts: list[bytes], spots: pa.Array | None) -> pa.RecordBatch:
    removed, kept = [], []
    for k, body in enumerate(texts):
        if spots is None or not spots[k].is_valid:
            removed.append([])
            kept.append(body)
            continue
        gone = cover(len(body), spots[k].values.to_numpy(zero_copy_only=False))
        starts, ends = spans_where(gone)
        removed.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), ends.tolist())])
        kept.append(np.frombuffer(body, np.uint8)[~gone].tobytes())
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.list_(span)),
         pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])


def repeat_report(docs: DataFrame) -> DataFrame:
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The digest columns by counting every string of ``length`` bytes; for small tests."""
    bodies = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for body in bodies:
        for p in range(len(body) - length + 1):
            part = body[p:p + length]
            seen[part] = seen.get(part, 0) + 1
    out = []
    for body in bodies:
        gone = np.zeros(len(body), bool)
        for p in range(len(body) - length + 1):
            if seen[body[p:p + length]] > 1:
                gone[p:p + length] = True
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        out.append((len(body), int(gone.sum()), len(spans_where(gone)[0]),
                    hashlib.sha256(kept).hexdigest()))
    return out
