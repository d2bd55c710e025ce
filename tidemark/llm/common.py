"""Helpers shared by the training-text operators.

A document is identified by ``doc_id`` and a hash of its text (``ROW``), so a null or repeated
``doc_id`` neither drops nor multiplies rows.  Rows that repeat another one in both are the same
document and get the same result.  Only the named columns are read; other columns travel in one
struct (``packed``), so extra columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

ROW = "__row"
MASK = (1 << 64) - 1


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


REST = "__rest"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and one struct of all others, whose names then clash with nothing."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*[F.col(f"`{c}`") for c in needed],
                       *([F.struct(*rest).alias(REST)] if rest else []))


def unpacked(df: DataFrame, docs: DataFrame, *needed: str) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return df.select(*[F.col(f"`{c}`") if c in needed else F.col(REST).getField(c).alias(c)
                       for c in docs.columns])


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front as long as it is taken, in either case."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def with_row_key(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn(ROW, F.xxhash64(F.col(text)))


def same_document(left: DataFrame, right: DataFrame, how: str = "left",
                  key: str = "doc_id") -> DataFrame:
    """Join on (key, row hash), null keys included; the right side's keys are dropped."""
    r = right.withColumnRenamed(key, "__key").withColumnRenamed(ROW, "__row_r")
    on = left[key].eqNullSafe(r["__key"]) & (left[ROW] == r["__row_r"])
    return left.join(r, on, how).drop("__key", "__row_r")


def fold_of(key: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are held out from learning."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
                schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one batch, cut so that long texts do not pile up."""
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                yield from fn(part)
            del batch
            pa.default_memory_pool().release_unused()  # workers are kept, their free memory is not
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` bytes (one longer row stands alone)."""
    rows = batch.num_rows
    if not rows:
        return
    size = batch.nbytes
    if size <= limit:
        yield batch
        return
    if rows == 1:
        yield batch
        return
    half = rows // 2
    yield from slices(batch.slice(0, half), limit)
    yield from slices(batch.slice(half), limit)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


# the primes of xxhash64, fixed values
_P1 = np.uint64(11400714785074694791)
_P2 = np.uint64(14029467366897019727)
_P3 = np.uint64(1609587929392839161)
_P4 = np.uint64(9650029242287828579)
_P5 = np.uint64(2870177450012600261)


def wide_words(data: bytes) -> np.ndarray:
    """The eight bytes from each byte on, as a little-endian word; zeros follow the end."""
    return np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))


def xxh64(data: bytes, wide: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0
          ) -> np.ndarray:
    """xxhash64 of many byte ranges: under 32 bytes in lockstep, longer ones by the library."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = sizes.astype(np.uint64) + (_P5 + np.uint64(seed))
    for at in (0, 8, 16):
        live = np.flatnonzero((sizes >= at + 8) & (sizes < 32))
        k = _turn(wide[starts[live] + at] * _P2, 31) * _P1
        h[live] = _turn(h[live] ^ k, 27) * _P1 + _P4
    # the last 0 to 7 bytes: four at once, then one by one
    rest = wide[np.minimum(starts + (sizes & ~7), len(wide) - 1)]
    live = np.flatnonzero(sizes & 4)
    h[live] = _turn(h[live] ^ (rest[live] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    rest[live] >>= np.uint64(32)
    for k in range(3):
        live = np.flatnonzero((sizes & 3) > k)
        h[live] = _turn(h[live] ^ ((rest[live] >> np.uint64(8 * k)) & np.uint64(255)) * _P5, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    h ^= h >> np.uint64(32)
    for k in np.flatnonzero(sizes >= 32).tolist():
        h[k] = xxhash.xxh64_intdigest(data[starts[k]:starts[k] + sizes[k]], seed)
    return h


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """xxhash64 of byte ranges of any lengths."""
    flat = data.tobytes()
    return xxh64(flat, wide_words(flat), starts, ends - starts, seed)


class Prefix:
    """Hashes of byte ranges from one pass: polynomial prefix sums modulo 2**64.

    Fit for ranges of up to 512 bytes and where a collision does no harm: some longer texts (1024 and
    more bytes, Thue-Morse words) have equal sums for every base.  ``range_hashes`` has no such bound.
    """

    def __init__(self, data: np.ndarray, base: int = 0xD6E8FEB86659FD93):
        n = len(data)
        self._inv = pow(base, -1, 1 << 64)
        self.powers = _powers(base, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = self.sums[ends] - self.sums[starts]
        return mixed(raw * _powers(self._inv, len(self.powers))[starts])


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for the next call up to 8 M values."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 8 << 20:
            _POWERS[base] = have
    return have


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a well-known mixer)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def spans_where(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]




PLACES = 1 << 30


def hash_place(key: Column) -> Column:
    """A place in 0 .. PLACES - 1 that depends on the key only; samples take the first places."""
    return F.pmod(F.xxhash64(key), F.lit(PLACES))


def may_be_first(key: Column, limit: int, rows: Column) -> Column:
    """Whether a row can be among the first ``limit`` of ``rows`` rows by hash place.

    A fourfold margin makes a shortfall as good as impossible; what follows sorts a few times
    ``limit`` rows, whatever the size of the table.
    """
    return hash_place(key) <= F.lit(4.0 * PLACES * limit) / rows + F.lit(64.0 * PLACES) / rows


FILTER_BITS = 1 << 25


def key_slot(*cols: Column) -> Column:
    """The slot of a key in a ``key_filter``."""
    return F.pmod(F.xxhash64(*cols), F.lit(FILTER_BITS))


def key_filter(slots: DataFrame) -> np.ndarray:
    """A bitmap of the slots in column ``slot``: FILTER_BITS bits whatever the input.

    It only saves shuffling rows that cannot match; a join decides afterwards, so a full bitmap
    costs time and no result.
    """
    words = slots.groupBy(F.shiftright("slot", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("b")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    if len(words):
        out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint64)
    return out


def in_filter(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
