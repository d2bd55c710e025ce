"""N-gram Jaccard join by T-occurrence search (DivideSkip).

A document is its set of distinct 5-word shingles.  Two sets link at a similarity of 4/5 or more.

1. Rows with equal sets are one set, told by its hash; they are linked by definition.
2. Prefix rows: in one global order of shingles (those common in a sample last, then by hash) two
   linked sets share a tenth of their size among the first three tenths of the larger and the
   first two ninths of the smaller one, its early part.  Sets with fewer shingles that are shared
   so link with nothing.  In each band of sizes a shared shingle names a hub, the smallest set that
   is left with it, so both partners of a link meet in the block of a hub.  Such a block holds mostly
   sets that share something with the hub and little with each other.  It is cut by its prefix
   shingles alone, before any text moves: sets that share enough of them for a link are candidates,
   and each component of candidates is a block of its own.
3. In a block, members that link with the hub need no search: they are in its component.  Each
   other member searches the block's inverted lists: short lists are merged and counted, long
   ones probed by binary search, and sets that reach the required overlap are kept.  A large block
   is cut into shards of near sizes and bounded bytes, and its searching members into chunks; a
   chunk visits the shards whose sizes can link with its own, as a stream past the lists.
4. Components of the links, by star steps in tables.

Nothing depends on the sample but speed.  Null or empty texts have no shingles and link with nothing;
fewer than five words make one shingle.  Rows that repeat another are linked with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (ROW, in_filter, key_filter, key_slot, map_batches, mixed, packed,
                                 range_hashes, same_document, slices, stored, texts_of, unpacked,
                                 with_row_key)
from tidemark.llm.components import connected_components
from tidemark.llm.features import joined, lowered

WORDS = 5
UP, DOWN = 4, 5  # the threshold as a fraction
SHARD_BYTES = 3 << 20
CHUNK_SHARDS = 4  # a chunk of searching sets is streamed, so it may be larger than a shard
PROBE_COST = 25  # of one binary search, in entries of a list that is counted
BLOCK_SHINGLES = 2 << 20  # a block of more shared prefix shingles is not cut into candidates
CLASS_BASE = 1.3  # sizes of linked sets differ by at most 5 / 4, so by at most one class
SAMPLE_ROWS = 4000
EXTRA = 10
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text."""
    if not texts:
        return []
    data, offsets = joined(texts, b" ")
    data = lowered(data)
    space = _SPACE[data]
    edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = range_hashes(data, starts, ends)
    cut = np.searchsorted(starts, offsets)
    run = hashes
    for k in range(1, words):
        run = mixed(run[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:] + np.uint64(k)) if len(
            run) > 1 else run[:0]
    out = []
    for a, b in zip(cut, cut[1:]):
        if b - a >= words:
            out.append(np.unique(run[a:b - words + 1]))
        elif b > a:
            part = np.concatenate((hashes[a:b], [np.uint64(b - a)]))
            out.append(np.array([xxhash.xxh3_64_intdigest(part.tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(values: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(values.tobytes()) - (1 << 63)


def need(n: int) -> int:
    """The overlap that any partner of a set of n must have."""
    return -(-UP * n // DOWN)


def prefix_sizes(n: int) -> tuple[int, int]:
    """Length of the prefix, and how many of its shingles any partner must have in its own.

    Two sets that share ``need`` shingles share m of the first ``n - need + m`` of each.  With
    m = 1 + n / 10, a partner, which has at least ``need(n)`` shingles, has at least the m of that size.
    """
    return n - need(n) + 1 + n // EXTRA, 1 + need(n) // EXTRA


def early_sizes(n: int) -> tuple[int, int]:
    """The same for partners of at least n shingles: they share 8 / 9 of n, and the m of size n."""
    return n - -(-2 * UP * n // (UP + DOWN)) + 1 + n // EXTRA, 1 + n // EXTRA


def common_shingles(docs: DataFrame, rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Shingles in at least 1 % of a sample: at most 100 times the mean size of a set."""
    step = max(1, docs.count() // rows)
    sample = with_row_key(docs).filter(F.pmod(F.xxhash64("doc_id", ROW), F.lit(step)) == 0)

    def tell(batch: pa.RecordBatch):
        sets = shingle_sets(texts_of(batch.column(0)))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["s"])

    counts = map_batches(sample.select("text"), tell, "s long").groupBy("s").count()
    least = max(10, min(rows, docs.count() // step) // 100)
    found = counts.filter(F.col("count") >= least).select("s").toPandas()
    return np.sort(found["s"].to_numpy(np.int64).view(np.uint64))


def prefixes(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, row, n, set, shared shingles that a link needs with a smaller and with a larger
    set, length of the early part, prefix) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch):
        known = shared.value
        sizes, ids, firsts = [], [], []
        least, least_early, early = [], [], []
        for values in shingle_sets(texts_of(batch.column(2))):
            n = len(values)
            sizes.append(n)
            ids.append(set_id(values))
            if not n:
                for column in (least, least_early, early):
                    column.append(0)
                firsts.append(np.zeros(0, np.int64))
                continue
            if len(known):
                at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                hot = known[at] == values
                ordered = np.concatenate((values[~hot], values[hot]))
            else:
                ordered = values
            long, shared_there = prefix_sizes(n)
            least.append(shared_there)
            for column, value in zip((early, least_early), early_sizes(n)):
                column.append(value)
            firsts.append(ordered[:long].view(np.int64))
        ends = np.cumsum([0] + [len(f) for f in firsts])
        lists = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()),
            pa.array(np.concatenate(firsts) if firsts else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
             pa.array(ids, pa.int64()), *[pa.array(x, pa.int32()) for x in (
                 least, least_early, early)], lists],
            ["doc_id", ROW, "n", "sid", "least", "least_early", "early", "prefix"])

    narrow = with_row_key(docs).select("doc_id", ROW, F.col("text").alias("__text"))
    return map_batches(narrow, cut, f"doc_id {kind}, {ROW} long, n long, sid long, least int, "
                       "least_early int, early int, prefix array<long>")


def shared_only(rows: DataFrame) -> DataFrame:
    """The shingles ``h`` that more than one set of a band of sizes has, and the smallest of these sets."""
    return rows.groupBy("h", "band").agg(F.min("sid").alias("hub"), F.max("sid").alias("top")).filter(
        "hub <> top").select("h", "band", "hub")


def bands(n: str) -> Column:
    """One or two bands of sizes, such that two sets that may link have a common one: a set of n
    shingles and one of at most 5 / 4 of it share the band of the larger set."""
    return F.array_distinct(F.array(*[F.length(F.bin(F.expr(x))) for x in (n, f"{n} * {DOWN} div {UP}")]))


def candidate_labels(sizes: np.ndarray, owners: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """A label for each set of a block: sets of different labels have no link.

    ``owners`` and ``shingles`` have the shared prefix shingles of the sets.  Two sets are candidates if
    they share enough of them for a link and their sizes allow one; labels are the components of that.
    A set that got a label meets only those that have none, and leaves the lists.
    """
    count = len(sizes)
    names = np.unique(shingles, return_inverse=True)[1]
    twice = np.bincount(names)[names] > 1
    names, owners = names[twice], owners[twice]
    by_owner = np.argsort(owners, kind="stable")
    own = names[by_owner]
    cut = np.searchsorted(owners[by_owner], np.arange(count + 1))
    order = np.argsort(names, kind="stable")
    held, members = names[order], owners[order]
    width = int(names.max()) + 1 if len(names) else 0
    labels = np.full(count, -1, np.int64)

    def index() -> tuple[np.ndarray, np.ndarray]:
        length = np.bincount(held, minlength=width)
        return np.cumsum(length) - length, length
    begin, length = index()
    gone = 0
    for first in range(count):
        if labels[first] >= 0:
            continue
        labels[first] = first
        queue = [first]
        while queue:
            k = queue.pop()
            gone += cut[k + 1] - cut[k]
            if 2 * gone > len(held):
                stay = labels[members] < 0
                held, members, gone = held[stay], members[stay], 0
                begin, length = index()
            mine = own[cut[k]:cut[k + 1]]
            many = length[mine]
            met = members[np.arange(int(many.sum())) + np.repeat(
                begin[mine] - np.cumsum(many) + many, many)]
            if len(met) * 8 < count:
                found, shared = np.unique(met, return_counts=True)
            else:
                shared = np.bincount(met, minlength=count)
                found = np.flatnonzero(shared)
                shared = shared[found]
            low, high = np.minimum(sizes[found], sizes[k]), np.maximum(sizes[found], sizes[k])
            hits = found[(shared >= 1 + low // EXTRA) & (DOWN * low >= UP * high) & (labels[found] < 0)]
            labels[hits] = first
            queue += hits.tolist()
    return labels


def candidate_blocks(rows: Iterator[pa.RecordBatch], limit: int = BLOCK_SHINGLES
                     ) -> Iterator[pa.RecordBatch]:
    """(hub, sid): the candidate components of each sorted block (hub, band), under their smallest set.

    A block with more than ``limit`` shared shingles stays whole, under its first set.
    """
    def block(hubs: np.ndarray, sids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(hubs), pa.array(sids)], ["hub", "sid"])

    def ended(held: list) -> Iterator[pa.RecordBatch]:
        sids, sizes, counts, flat = (np.concatenate(x) for x in zip(*held))
        if len(sids) > 1:
            labels = candidate_labels(sizes, np.repeat(np.arange(len(sids)), counts), flat)
            several = np.bincount(labels, minlength=len(sids))[labels] > 1
            # sets are sorted, so the label of a component is the number of its smallest set
            yield block(sids[labels[several]], sids[several])

    key, held, size, first = None, [], 0, None
    for part in (p for batch in rows for p in slices(batch)):
        pa.default_memory_pool().release_unused()
        hubs, band, sids, sizes = (part.column(k).to_numpy() for k in range(4))
        ends = part.column(4).offsets.to_numpy()
        flat = part.column(4).values.to_numpy()
        edges = np.flatnonzero((hubs[1:] != hubs[:-1]) | (band[1:] != band[:-1])) + 1
        for a, b in zip([0, *edges], [*edges, len(hubs)]):
            if (hubs[a], band[a]) != key:
                if held:
                    yield from ended(held)
                key, held, size, first = (hubs[a], band[a]), [], 0, sids[a]
            held.append((sids[a:b], sizes[a:b], np.diff(ends[a:b + 1]), flat[ends[a]:ends[b]].copy()))
            size += ends[b] - ends[a]
            if size > limit:
                whole = np.concatenate([x[0] for x in held])
                yield block(np.full(len(whole), first), whole)
                held = []
    if held:
        yield from ended(held)


def block_members(rows: DataFrame) -> DataFrame:
    """(hub, sid): the sets that may have a link, in blocks that hold both sets of each link."""
    exploded = rows.select("sid", F.col("n").cast("int").alias("n"), "early", F.posexplode(
        "prefix").alias("at", "h")).withColumn("soon", F.col("at") < F.col("early")).drop("at", "early")
    soon = F.when(F.col("soon"), F.col("sid"))
    # of the two sets of a link, the smaller one has the shingle in its early part
    shared = stored(exploded.groupBy("h").agg(
        F.min("sid").alias("low"), F.max("sid").alias("top"), F.min(soon).alias("soon_low"),
        F.max(soon).alias("soon_top")).filter("low <> top and soon_low is not null").select(
        "h", (F.col("soon_low") != F.col("soon_top")).alias("soon_twice")), "shared")
    # a set's list is bounded by its prefix, and equal sets fold in the map tasks
    use = F.struct("h", "soon", (~F.col("soon") | F.col("soon_twice")).alias("late"))
    least = f"1 + (({UP} * n + {DOWN - 1}) div {DOWN}) div {EXTRA}"  # as in prefix_sizes
    able = stored(exploded.join(shared, "h").groupBy("sid", "n").agg(
        F.collect_set(use).alias("uses")).filter(
        f"size(filter(uses, u -> u.soon)) >= 1 + n div {EXTRA}"
        f" or size(filter(uses, u -> u.late)) >= {least}").select(
        "sid", "n", F.col("uses.h").alias("hs")), "able")
    left = able.select("sid", "n", F.explode(bands("n")).alias("band"), "hs").select(
        "sid", "n", "band", F.explode("hs").alias("h"))
    hubs = stored(shared_only(left), "hubs")
    met = left.join(hubs, ["h", "band"]).groupBy("sid", "n", "band").agg(
        F.collect_set("h").alias("hs"), F.collect_set("hub").alias("hubs")).filter(f"size(hs) >= {least}")
    rows_of_blocks = met.select(F.explode("hubs").alias("hub"), "band", "sid", "n", "hs")
    return rows_of_blocks.repartition("hub", "band").sortWithinPartitions(
        "hub", "band", "sid").mapInArrow(candidate_blocks, "hub long, sid long").distinct()


def bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, body): the packed text of the representative row of each set in ``wanted``.

    A packed text is a third of its shingle hashes, which the tasks make again.
    """
    import zstandard
    bitmap = docs.sparkSession.sparkContext.broadcast(
        key_filter(wanted.select(key_slot("doc_id", ROW).alias("slot"))))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pick(batch: pa.RecordBatch):
        slots = batch.column(0).to_numpy(zero_copy_only=False)
        part = batch.take(pa.array(np.flatnonzero(in_filter(bitmap.value, slots))))
        pack = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_arrays(
            [part.column(1), part.column(2),
             pa.array([pack(t) for t in texts_of(part.column(3))], pa.binary())],
            ["doc_id", ROW, "body"])

    rows = with_row_key(docs).select(
        key_slot("doc_id", ROW).alias("slot"), "doc_id", ROW, F.col("text").alias("__text"))
    made = map_batches(rows, pick, f"doc_id {kind}, {ROW} long, body binary")
    return same_document(made, wanted, "inner").select("sid", "body")


class Lists:
    """Inverted lists of some sets, searched for all sets that share enough with a query."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.inside = np.ones(len(sets), bool)
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.lexsort((owner, flat))
        self._index(flat[order], owner[order])

    def _index(self, flat: np.ndarray, owners: np.ndarray) -> None:
        self.tokens, self.begin, self.length = np.unique(
            flat, return_index=True, return_counts=True)
        self.owners = owners
        # list number and owner in one sorted array, so one binary search probes a list
        self.keys = np.repeat(np.arange(len(self.tokens)), self.length) * len(self.sizes) + owners

    def drop(self, gone: np.ndarray) -> None:
        """Take the sets of a mask out of the lists."""
        stay = ~gone[self.owners]
        self.inside &= ~gone
        self._index(np.repeat(self.tokens, self.length)[stay], self.owners[stay])

    def search(self, query: np.ndarray, own: int = -1, gone: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the sets, but ``own`` and those of a mask, with a similarity of at least UP / DOWN."""
        if not len(self.tokens):
            return np.zeros(0, np.int64)
        if own >= 0 and not self.inside[own]:
            own = -1
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        lists = at[self.tokens[at] == query]
        length = self.length[lists] - (own >= 0)
        lists, length = lists[length > 0], length[length > 0]
        least = need(len(query))
        if len(lists) < least:
            return np.zeros(0, np.int64)
        lists = lists[np.argsort(length, kind="stable")]
        # the longest lists are only probed: fewer of them than the overlap that is needed
        probed = min(least - 1, int(least / (0.01 * np.log2(length.max() + 2) + 1)))
        merge, probe = lists[:len(lists) - probed], lists[len(lists) - probed:]
        counts = self._count(merge)
        if own >= 0:
            counts[own] = 0
        found = np.flatnonzero(counts >= least - probed)
        found = found[(DOWN * self.sizes[found] >= UP * len(query))
                      & (UP * self.sizes[found] <= DOWN * len(query))]
        if gone is not None:
            found = found[~gone[found]]
        if len(found) * len(probe) * PROBE_COST > self.length[probe].sum():
            overlap = (counts + self._count(probe))[found]
        else:
            overlap = np.array([counts[k] + self._probe(probe, k) for k in found], np.int64)
        union = self.sizes[found] + len(query) - overlap
        return found[DOWN * overlap >= UP * union]

    def _count(self, lists: np.ndarray) -> np.ndarray:
        """In how many of the lists each owner is."""
        many = self.length[lists]
        places = np.arange(int(many.sum())) + np.repeat(
            self.begin[lists] - np.cumsum(many) + many, many)
        return np.bincount(self.owners[places], minlength=len(self.sizes))

    def _probe(self, lists: np.ndarray, owner: int) -> int:
        """In how many of the lists the owner is."""
        wanted = lists * len(self.sizes) + owner
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return int(np.count_nonzero(self.keys[at] == wanted))


class Forest:
    """Joins that connect what was not connected before, within one block."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, k: int) -> int:
        while (up := self.parent.setdefault(k, k)) != k:
            self.parent[k] = k = self.parent[up]
        return k

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        self.parent[x] = y
        return x != y


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * shared >= UP * (len(a) + len(b) - shared)


def tree_links(sets: list[np.ndarray], lists: Lists) -> list[tuple[int, int]]:
    """Links that connect what is connected by any, with all links of a set before those of the next.

    A set is searched among those that no link has reached yet, and the others leave the lists, so sets
    of one component are not compared with each other.
    """
    out = []
    gone = np.zeros(len(sets), bool)
    for first in range(len(sets)):
        if gone[first]:
            continue
        gone[first] = True
        queue = [first]
        while queue and not gone.all():
            k = queue.pop()
            hits = lists.search(sets[k], k, gone)
            gone[hits] = True
            queue += hits.tolist()
            out += [(k, j) for j in hits.tolist()]
            if 2 * lists.sizes[lists.inside & gone].sum() > lists.sizes[lists.inside].sum():
                lists.drop(gone)
    return out


def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Runs of rows with equal (hub, shard) from sorted batches: (sid, set, role, shards)."""
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    key = None

    def made(block: dict) -> list:
        return [(r["sid"], shingle_sets([unpack(r["body"])])[0], r["role"], r["shards"])
                for r in block.values()]
    held = {}
    for batch in (part for b in rows for part in slices(b)):
        pa.default_memory_pool().release_unused()
        for row in batch.to_pylist():
            now = (row["hub"], row["shard"])
            if now != key and held:
                yield key[0], made(held)
                held = {}
            key = now
            # rows that repeat the representative bring the same set again
            held[row["sid"], row["role"]] = row
    if held:
        yield key[0], made(held)


LINK = "a long, b long, hub long, pending boolean"


def link_rows(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
    names = ["a", "b", "hub"]
    arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
    return pa.RecordBatch.from_arrays(
        [*arrays, pa.array([r[3] for r in rows], pa.bool_())], [*names, "pending"])


def first_links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with the hub; in a block of one shard also those of the other members, as far as
    they connect anything."""
    for hub, held in blocks(rows):
        center = next(v for s, v, _, _ in held if s == hub)
        others = [(s, v) for s, v, _, _ in held if s != hub]
        near = [linked(v, center) for _, v in others]
        if held[0][3] == 1 and not all(near):
            ids, sets = zip((hub, center), *others)
            out = [(ids[k], ids[j], hub, False) for k, j in tree_links(sets, Lists(sets))]
        else:
            out = [(s, hub, hub, not close) for (s, _), close in zip(others, near)]
        if out:
            yield link_rows(out)


def shard_links(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the members of a shard (role 0) and those of a chunk (role 1).

    Only the shard is held; the sorted rows of the chunk follow it and are searched one by one.  Links
    inside the shard come first; a set that links with the first set of a component is not compared with
    the others.
    """
    import zstandard
    unpack = zstandard.ZstdDecompressor().decompress
    key = None
    for part in (p for batch in rows for p in slices(batch)):
        pa.default_memory_pool().release_unused()
        out = []
        for row in part.to_pylist():
            now = (row["hub"], row["shard"], row["chunk"])
            if now != key:
                key, own, lists, forest, last = now, {}, None, Forest(), None
                ids, label, heads, first = [], None, None, None
            s = row["sid"]
            # rows that repeat the representative bring the same set again
            if s in own if row["role"] == 0 else s == last or not own:
                continue
            values = shingle_sets([unpack(row["body"])])[0]
            if row["role"] == 0:
                own[s] = values
                continue
            if lists is None:
                ids, sets = list(own), list(own.values())
                label = np.arange(len(ids))
                for k, j in tree_links(sets, Lists(sets)):
                    label[j] = label[k]
                    forest.join(ids[j], ids[k])
                    out.append((ids[j], ids[k], row["hub"], False))
                lists = Lists(sets)
                heads = np.flatnonzero(np.bincount(label, minlength=len(ids)) > 1)
                first = Lists([sets[k] for k in heads]) if len(heads) else None
            last = s
            if s in own:
                continue
            met = heads[first.search(values)] if first else heads
            hits = [*met, *lists.search(values, -1, np.isin(label, met))]
            out += [(s, ids[j], row["hub"], False) for j in hits if forest.join(s, ids[j])]
        if out:
            yield link_rows(out)


def dealt(frame: DataFrame) -> DataFrame:
    cell = ["hub", "shard", "chunk"]
    return frame.select(*cell, "sid", "role", "shards", "body").repartition(
        *cell).sortWithinPartitions(*cell, "role", "sid")


def in_shards(members: DataFrame, wanted: DataFrame, shard_bytes: int) -> DataFrame:
    """(hub, sid, n, class, shards, shard); ``shards`` is 1 for a block that fits into one.

    In a larger block every class of sizes has shards of its own.
    """
    def count(by: list[str], frame: DataFrame, name: str) -> DataFrame:
        return frame.groupBy(*by).agg(
            F.ceil(F.sum("n") * 8 / F.lit(shard_bytes)).cast("int").alias(name))
    sized = members.join(wanted.select("sid", "n"), "sid")
    shards = stored(count(["hub"], sized, "shards"), "shards")
    placed = stored(sized.join(shards, "hub").withColumn("class", F.floor(
        F.log(CLASS_BASE, F.col("n").cast("double"))).cast("int")), "placed")
    large = placed.filter("shards > 1")
    cut = large.join(count(["hub", "class"], large, "parts"), ["hub", "class"]).withColumn(
        "shard", F.col("class").cast("long") * (1 << 32) + F.pmod(F.xxhash64("sid"), F.col("parts")))
    whole = placed.filter("shards = 1").withColumn("shard", F.lit(0).cast("long"))
    return stored(whole.unionByName(cut.drop("parts")), "in-shards")


def similar_links(docs: DataFrame, members: DataFrame, wanted: DataFrame,
                  shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All links that components need: (a, b) of set ids.

    ``wanted`` (sid, n, doc_id, row) has the representative row of every member.
    """
    placed = in_shards(members, wanted, shard_bytes)
    own = placed.filter("sid <> hub")
    cells = own.select("hub", "class", "shards", "shard").distinct()
    hubs = cells.select("hub", F.col("hub").alias("sid"), "shards", "shard").distinct()
    none = F.lit(0).alias("chunk")
    first_rows = own.select("hub", "sid", "shards", "shard").unionByName(hubs).select(
        "*", none, F.lit(0).alias("role"))
    first = stored(dealt(first_rows.join(bodies(docs, wanted), "sid")).mapInArrow(
        first_links, LINK), "links")
    pending = first.filter("pending").select("hub", F.col("a").alias("sid"))
    asking = stored(own.filter("shards > 1").join(pending, ["hub", "sid"], "left_semi"), "asking")
    chunks = asking.groupBy("hub", "class").agg(F.ceil(
        F.sum("n") * 8 / F.lit(CHUNK_SHARDS * shard_bytes)).cast("int").alias("chunks"))
    near = F.explode(F.array(*[F.col("class") + k for k in (-1, 0, 1)])).alias("class")
    # a chunk is named by the class of its sets too; it meets the shards of the classes around
    number = F.col("from") * F.lit(1 << 20) + F.pmod(F.xxhash64("sid"), F.col("chunks"))
    visits = asking.join(chunks, ["hub", "class"]).withColumn("from", F.col("class").cast(
        "long")).select("hub", "sid", number.alias("chunk"), near).join(
        cells, ["hub", "class"]).select(
        "hub", "sid", "shards", "shard", "chunk", F.lit(1).alias("role"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("k")
    visited = chunks.select("hub", F.col("class").cast("long").alias("from"), near, every).select(
        "hub", "class", (F.col("from") * F.lit(1 << 20) + F.col("k")).alias("chunk"))
    lists = own.filter("shards > 1").join(visited, ["hub", "class"]).select(
        "hub", "sid", "shards", "shard", "chunk", F.lit(0).alias("role"))
    again = stored(lists.unionByName(visits), "again")
    few = stored(wanted.join(again.select("sid").distinct(), "sid", "left_semi"), "few")
    second = dealt(again.join(bodies(docs, few), "sid")).mapInArrow(shard_links, LINK)
    return first.filter("not pending").select("a", "b").unionByName(second.select("a", "b"))


def labelled_rows(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, row hash, n_shingles and the label of its component."""
    docs = docs.select("doc_id", "text")
    rows = prefixes(docs, common_shingles(docs))
    narrow = stored(rows.select("doc_id", ROW, "n", "sid"), "sets-of-rows")
    members = stored(block_members(rows), "blocks")
    heads = narrow.filter("n > 0").groupBy("sid").agg(
        F.min(F.struct("doc_id", ROW)).alias("head"), F.first("n").alias("n"))
    wanted = stored(members.select("sid").distinct().join(heads, "sid").select(
        "sid", "n", "head.doc_id", f"head.{ROW}"), "wanted")
    links = similar_links(docs, members, wanted, shard_bytes)
    labels = stored(connected_components(links), "labels")
    return stored(narrow.join(labels, narrow["sid"] == labels["node"], "left").select(
        "doc_id", ROW, F.col("n").alias("n_shingles"),
        F.coalesce("label", "sid").alias("label")), "labelled")


def near_duplicates(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: doc_id, row hash, n_shingles and component_id."""
    labelled = labelled_rows(docs, shard_bytes)
    least = stored(labelled.filter("n_shingles > 0").groupBy("label").agg(
        F.min("doc_id").alias("component_id")), "least")
    full = labelled.filter("n_shingles > 0").join(least, "label")
    empty = labelled.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return full.unionByName(empty.select(*full.columns)).drop("label")


def jaccard_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of each group, with its columns: the smallest id, null last, then the smallest row
    hash, and any one of the rows that repeat both.  Empty texts are groups of their own."""
    rows = labelled_rows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)
    counted = rows.groupBy("label", "doc_id", ROW).agg(
        F.count("*").alias("times"), F.first("n_shingles").alias("n"))
    heads = counted.filter("n > 0").groupBy("label").agg(
        F.min(F.struct(place.alias("place"), "times")).alias("head")).select(
        "head.place.doc_id", f"head.place.{ROW}", "head.times")
    kept = stored(heads.unionByName(counted.filter("n = 0").select(
        "doc_id", ROW, F.lit(1).cast("long").alias("times"))), "kept")
    # rows of a repeated head are few as a rule, so only they are folded
    repeated = stored(kept.filter("times > 1"), "repeated")
    keyed = with_row_key(packed(docs, "doc_id", "text"))
    once = same_document(keyed, kept.filter("times = 1"), "left_semi")
    folded = same_document(keyed, repeated, "left_semi").dropDuplicates(["doc_id", ROW])
    return unpacked(once.unionByName(folded), docs, "doc_id", "text")


def brute_force(rows: list[tuple[int, str | None]], words: int = WORDS) -> dict[int, tuple]:
    """doc_id -> (size, component) by comparing all pairs; for small tests with unique ids."""
    import re
    sets = {}
    for key, text in rows:
        low = (text or "").encode().lower().decode()
        found = re.findall("[^\x20\x09-\x0d]+", low)
        sets[key] = ({tuple(found[i:i + words]) for i in range(len(found) - words + 1)}
                     if len(found) >= words else {tuple(found)} if found else set())
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}
