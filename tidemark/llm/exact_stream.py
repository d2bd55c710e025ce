"""Exact dedup as a stateful stream with a disk-backed keyed state that never expires.

Texts are equal when their bytes are, after lower-casing A-Z only; null counts as empty.  The state
holds per digest the count, the largest doc_id so far and the locator (file and row hash) of that
row's content.  It is kept by the RocksDB state store, so it may be larger than memory.  A digest seen
more than once is only a hit: the full bytes of its rows are compared with the located content,
and rows that differ are grouped by their bytes instead.

Of equal texts the row with the largest doc_id stays; a null doc_id is smaller than any other.
Rows that repeat doc_id and text are counted each and are kept or dropped together.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, stored, with_row_key
from tidemark.session import scratch_path

# Read when a stream starts.  Without preallocated files a store takes the disk that its keys need,
# also when there are many partitions.
STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}
TRIGGER_BYTES = 16 << 30


def normal_text(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")),
                       string.ascii_uppercase, string.ascii_lowercase)


def full_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def fingerprints(docs: DataFrame, digest: Callable[[Column], Column] = full_digest) -> DataFrame:
    """(doc_id, row, file, sha, digest) of every row; the only part of the texts the stream sees."""
    text = normal_text(F.col("text"))
    return with_row_key(docs.select("doc_id", "text")).select(
        "doc_id", ROW, F.input_file_name().alias("__file"), full_digest(text).alias("__sha"),
        digest(text).alias("__digest"))


def run_stream(spark: SparkSession, source: str, schema, checkpoint: str, sink: str,
               trigger: int = TRIGGER_BYTES) -> None:
    """Fold new fingerprints into the state and append the changed digests to ``sink``.

    A restart with the same checkpoint goes on where it stopped; a repeated micro-batch replaces
    its own folder.
    """
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", trigger).parquet(source)
    place = F.struct("doc_id", F.col("__file"), F.col(ROW))
    folded = rows.groupBy("__digest").agg(
        F.max(place).alias("__place"), F.count("*").alias("__n"))

    def emit(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        query = folded.writeStream.outputMode("update").foreachBatch(emit).option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    query.awaitTermination()


def group_places(spark: SparkSession, sink: str, like) -> DataFrame:
    """The last state of every digest: the one with the largest count."""
    changes = spark.read.schema(like).parquet(sink)
    return changes.groupBy("__digest").agg(
        F.max_by("__place", "__n").alias("__place"), F.max("__n").alias("__n"))


def dedup_stream(docs: DataFrame, digest: Callable[[Column], Column] = full_digest,
                 trigger: int = TRIGGER_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and text_sha256."""
    spark = docs.sparkSession
    source = scratch_path(spark, "dedup-source")
    sink = scratch_path(spark, "dedup-changes")
    prints = fingerprints(docs, digest)
    prints.write.parquet(source)
    prints = spark.read.schema(prints.schema).parquet(source)
    run_stream(spark, source, prints.schema, scratch_path(spark, "dedup-state"), sink, trigger)
    kind = docs.schema["doc_id"].dataType.simpleString()
    like = (f"__digest binary, __place struct<doc_id:{kind},__file:string,{ROW}:bigint>, "
            "__n bigint")
    groups = stored(group_places(spark, sink, like), "dedup-groups")

    # full bytes of the hits only; a copied text may be hot, and a join of two plain sides is
    # split at run time
    hits = groups.filter("__n > 1").select("__digest")
    text = normal_text(F.col("text"))
    bodies = stored(with_row_key(docs.select("doc_id", "text")).select(
        "doc_id", ROW, digest(text).alias("__digest"), text.alias("__text")).join(
        hits, "__digest"), "dedup-bodies")
    # all bytes of a digest are equal if the smallest and the largest text are, located content
    # included; both are folded in the map tasks, so a hot digest sends two texts per task
    differ = bodies.groupBy("__digest").agg(
        F.min("__text").alias("least"), F.max("__text").alias("most")).filter("least <> most")
    clashes = stored(differ.select("__digest"), "dedup-clashes")

    plain = prints.join(clashes, "__digest", "left_anti").join(
        groups, "__digest").select("doc_id", ROW, "__sha", F.col("__place.doc_id").alias("keep_id"),
                                   F.col("__n").alias("group_size"))
    clashed = bodies.join(clashes, "__digest").select("doc_id", ROW, "__text")
    by_bytes = stored(clashed.groupBy("__text").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "dedup-bytes")
    exact = clashed.join(by_bytes, "__text").select(
        "doc_id", ROW, full_digest(F.col("__text")).alias("__sha"), "keep_id", "group_size")
    return plain.unionByName(exact).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"))


EXACT_SQL = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') as n from documents),
g as (select n, max(doc_id) as keep_id, count(*) as group_size from t group by n)
select t.doc_id, g.keep_id, g.group_size, t.doc_id is not distinct from g.keep_id as kept,
       sha256(t.n) as text_sha256
from t join g using (n)
"""
