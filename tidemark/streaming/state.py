"""Keyed streaming state: sessions closed by the watermark, newest snapshots with time-to-live.

Rows are folded per user or post inside the map tasks first, so a hot key sends a few parts per batch
and not all its rows.  State is kept by the RocksDB store, which does not have to fit in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.samples import interactions
from tidemark.sources.files import path_exists
from tidemark.sources.keyindex import KeyIndex

STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def interval_micros(text: str) -> int:
    """Microseconds of a fixed interval such as '30 minutes'."""
    return pd.Timedelta(text) // pd.Timedelta("1 microsecond")


@contextmanager
def disk_state(spark: SparkSession, empty_batches: bool = True):
    """Streams started inside keep their state in RocksDB; the session's settings come back after.

    Without ``empty_batches`` a batch needs new rows, so no batch is run only to drop old state.
    """
    wanted = STORE | {"spark.sql.streaming.noDataMicroBatches.enabled": str(empty_batches).lower()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ------------------------------------------------------------------------- sessions
def session_parts(events: DataFrame, gap: int, user: str, time: str) -> DataFrame:
    """(user, first, last, events): rows of each batch of a map task folded where they are adjacent."""
    kind = events.schema[user].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values([user, "at"], kind="stable")
            if not len(frame):
                continue
            who, at = frame[user].to_numpy(), frame["at"].to_numpy(np.int64)
            fresh = np.ones(len(frame), bool)
            fresh[1:] = (who[1:] != who[:-1]) | (np.diff(at) >= gap)
            begin = np.flatnonzero(fresh)
            end = np.append(begin[1:], len(frame))
            yield pa.RecordBatch.from_pandas(pd.DataFrame({
                user: who[begin], "first": at[begin], "last": at[end - 1], "events": end - begin}),
                preserve_index=False)

    rows = events.filter(F.col(user).isNotNull() & F.col(time).isNotNull()).select(
        user, F.unix_micros(F.col(time).cast("timestamp")).alias("at"))
    return rows.mapInArrow(fold, f"{user} {kind}, first long, last long, events long")


def user_sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour",
                  user: str = "user_id", time: str = "ts") -> DataFrame:
    """Sessions of each user, emitted once the watermark has passed their end (append mode).

    Start the stream inside ``disk_state``.  Rows without user or time belong to no session.
    Spark's session windows merge the folded parts.  A window that starts where another ends is merged
    with it, so windows are one microsecond short and an event ``gap`` after the last one stands alone.
    """
    width = interval_micros(gap)
    parts = session_parts(events, width, user, time)
    seconds = (F.col("last") - F.col("first") + F.lit(width - 1)).cast("decimal(18,0)") / 1000000
    timed = parts.select(user, F.timestamp_micros("first").alias("at"), "events", F.make_interval(
        secs=seconds.cast("decimal(18,6)")).alias("lasts")).withWatermark("at", lateness)
    merged = timed.groupBy(user, F.session_window("at", F.col("lasts")).alias("w")).agg(
        F.sum("events").alias("events"))
    return _whole(merged, user)


def _whole(merged: DataFrame, user: str) -> DataFrame:
    """Sessions of windows that are one microsecond short."""
    return merged.select(user, F.col("w.start").alias("start"), F.timestamp_micros(
        F.unix_micros("w.end") + 1).alias("end"), "events")


def open_sessions(spark: SparkSession, checkpoint: str, user: str = "user_id") -> DataFrame:
    """The closing step: sessions that a stopped stream still holds, read from its state."""
    held = spark.read.format("statestore").load(checkpoint)
    return _whole(held.select(
        F.col(f"value.{user}").alias(user), F.col("value.session_window").alias("w"),
        F.col("value.sum").alias("events")), user)


# ------------------------------------------------------------------------ snapshots
def newest_parts(snapshots: DataFrame) -> DataFrame:
    """(post_id, captured, interactions): the newest snapshot of each post in each batch of a task."""
    kind = snapshots.schema["post_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas().sort_values(["captured", "interaction_count"], kind="stable")
            yield pa.RecordBatch.from_pandas(frame.drop_duplicates("post_id", keep="last"),
                                             preserve_index=False)

    rows = snapshots.filter(F.col("post_id").isNotNull() & F.col("captured_at").isNotNull()).select(
        "post_id", F.unix_micros(F.col("captured_at").cast("timestamp")).alias("captured"),
        F.coalesce(interactions().cast("long"), F.lit(0)).alias("interaction_count"))
    return rows.mapInArrow(fold, f"post_id {kind}, captured long, interaction_count long")


def newest_snapshots(snapshots: DataFrame, ttl: str = "7 days") -> DataFrame:
    """(post_id, captured, interaction_count, cold) of posts with a newer snapshot (update mode).

    Start the stream inside ``disk_state(spark, empty_batches=False)``.  The newest snapshot is folded per
    post and span of ``ttl`` (processing time), and a span's state goes when the watermark of the arrival
    times has passed it, so state is bounded by the posts that came within two ``ttl``.  For
    other posts the state cannot tell what is newest; they are marked ``cold`` and ``newest_sink`` looks
    them up in the change table.
    """
    arrived = newest_parts(snapshots).withColumn("arrived", F.current_timestamp()).withWatermark(
        "arrived", ttl)
    # equal snapshots: the one that came first, so a repeat is no news
    best = F.max(F.struct("captured", "interaction_count", (-F.unix_micros("arrived")).alias("since")))
    folded = arrived.groupBy("post_id", F.window("arrived", ttl)).agg(
        best.alias("best"), F.min("arrived").alias("first"), F.max("arrived").alias("now"))
    return folded.filter(F.col("best.since") == -F.unix_micros("now")).select(
        "post_id", F.col("best.captured").alias("captured"),
        F.col("best.interaction_count").alias("interaction_count"),
        (F.col("first") == F.col("now")).alias("cold"))


def newest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write the posts of a micro-batch that are newer than the change table has them.

    A key index tells which earlier batches may hold a cold post; only those are read.  A replay
    replaces its own folder and looks at earlier batches only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index = KeyIndex(spark, f"{path}-keys", ["post_id"])
        batch = batch.persist()
        cold = batch.filter("cold").select("post_id", "captured", "interaction_count")
        earlier = [m for m in index.months_with(cold) if int(m) < batch_id]
        kept = batch
        if earlier and path_exists(spark, path):
            stored = spark.read.parquet(path).filter(
                F.col("batch_id").isin([int(m) for m in earlier])).groupBy(
                F.col("post_id").alias("_post")).agg(F.max(
                    F.struct("captured", "interaction_count")).alias("_held"))
            kept = batch.join(stored, batch["post_id"] == stored["_post"], "left").filter(
                ~F.col("cold") | F.col("_held").isNull()
                | (F.struct("captured", "interaction_count") > F.col("_held")))
        kept.select("post_id", "captured", "interaction_count").write.mode("overwrite").parquet(
            f"{path}/batch_id={batch_id}")
        keys = spark.read.parquet(f"{path}/batch_id={batch_id}").select(
            "post_id", F.lit(str(batch_id)).alias("month"))
        index.replace(keys, [str(batch_id)])
        batch.unpersist()
    return write


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """Current newest snapshot of each post: the last batch that wrote it."""
    last = spark.read.parquet(path).groupBy("post_id").agg(
        F.max_by(F.struct("captured", "interaction_count"), "batch_id").alias("s"))
    return last.select("post_id", F.col("s.interaction_count").alias("interaction_count"),
                       F.timestamp_micros("s.captured").cast("timestamp_ntz").alias("as_of"))
