"""Structured Streaming operators (STR-01, 02, 04, 06); keyed state is in ``state`` (STR-03, 05).

Aggregating streams run in update mode into a change table: every micro-batch writes its
rows to its own folder, replacing it when the batch is replayed, and readers take the
newest batch per key.  State, checkpoints and tables live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.numeric import local_day, ratio, round_to
from tidemark.operators.dedupe import keep_last
from tidemark.operators.samples import emotion_aggregates
from tidemark.operators.scoring import Scorer, score_sources
from tidemark.session import stored
from tidemark.sources.files import path_exists
from tidemark.sources.io import months_of, predictions_of, upsert_predictions
from tidemark.sources.tables import add_month


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream with the schema of the files already there.

    ``path`` is a folder, or one file, which is then picked from its folder by name.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if is_file(spark, path):
        folder, name = path.rsplit("/", 1)
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def is_file(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(folder).isFile()


def _event_time(df: DataFrame, time: str, lateness: str) -> DataFrame:
    """Watermark on a UTC time column; watermarks need a zoned timestamp."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lateness)


def run_available(df: DataFrame, mode: str, checkpoint: str,
                  each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process everything that is available, batch by batch, then stop."""
    query = (df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(each).start())
    query.awaitTermination()
    return query


def change_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Write a micro-batch to its own folder; a replay replaces it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_changes(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current state of a change table: the newest batch of each key."""
    return keep_last(spark.read.parquet(path), keys, ["batch_id"]).drop("batch_id")


def daily_counts(events: DataFrame, time: str, label: str, lateness: str = "2 days") -> DataFrame:
    """Counts per UTC day and label; days older than the lateness bound are closed."""
    return _event_time(events, time, lateness).groupBy(
        F.window(time, "1 day").alias("w"), label).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("day"), label, "n")


def drop_repeats(versions: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """First arrival of each key within the lateness bound."""
    return _event_time(versions, time, lateness).dropDuplicatesWithinWatermark(keys)


def half_window_counts(events: DataFrame, time: str, negative: Column, half: str,
                       lateness: str = "1 day") -> DataFrame:
    """Negative events of each half window and of the one before (update mode).

    Every event counts in its own half window and, as ``previous``, in the next one.  So the state of
    a half window holds both numbers, late rows correct both, and no row looks at another one.  A half
    window without events counts as 0; only those with events of their own are shown.
    """
    at, hit = F.col(time).cast("timestamp"), negative.cast("int")
    now = F.struct(at.alias("at"), hit.alias("negative"), F.lit(0).alias("previous"), F.lit(1).alias("own"))
    later = F.struct((at + F.expr(f"interval {half}")).alias("at"), F.lit(0).alias("negative"),
                     hit.alias("previous"), F.lit(0).alias("own"))
    # the second row of an event lies one half window ahead, so the bound moves with it
    rows = events.filter(F.col(time).isNotNull()).select(F.inline(F.array(now, later))).withWatermark(
        "at", f"{lateness} {half}")
    return rows.groupBy(F.window("at", half).alias("w")).agg(
        *[F.sum(c).alias(c) for c in ("negative", "previous", "own")]).filter("own > 0").select(
        F.col("w.start").alias("start"), "negative", "previous")


def half_window_alerts(counts: DataFrame, smoothing: float = 5.0) -> DataFrame:
    """Growth of each half window over the one before, from its own row."""
    return counts.withColumn("growth", round_to(ratio(
        F.col("negative") - F.col("previous"), F.col("previous") + F.lit(smoothing)), 6))


def daily_sink(path: str, keys: tuple[str, ...] = ("model_version",)) -> Callable:
    """Maintain mergeable daily sums: each micro-batch of new predictions adds one small file.

    The sums of a batch lie in its own folder, which a replay replaces.  Sums of days add up, so
    readers need no predictions.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        day = local_day(F.col("source_created_at")).alias("day")
        batch.groupBy(*keys, day).agg(*emotion_aggregates()).coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def read_daily(spark: SparkSession, path: str, keys: tuple[str, ...] = ("model_version",)) -> DataFrame:
    """The maintained sums per key and day, over all batches."""
    parts = spark.read.parquet(path).drop("batch_id")
    return parts.groupBy(*keys, "day").agg(*[
        F.sum(c).alias(c) for c in parts.columns if c not in (*keys, "day")])


def scoring_sink(path: str, scorer: Scorer, model_version: str, cleaner) -> Callable:
    """Score the samples of a micro-batch that the table has no prediction of, and merge them in.

    What is scored is told by the table, not by the checkpoint: a replayed batch or a new
    checkpoint neither loses nor repeats a prediction.  Only the months of the batch are read.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = stored(add_month(batch.dropDuplicates(["source_type", "source_id"]),
                                 "source_created_at"), "arrived")
        done = fresh.limit(0).withColumn("model_version", F.lit(model_version))
        if path_exists(spark, path):
            done = predictions_of(spark, path, months_of(fresh))
        scored = score_sources(fresh.drop("month"), done, scorer, model_version, model_version,
                               "stream", cleaner)
        upsert_predictions(spark, path, scored.withColumn(
            "predicted_at", F.current_timestamp().cast("timestamp_ntz")))
    return write
