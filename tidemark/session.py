"""Session defaults and the shared scratch location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", app: str = "tidemark") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        root = configured
    elif spark.sparkContext.master.startswith("local"):
        root = os.path.join(tempfile.gettempdir(), "tidemark-shared")
    else:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# bytes of an input file, and of a shuffle, that one task gets; what a task holds stays the same when tables grow
SPLIT_BYTES = 16 << 20
SHUFFLE_BYTES = 4 << 20


def size_tasks(spark: SparkSession, *paths: str) -> None:
    """Let the number of tasks follow the size of the facts in ``paths``.

    Adaptive execution merges small shuffle partitions and never cuts large ones that an aggregation reads,
    so it has to start from enough of them.  The setting of the session stays the least number; streams,
    whose state has a fixed number of partitions, do not use it.  Shuffle files go when the action that
    wrote them ends, not when the driver happens to collect its garbage; plans share written tables only.
    """
    files = spark.read.format("binaryFile").load(list(paths)).agg({"length": "sum"}).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
                   str(max(least, files // SHUFFLE_BYTES)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SPLIT_BYTES))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def spread(df: DataFrame) -> DataFrame:
    """Spread a small input over the cores before CPU-heavy work on its rows.

    A small file may be a single row group, hence a single task.  Inputs with at least as many
    partitions as the session has cores are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
