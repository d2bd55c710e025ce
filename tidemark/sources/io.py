"""Readers and writers (SRC-01..14)."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.scoring import KEYS, merge_predictions
from tidemark.session import stored
from tidemark.sources.files import delete_folder, folder_names, path_exists
from tidemark.sources.keyindex import KeyIndex
from tidemark.sources.keyset import KeysetSource
from tidemark.sources.tables import NO_MONTH, add_month, month_of

RAW_SCHEMA = "id bigint, content string, label string"
# Fixed format: <model>-<track>-<yyyymmdd-hhmm>
RUN_NAME = r"([a-z0-9]+)-(usual|virus)-(\d{8}-\d{4})"
DEFAULT_PARTITION = "__HIVE_DEFAULT_PARTITION__"
CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def read_raw(spark: SparkSession, path: str, schema: str = RAW_SCHEMA,
             multi_line: bool = True) -> DataFrame:
    """Records of files that hold one JSON array each (or one array per line)."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def _suffix(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def _read_one(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = _suffix(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "csv":
        return reader.options(**CSV_OPTIONS).csv(path)
    if kind in ("jsonl", "ndjson"):
        return reader.json(path)
    raise ValueError(f"unsupported input format: {path}")


def read_table(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """parquet, csv, jsonl or ndjson by suffix; several inputs are stacked by column name."""
    many = [paths] if isinstance(paths, str) else paths
    frames = [_read_one(spark, p, schema) for p in many]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def keep_optional(df: DataFrame, required: list[str], optional: list[str]) -> DataFrame:
    """Required columns plus whichever optional ones exist."""
    require_columns(df, required)
    return df.select(*required, *[c for c in optional if c in df.columns and c not in required])


def export_business(df: DataFrame, keys: list[str], since: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """Texts since a time, oldest first; ``df`` already holds the newest versions."""
    kept = df.filter(F.coalesce(F.col("text_raw"), F.lit("")) != "")
    if since is not None:
        kind = df.schema["created_at"].dataType.simpleString()
        kept = kept.filter(F.col("created_at") >= F.lit(since).cast(kind))
    ordered = kept.orderBy("created_at", *keys)
    return ordered if limit is None else ordered.limit(limit)


def export_tables(frames: dict[str, DataFrame], times: dict[str, str | None], since: str | None,
                  root: str, blank: tuple[str, ...] = ("raw_json",)) -> DataFrame:
    """Write each table below ``root`` from its own lower bound on; returns the manifest."""
    spark = next(iter(frames.values())).sparkSession
    for name, df in frames.items():
        column = times.get(name)
        if since is not None and column is not None:
            kind = df.schema[column].dataType.simpleString()
            df = df.filter(F.col(column) >= F.lit(since).cast(kind))
        blanks = {c: F.lit("") for c in blank if c in df.columns}
        (df.withColumns(blanks) if blanks else df).write.mode("overwrite").parquet(f"{root}/{name}")
    return row_counts({n: spark.read.parquet(f"{root}/{n}") for n in frames})


def row_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """table, n_rows; one aggregate per table, answered from parquet footers where possible."""
    parts = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
             for name, df in frames.items()]
    return functools.reduce(DataFrame.unionByName, parts)


def reconcile_counts(manifest: DataFrame, loaded: DataFrame) -> DataFrame:
    """Expected against actual rows of each table, OK or WARN."""
    want = manifest.withColumnRenamed("n_rows", "expected")
    have = loaded.withColumnRenamed("n_rows", "actual")
    joined = want.join(have, "table", "full_outer")
    return joined.withColumn("status", F.when(
        F.col("expected").eqNullSafe(F.col("actual")), "OK").otherwise("WARN"))


def write_split(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Training rows partitioned by track and split."""
    df.hint("rebalance", "track", "split").write.mode(mode).partitionBy(
        "track", "split").parquet(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**{k: v for k, v in CSV_OPTIONS.items() if k != "multiLine"}) \
        .csv(path)


def stringify(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mixed columns as strings, nulls kept."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def pull_page(df: DataFrame, key: str, after: int, n: int) -> DataFrame:
    """The next n rows after a key; the range predicate reaches the scan."""
    return df.filter(F.col(key) > after).orderBy(key).limit(n)


def read_keyset(spark: SparkSession, path: str, key: str, schema: str, stream: bool = False,
                **options) -> DataFrame:
    """Rows of a Parquet folder in key ranges, as a batch or as a stream that goes on behind its last
    key; options as in ``keyset.KeysetSource``."""
    spark.dataSource.register(KeysetSource)
    reader = (spark.readStream if stream else spark.read).format("keyset").schema(schema)
    return reader.option("path", path).option("key", key).options(**options).load()


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel key ranges."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
            .option("numPartitions", partitions).options(**options).load())


def months_of(df: DataFrame) -> list[str]:
    """The distinct months, a short list; null is NO_MONTH."""
    return sorted(r[0] for r in df.select(month_of(F.col("month"))).distinct().collect())


def predictions_of(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """The stored predictions of some months; only their folders are read."""
    return spark.read.parquet(path).withColumn("month", month_of(F.col("month"))).filter(
        F.col("month").isin(months))


def key_index(spark: SparkSession, path: str) -> KeyIndex:
    """The key index of a prediction table, in a folder beside it."""
    return KeyIndex(spark, f"{path.rstrip('/')}-keys", KEYS)


def keys_of(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """The key columns of some months."""
    return predictions_of(spark, path, months).select(*KEYS, "month")


def complete_index(spark: SparkSession, path: str) -> KeyIndex:
    """The index with a filter for every month of the table; months that lack one are read once."""
    index = key_index(spark, path)
    held = {NO_MONTH if m == DEFAULT_PARTITION else m for m in folder_names(spark, path, "month")}
    missing = sorted(held - index.months())
    if missing:
        index.replace(stored(keys_of(spark, path, missing), "keys"), missing)
    return index


def upsert_predictions(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Merge predictions into a table partitioned by month of the source time.

    The months that receive rows are read and replaced, and those where a key was before, so a key
    whose month changes is moved.  The key index tells which other months may hold a key; only their
    key columns are read.  Rows without a source time have the month NO_MONTH; those that an earlier
    version left in the default partition are taken over with it.  The merged rows are written to
    the shared folder first, since they come from the replaced one; those of a new table are not.
    """
    def write(rows: DataFrame) -> None:
        # rebalancing gives each month few files and splits a month that holds most rows
        rows.hint("rebalance", "month").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)

    fresh = stored(add_month(new, "source_created_at"), "fresh")
    months = months_of(fresh)
    if not path_exists(spark, path):
        key_index(spark, path).replace(fresh, months)
        write(merge_predictions(fresh.limit(0), fresh))
        return
    index = complete_index(spark, path)
    keys = fresh.select(*KEYS).distinct()
    others = index.months_with(keys, months)
    if others:
        before = keys_of(spark, path, others).join(keys, list(KEYS), "left_semi")
        months = sorted({*months, *months_of(before)})
    merged = stored(merge_predictions(predictions_of(spark, path, months), fresh), "merged")
    index.add(fresh)
    write(merged)
    left = months_of(merged)
    gone = sorted(set(months) - set(left))  # every key of these has moved
    for month in [*gone, DEFAULT_PARTITION] if NO_MONTH in months else gone:
        delete_folder(spark, f"{path}/month={month}")
    index.replace(merged, left)
    index.forget(gone)


ARGS_SCHEMA = ("pretrained string, resolved_max_length int, resolved_device string, "
               "resolved_amp_dtype string")
REPORT_SCHEMA = ("macro_f1 double, accuracy double, loss double, samples bigint, "
                 "per_class_f1 array<double>, confusion_matrix array<array<bigint>>")
HISTORY_SCHEMA = "epoch int, macro_f1 double, train_time_s double, eval_time_s double"


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Artifacts of all run folders below ``root``, one row per run.

    The two documents may be indented; the history has one object per line.
    """
    def load(name: str, schema: str, whole: bool) -> DataFrame:
        reader = spark.read.schema(schema).option("multiLine", whole).option(
            "recursiveFileLookup", True).option("pathGlobFilter", name)
        return reader.json(root).withColumn("path", F.col("_metadata.file_path"))
    return join_runs(load("train_args.json", ARGS_SCHEMA, True),
                     load("final_test_report.json", REPORT_SCHEMA, True),
                     load("eval_history.jsonl", HISTORY_SCHEMA, False))


def run_parts(path: Column) -> dict[str, Column]:
    names = ("model", "track", "timestamp")
    parts = {n: F.regexp_extract(path, rf"/{RUN_NAME}(/|$)", i + 1) for i, n in enumerate(names)}
    return {**parts, "name": F.regexp_extract(path, rf"/({RUN_NAME})(/|$)", 1)}


def join_runs(args: DataFrame, reports: DataFrame, history: DataFrame) -> DataFrame:
    """Join run artifacts by the run name in their path; ``problem`` flags incomplete runs."""
    def keyed(df: DataFrame) -> DataFrame:
        named = df.withColumns(run_parts(F.col("path"))).filter(F.col("name") != "")
        return named.drop("path")
    ids = ["name", "model", "track", "timestamp"]
    have_args, have_report, have_history = keyed(args), keyed(reports), keyed(history)
    everyone = functools.reduce(DataFrame.unionByName, [
        x.select(*ids) for x in (have_args, have_report, have_history)]).distinct()
    epochs = have_history.groupBy("name").agg(
        F.count("*").alias("epochs_run"),
        F.sum(F.coalesce("train_time_s", F.lit(0)) + F.coalesce("eval_time_s", F.lit(0)))
        .alias("total_time_s"),
        F.max_by("epoch", F.struct(F.col("macro_f1"), -F.col("epoch"))).alias("best_epoch"),
        F.max("macro_f1").alias("best_macro_f1_eval"))
    marked_args = have_args.drop(*ids[1:]).withColumn("_args", F.lit(True))
    tests = have_report.select("name", *[F.col(c).alias(f"test_{c}") for c in (
        "macro_f1", "accuracy", "loss", "samples")], "per_class_f1", "confusion_matrix",
        F.lit(True).alias("_report"))
    joined = everyone.join(marked_args, "name", "left").join(tests, "name", "left").join(
        epochs, "name", "left")
    problem = F.when(F.col("_args").isNull(), "no train_args.json").when(
        F.col("_report").isNull(), "no final_test_report.json")
    return joined.withColumn("problem", problem).drop("_args", "_report")


def read_contents(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """Distinct texts of the ``content`` and ``text`` columns of many files.

    Missing, unsupported and unreadable inputs are skipped; None when nothing is left.
    """
    found = None
    lenient = {"ignoreCorruptFiles": True, "ignoreMissingFiles": True}
    for path in paths:
        kind = _suffix(path)
        if kind not in ("parquet", "csv", "jsonl", "ndjson") or not path_exists(spark, path):
            continue
        reader = spark.read.options(**lenient)
        if kind == "csv":  # columns go by the header
            df = reader.options(**CSV_OPTIONS).csv(path)
        else:
            reader = reader.schema("content string, text string")
            df = reader.parquet(path) if kind == "parquet" else reader.json(path)
        for name in ("content", "text"):
            if name in df.columns:
                part = df.select(F.col(name).cast("string").alias("content")).filter(
                    F.col("content").isNotNull())
                found = part if found is None else found.unionByName(part)
    return None if found is None else found.distinct()
