"""Candidate sampling and training-set assembly (SEL-01..09, SEL-25..27)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.text import clean_text, in_length_band
from tidemark.operators.dedupe import exclude_contents, keep_first
from tidemark.operators.ranking import (
    number_rows, number_within, sample_per_group, sample_rows, seeded_key,
)
from tidemark.schema import LABELS

MINORITY_IDS = (3, 4)


def conflict_candidates(df: DataFrame, track: str = "usual") -> DataFrame:
    """Contents with several labels inside a split, numbered per split by content.

    Labels are folded into a set of at most six values per content.
    """
    folded = df.groupBy("split", "content").agg(
        F.array_sort(F.collect_set("label")).alias("labels"))
    conflicts = folded.filter(F.size("labels") > 1)
    ranked = number_within(conflicts, ["split"], [F.asc("content")], "n")
    return ranked.select(
        F.format_string(f"smp-{track}-%s-conflict-%05d", "split", "n").alias("sample_id"),
        F.lit("smp_raw_conflict").alias("source"), F.lit(track).alias("track"), "split",
        "content", F.lit("").alias("current_label"),
        F.lit(-1).cast("bigint").alias("current_label_id"),
        F.to_json("labels").alias("raw_labels"),
        F.lit("cleaned_content_has_multiple_raw_labels").alias("candidate_reason"),
        F.lit(100).cast("bigint").alias("priority"))


def label_samples(df: DataFrame, n: int = 120, track: str = "usual", seed: int = 42) -> DataFrame:
    """n seeded rows of each split and label, minority labels with higher priority."""
    picked = sample_per_group(df, ["split", "label_id"], n, "id", seed, "n")
    minor = F.col("label_id").isin(*MINORITY_IDS)
    name = label_name(F.col("label_id"))
    return picked.select(
        F.format_string(f"smp-{track}-%s-%d-%05d", "split", "label_id", "n").alias("sample_id"),
        F.lit("smp_processed_label_sample").alias("source"), F.lit(track).alias("track"), "split",
        "content", name.alias("current_label"), F.col("label_id").alias("current_label_id"),
        F.to_json(F.array(name)).alias("raw_labels"),
        F.when(minor, "minority_label_sample").otherwise("boundary_label_sample")
        .alias("candidate_reason"),
        F.when(minor, 80).otherwise(60).cast("bigint").alias("priority"))


def merge_candidates(*frames: DataFrame, key: str = "content") -> DataFrame:
    """Union, best candidate per content, new rank by (priority desc, source, sample_id)."""
    stacked = frames[0]
    for f in frames[1:]:
        stacked = stacked.unionByName(f, allowMissingColumns=True)
    order = [F.desc("priority"), F.asc("source"), F.asc("sample_id")]
    return number_rows(keep_first(stacked, [key], order), order, "candidate_rank")


def business_candidates(df: DataFrame, source: str, id_column: str = "id",
                        text: str = "content", sample_size: int | None = None, seed: int = 42,
                        low: int = 4, high: int = 512, cleaner=clean_text) -> DataFrame:
    """Clean, length band, dedupe, optional seeded sample, numbered candidates."""
    cleaned = df.filter(F.col(text).isNotNull()).select(
        F.col(id_column).alias("_id"), F.col(text).alias("raw_text"),
        cleaner(F.col(text)).alias("content")).filter(in_length_band(F.col("content"), low, high))
    unique = keep_first(cleaned, ["content"], ["_id"])
    if sample_size is None:
        ranked = number_rows(unique, [F.asc("_id")], "n")
    else:
        few = sample_rows(unique, sample_size, "_id", seed)
        order = [seeded_key(seed, F.col("_id")), F.asc("_id")]
        ranked = few.withColumn("n", F.row_number().over(Window.orderBy(*order)))
    return ranked.select(
        F.format_string(f"business_{source}-%07d", "n").alias("sample_id"),
        F.lit(f"business_{source}").alias("source"), F.col("_id").cast("string").alias("source_id"),
        "content", "raw_text", F.lit("business_offline_export").alias("candidate_reason"),
        F.lit(50).cast("bigint").alias("priority"))


def eval_sample(df: DataFrame, target: int = 1500, min_per_label: int = 100, key: str = "id",
                label: str = "label_id", seed: int = 42) -> DataFrame:
    """At least ``min_per_label`` rows of each label in label order while there is room, then a
    seeded top-up to ``target``.

    One pass: every selected row is among the first ``target`` rows of its label, so the
    phases after the per-label top-n work on at most six times ``target`` rows.
    """
    order = [seeded_key(seed, F.col(key)), F.asc(key)]
    near = sample_per_group(df, [label], target, key, seed, "_r").withColumn(
        "_floor", F.col("_r") <= min_per_label)
    by_label = F.row_number().over(Window.partitionBy("_floor").orderBy(label, "_r"))
    first = near.withColumn("_first", F.col("_floor") & (by_label <= target))
    taken = F.count_if("_first").over(Window.partitionBy(F.lit(1)))
    place = F.row_number().over(Window.partitionBy("_first").orderBy(*order))
    placed = first.withColumns({"_place": place, "_taken": taken})
    return placed.filter(F.col("_first") | (F.col("_place") <= target - F.col("_taken"))).drop(
        "_r", "_floor", "_first", "_place", "_taken")


def train_pool(accepted: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Accepted rows whose content is not in the evaluation sample."""
    return exclude_contents(accepted, evaluation)


def cap_labels(df: DataFrame, per_label: int | None = None, total: int | None = None,
               key: str = "id", label: str = "label_id", seed: int = 42) -> DataFrame:
    """At most ``per_label`` seeded rows of each label, then at most ``total`` rows."""
    out = df
    if per_label is not None:
        out = sample_per_group(out, [label], per_label, key, seed, "_r").drop("_r")
    return out if total is None else sample_rows(out, total, key, seed)


def second_round_pool(existing: DataFrame, accepted: DataFrame, *excluded: DataFrame) -> DataFrame:
    """Existing pool plus newly accepted rows; the existing row wins on equal contents."""
    fresh = exclude_contents(keep_first(accepted, ["content"], ["id"]), *excluded)
    stacked = existing.withColumn("_source", F.lit(0)).unionByName(
        fresh.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return keep_first(stacked, ["content"], ["_source", "id"]).drop("_source")


def mixed_training(base: DataFrame, business: DataFrame, *excluded: DataFrame,
                   per_label: int | None = None, total: int | None = None,
                   seed: int = 42) -> DataFrame:
    """Base training rows plus capped business rows that appear in no evaluation split."""
    fresh = exclude_contents(keep_first(business, ["content"], ["id"]), *excluded)
    capped = cap_labels(fresh, per_label, total, "id", "label_id", seed)
    stacked = base.withColumn("_source", F.lit(0)).unionByName(
        capped.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return keep_first(stacked, ["content"], ["_source", "id"]).drop("_source")


def with_label_names(df: DataFrame) -> DataFrame:
    """Label name from its id; ids outside the six fail the job."""
    known = F.col("label_id").between(0, len(LABELS) - 1)
    name = F.when(known, label_name(F.col("label_id"))).otherwise(
        F.raise_error(F.lit("unknown label id")))
    return df.withColumn("label", name)
