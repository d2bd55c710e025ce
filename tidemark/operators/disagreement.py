"""Agreement of two model versions over the prediction table (ML-15, ML-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.numeric import local_iso, ratio, round_to
from tidemark.schema import DEFAULTS, LABELS, Settings

_FIELDS = ("pred_label_id", "confidence", "margin")


def paired_predictions(prediction: DataFrame, s: Settings = DEFAULTS,
                       fields: tuple[str, ...] = _FIELDS) -> DataFrame:
    """Samples scored by both versions, as one row each.

    The key holds one row per version, so a grouped pivot replaces the self-join: one scan
    and one shuffle.
    """
    def of(model: str, column: str):
        return F.max(F.when(F.col("model_version") == model, F.col(column)))
    both = prediction.filter(F.col("model_version").isin(s.primary_model, s.secondary_model))
    wide = both.groupBy("source_type", "source_id").agg(
        *[of(s.primary_model, c).alias(f"primary_{c}") for c in fields],
        *[of(s.secondary_model, c).alias(f"secondary_{c}") for c in fields],
        of(s.primary_model, "post_id").alias("post_id"),
        of(s.primary_model, "source_created_at").alias("source_created_at"))
    return wide.filter("primary_pred_label_id is not null and secondary_pred_label_id is not null")


def label_grid(counts: DataFrame, row: str, column: str, n: str = "n") -> DataFrame:
    """Complete a label x label count frame with zeros (36 fixed cells)."""
    size = len(LABELS)
    cells = counts.sparkSession.range(size * size).select(
        F.floor(F.col("id") / size).cast("int").alias(row),
        (F.col("id") % size).cast("int").alias(column), F.lit(0).cast("bigint").alias(n))
    stacked = cells.unionByName(counts.select(
        F.col(row).cast("int").alias(row), F.col(column).cast("int").alias(column),
        F.col(n).cast("bigint").alias(n)))
    return stacked.groupBy(row, column).agg(F.sum(n).alias(n))


def agreement_matrix(prediction: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """36 cells of (primary label, secondary label) counts."""
    pairs = paired_predictions(prediction, s, ("pred_label_id",))
    counts = pairs.groupBy("primary_pred_label_id", "secondary_pred_label_id").agg(
        F.count("*").alias("n"))
    return label_grid(counts, "primary_pred_label_id", "secondary_pred_label_id")


def agreement_summary(matrix: DataFrame) -> DataFrame:
    same = F.col("primary_pred_label_id") == F.col("secondary_pred_label_id")
    total = matrix.agg(F.sum("n").alias("samples_total"),
                       F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agreement_count"))
    return total.withColumn("agreement_rate", round_to(
        ratio(F.col("agreement_count"), F.col("samples_total"))))


def top_disagreements(tables, limit: int, s: Settings = DEFAULTS) -> DataFrame:
    """Samples both models are sure of and disagree on, by summed confidence.

    Each source type contributes its own top rows; texts are fetched for those rows only.
    """
    pairs = paired_predictions(tables.prediction, s).filter(
        "primary_pred_label_id <> secondary_pred_label_id").withColumn(
        "total", round_to(F.col("primary_confidence").cast("double")
                          + F.col("secondary_confidence").cast("double"), 6))
    order = [F.desc("total"), F.asc("source_type"), F.asc("source_id")]

    def top(kind: str, texts: DataFrame) -> DataFrame:
        have = pairs.filter(F.col("source_type") == kind).join(
            texts.select("source_id"), "source_id", "left_semi")
        few = have.orderBy(*order).limit(max(1, limit))
        return texts.join(F.broadcast(few), "source_id")

    posts = top("post", tables.post.select(
        F.col("post_id").alias("source_id"), F.col("text_raw").alias("content")))
    comments = top("comment", tables.comment.select(
        F.col("comment_id").alias("source_id"), F.col("text_raw").alias("content")))
    best = posts.unionByName(comments).orderBy(*order).limit(limit)
    return best.select(
        F.col("source_type").alias("source"), F.col("source_id").cast("string").alias("source_id"),
        F.col("post_id").cast("string").alias("post_id"),
        local_iso(F.col("source_created_at")).alias("created_at"), "content",
        label_name(F.col("primary_pred_label_id")).alias("primary_label"),
        round_to(F.col("primary_confidence")).alias("primary_confidence"),
        round_to(F.col("primary_margin")).alias("primary_margin"),
        label_name(F.col("secondary_pred_label_id")).alias("secondary_label"),
        round_to(F.col("secondary_confidence")).alias("secondary_confidence"),
        round_to(F.col("secondary_margin")).alias("secondary_margin"))
