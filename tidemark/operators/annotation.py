"""Model annotations: validation, review, adjudication, relabelling (SEL-18..24, SEL-28..30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_id, normalize_label
from tidemark.functions.text import reply_json
from tidemark.operators.dedupe import keep_last
from tidemark.schema import LABELS, REVIEW_TRUE_WORDS

REPLY_FIELDS = ("label", "second_label", "confidence", "reason", "needs_human_review")


def parse_reply(df: DataFrame, reply: str = "reply") -> DataFrame:
    """Fields of the JSON object inside each model reply, as strings."""
    found = df.withColumn("_json", reply_json(F.col(reply)))
    return found.withColumns({
        f: F.get_json_object("_json", f"$.{f}") for f in REPLY_FIELDS}).drop("_json")


def validate_payload(df: DataFrame) -> DataFrame:
    """Normalise label fields; ``error`` names the first offending field, null when valid."""
    label = normalize_label(F.col("label"))
    label = F.when(label != "", label)
    second = F.coalesce(normalize_label(F.col("second_label")), F.lit(""))
    confidence = F.col("confidence").try_cast("double")
    flag = F.col("needs_human_review").cast("string")
    review = F.when(flag.isNull(), confidence < 0.75).otherwise(
        F.lower(F.trim(flag)).isin(*REVIEW_TRUE_WORDS))
    out = df.withColumns({
        "_second": second, "label": label, "confidence": confidence,
        "needs_human_review": F.coalesce(review, F.lit(False)),
        "reason": F.trim(F.coalesce(F.col("reason"), F.lit("")))})
    valid = F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return out.withColumns({
        "second_label": F.when(F.col("_second") == F.col("label"), "").otherwise(
            F.col("_second")),
        "error": F.when(F.col("label").isNull(), "label").when(~valid, "confidence"),
    }).drop("_second")


def pending(df: DataFrame, log: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows whose id has no successful entry in the log yet."""
    done = log.filter(F.col("status") == "ok").select(key).distinct()
    return df.join(done, key, "left_anti")


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled rows (status ok) and error rows."""
    good = df.filter(F.col("error").isNull()).withColumn("status", F.lit("ok"))
    bad = df.filter(F.col("error").isNotNull()).withColumn("status", F.lit("error"))
    return good.drop("error"), bad


def prompt_context(df: DataFrame, fields: list[str], text: str = "content") -> Column:
    """JSON of the sample context followed by the text, one prompt per row."""
    present = [F.col(f) for f in fields if f in df.columns]
    context = F.to_json(F.struct(*present), {"ignoreNullFields": "false"})
    return F.concat(F.lit("样本上下文："), context, F.lit("\n文本："), F.col(text))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def review_queue(primary: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Rows that need a second opinion."""
    return primary.filter(_flag("primary_needs_review") | (F.col("primary_confidence") < threshold))


def latest_reviews(review: DataFrame, order: str) -> DataFrame:
    """The last review of each sample."""
    return keep_last(review, ["sample_id"], [order])


def adjudicate(primary: DataFrame, review: DataFrame, agree: float = 0.70,
               review_high: float = 0.85, primary_high: float = 0.75) -> DataFrame:
    """Merge primary and review labels into one label and a status."""
    merged = primary.join(review, "sample_id", "left")
    first, second = F.col("primary_label_id"), F.col("review_label_id")
    first_conf = F.coalesce(F.col("primary_confidence"), F.lit(0.0))
    second_conf = F.coalesce(F.col("review_confidence"), F.lit(0.0))
    status = (
        F.when(~_flag("primary_needs_review") & (first_conf >= primary_high),
               "auto_accept_primary_high_conf")
        .when(second.isNull(), "human_required_no_review")
        .when((first == second) & (second_conf >= agree), "auto_accept_two_model_agree")
        .when((second_conf >= review_high) & ~_flag("review_needs_review"),
              "auto_accept_review_high_conf")
        .otherwise("human_required_disagree_or_low_conf"))
    keeps_first = F.col("adjudication_status").isin(
        "auto_accept_primary_high_conf", "human_required_no_review")
    return merged.withColumn("primary_review_agree", F.coalesce(first == second, F.lit(False))) \
        .withColumn("adjudication_status", status) \
        .withColumn("adjudicated_label_id", F.when(keeps_first, first).otherwise(second))


def status_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("adjudication_status").agg(F.count("*").alias("n"))


def accepted(df: DataFrame, prefix: str = "auto_accept", include_human: bool = False
             ) -> DataFrame:
    """Rows whose status starts with the prefix (optionally confirmed human rows too)."""
    status = F.col("adjudication_status")
    keep = status.startswith(prefix)
    if include_human:
        keep = keep | status.startswith("human_required")
    return df.filter(keep & F.col("content").isNotNull() & F.col("adjudicated_label_id").isNotNull())


def relabel_map(df: DataFrame, split: str, prefix: str = "auto_accept") -> DataFrame:
    """content -> new label of one split; fails on unknown labels or several labels per content."""
    part = accepted(df.filter(F.col("split") == split), prefix)
    folded = part.groupBy("content").agg(
        F.min("adjudicated_label_id").alias("new_label_id"),
        F.max("adjudicated_label_id").alias("_high"))
    sound = (F.col("new_label_id") == F.col("_high")) & F.col("new_label_id").between(
        0, len(LABELS) - 1)
    failed = F.raise_error(F.lit("illegal or conflicting relabels")).cast("boolean")
    return folded.filter(F.when(sound, True).otherwise(failed)).drop("_high")


def apply_relabels(df: DataFrame, relabels: DataFrame) -> DataFrame:
    """Rows with their new label; ``old_label_id`` keeps the previous one."""
    joined = df.withColumnRenamed("label_id", "old_label_id").join(relabels, "content", "left")
    return joined.withColumn("label_id", F.coalesce("new_label_id", "old_label_id")).drop(
        "new_label_id")


def label_changes(relabelled: DataFrame) -> DataFrame:
    return relabelled.filter(F.col("old_label_id") != F.col("label_id"))


def change_matrix(changes: DataFrame) -> DataFrame:
    return changes.groupBy("split", "old_label_id", "label_id").agg(F.count("*").alias("n"))


def to_training_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """content, label, label_id; an unknown label fails the job."""
    found = F.coalesce(label_id(F.col(label)), F.raise_error(
        F.concat(F.lit("unknown label: "), F.col(label))).cast("bigint"))
    return df.select("content", F.col(label).alias("label"), found.alias("label_id"))
