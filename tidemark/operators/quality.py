"""Dataset profiling and split hygiene (DQ-01..14, DQ-18)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import english_label_id
from tidemark.functions.numeric import ratio, round_to
from tidemark.functions.text import clean_text, feature_flags
from tidemark.operators.dedupe import exclude_contents, keep_first
from tidemark.operators.ranking import top_per_group
from tidemark.schema import LABELS, LABELS_EN

SPLITS = ("train", "eval", "test")
LONG_CHARS = 500


def digest(col: Column) -> Column:
    """SHA-256 of a text: its identity where only counts are needed."""
    return F.sha2(col, 256)


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows with a label and a non-empty content."""
    return df.filter(F.col("label").isNotNull() & (F.length("content") > 0))


def clean_frame(df: DataFrame, cleaner=clean_text, unknown: str = "fail") -> DataFrame:
    """Drop rows without label or content, clean, drop what became empty, add the label id.

    Unknown labels fail the job when the rows are read, or are dropped with ``unknown='drop'``.
    """
    if unknown not in ("fail", "drop"):
        raise ValueError("unknown is 'fail' or 'drop'")
    known = df.filter(F.col("label").isNotNull() & F.col("content").isNotNull())
    if unknown == "drop":
        known = known.filter(english_label_id(F.col("label")).isNotNull())
    cleaned = known.withColumn("content", cleaner(F.col("content"))).filter(
        F.length("content") > 0)
    label_id = F.coalesce(english_label_id(F.col("label")), F.raise_error(
        F.concat(F.lit("unknown label: "), F.col("label"))).cast("bigint"))
    return cleaned.withColumn("label_id", label_id)


def unknown_labels(df: DataFrame, group: str = "split") -> DataFrame:
    """Labels outside the six English names, with their counts."""
    return df.filter(F.col("label").isNotNull() & ~F.col("label").isin(*LABELS_EN)).groupBy(
        group, "label").agg(F.count("*").alias("n"))


def label_conflicts(df: DataFrame, label: str = "label_id") -> DataFrame:
    """Number of contents with several labels and of the rows they touch."""
    per_text = df.groupBy(digest(F.col("content")).alias("k")).agg(
        F.min(label).alias("low"), F.max(label).alias("high"), F.count("*").alias("n"))
    conflict = F.col("low") != F.col("high")
    return per_text.agg(
        F.count_if(conflict).alias("conflicting_contents"),
        F.coalesce(F.sum(F.when(conflict, F.col("n"))), F.lit(0)).alias("affected_rows"))


def identity(content: Column, digest: Callable[[Column], Column] = digest) -> dict[str, Column]:
    """Short columns that stand for a text in shuffle and sort keys.

    Equal digests are confirmed by an independent hash, so texts that collide in one of them stay apart.
    """
    return {"_digest": digest(content), "_check": F.xxhash64(content)}


def dedupe_content(df: DataFrame, order: str = "id", group: tuple[str, ...] = (),
                   digest: Callable[[Column], Column] = digest) -> DataFrame:
    """First row of each content (inside each group).  Texts travel, but are no key of anything."""
    keyed = df.withColumns(identity(F.col("content"), digest))
    return keep_first(keyed, [*group, "_digest", "_check"], [order]).drop("_digest", "_check")


def split_rows(df: DataFrame, split: str) -> DataFrame:
    return df.filter(F.col("split") == split)


def remove_leakage(splits: DataFrame) -> DataFrame:
    """Train rows whose content is in neither eval nor test; other splits unchanged."""
    train = exclude_contents(split_rows(splits, "train"), split_rows(splits, "eval"),
                             split_rows(splits, "test"))
    return train.unionByName(splits.filter(F.col("split") != "train"))


def clean_splits(df: DataFrame, order: str = "id",
                 digest: Callable[[Column], Column] = digest) -> DataFrame:
    """First row of each content per split, without train rows that eval or test also have.

    One aggregation by the texts' digests answers both rules: it holds at most one row per split.
    """
    carried = [c for c in df.columns if c != "split"]
    folded = df.withColumns(identity(F.col("content"), digest)).groupBy("_digest", "_check").agg(*[
        F.min_by(F.struct(*carried), F.when(F.col("split") == s, F.col(order))).alias(s)
        for s in SPLITS])
    leaked = F.col("eval").isNotNull() | F.col("test").isNotNull()
    rows = F.array_compact(F.array(*[
        F.when(F.col(s).isNotNull() & (~leaked if s == "train" else F.lit(True)),
               F.struct(F.lit(s).alias("split"), F.col(s).alias("r"))) for s in SPLITS]))
    return folded.select(F.inline(rows)).select("r.content", "split", *[
        f"r.{c}" for c in carried if c != "content"])


def overview(df: DataFrame, group: str = "split") -> DataFrame:
    """Rows, missing labels, empty contents and length min / p50 / p95 / max.

    Lengths are counted first; the percentiles see each distinct length once.
    """
    length = F.length(F.coalesce("content", F.lit("")))
    counted = df.groupBy(group, length.alias("len")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label").isNull()).alias("missing"))
    labelled = (F.col("n") - F.col("missing"))
    has = F.when(labelled > 0, F.col("len"))

    def p(q: float) -> Column:
        return F.floor(F.percentile(has, F.lit(q), F.greatest(labelled, F.lit(1)))).cast("bigint")
    return counted.groupBy(group).agg(
        F.sum("n").alias("rows"), F.sum("missing").alias("none_label"),
        F.sum(F.when(F.col("len") == 0, labelled).otherwise(0)).alias("empty_content"),
        F.min(has).alias("len_min"), p(0.5).alias("len_p50"), p(0.95).alias("len_p95"),
        F.max(has).alias("len_max"))


def label_distribution(df: DataFrame, group: str = "split") -> DataFrame:
    """Count and share of each label per group, one column pair per label."""
    counts = df.filter(F.col("label").isNotNull()).groupBy(group).agg(
        *[F.count_if(F.col("label") == x).alias(f"n_{x}") for x in LABELS_EN],
        F.count("*").alias("total"))
    return counts.withColumns({
        f"pct_{x}": round_to(ratio(F.col(f"n_{x}"), F.col("total"))) for x in LABELS_EN})


def duplicate_table(df: DataFrame, group: str = "split") -> DataFrame:
    """Valid rows, distinct contents, duplicate rows and their percentage."""
    texts = valid_rows(df).groupBy(group, digest(F.col("content")).alias("k")).agg(
        F.count("*").alias("n"))
    out = texts.groupBy(group).agg(F.sum("n").alias("valid"), F.count("*").alias("unique_texts"))
    dup = F.col("valid") - F.col("unique_texts")
    return out.withColumn("dup_rows", dup).withColumn(
        "dup_pct", round_to(ratio(dup, F.col("valid")) * 100, 2))


def text_presence(df: DataFrame) -> DataFrame:
    """Per distinct content: its row count in each split."""
    return df.groupBy(digest(F.col("content")).alias("k")).agg(*[
        F.count_if(F.col("split") == s).alias(s) for s in SPLITS])


def overlap_table(df: DataFrame) -> DataFrame:
    """Distinct contents of eval and test that also occur in train."""
    found = text_presence(valid_rows(df))
    sums = found.agg(*[x for s in SPLITS[1:] for x in (
        F.count_if((F.col("train") > 0) & (F.col(s) > 0)).alias(f"both_{s}"),
        F.count_if(F.col(s) > 0).alias(f"all_{s}"))])
    rows = F.array(*[F.struct(F.lit(s).alias("other"), F.col(f"both_{s}").alias("overlap"),
                              F.col(f"all_{s}").alias("total")) for s in SPLITS[1:]])
    return sums.select(F.inline(rows)).select(
        "other", "overlap",
        round_to(ratio(F.col("overlap"), F.col("total")) * 100, 2).alias("pct"))


def feature_table(df: DataFrame, group: str = "split") -> DataFrame:
    """Rows and share with each text feature."""
    flagged = valid_rows(df).select(group, *[
        f.alias(n) for n, f in feature_flags(F.col("content")).items()])
    names = flagged.columns[1:]
    out = flagged.groupBy(group).agg(F.count("*").alias("valid"), *[
        F.count_if(n).alias(f"n_{n}") for n in names])
    return out.withColumns({
        f"pct_{n}": round_to(ratio(F.col(f"n_{n}"), F.col("valid")) * 100, 2) for n in names})


def long_texts(df: DataFrame, group: str = "split", shown: int = 2) -> DataFrame:
    """Texts over the long limit: how many per group, and the longest ones."""
    longs = valid_rows(df).select(group, "id", "label", F.length("content").alias("len")).filter(
        F.col("len") > LONG_CHARS)
    totals = longs.groupBy(group).agg(F.count("*").alias("long_rows"))
    top = top_per_group(longs, [group], [F.desc("len"), F.asc("id")], shown, "n")
    return top.join(totals, group)


def empty_texts(df: DataFrame, group: str = "split", shown: int = 3) -> DataFrame:
    """Rows without text: how many per group, and the first ones."""
    empty = df.filter(F.length(F.coalesce("content", F.lit(""))) == 0).select(group, "id", "label")
    totals = empty.groupBy(group).agg(F.count("*").alias("empty_rows"))
    return top_per_group(empty, [group], [F.asc("id")], shown, "n").join(
        totals, group)


def length_profile(df: DataFrame, group: str = "split") -> DataFrame:
    """Length percentiles and the share of texts above the usual model limits."""
    counted = df.groupBy(group, F.length("content").alias("len")).agg(F.count("*").alias("n"))

    def p(q: float, name: str) -> Column:
        return F.floor(F.percentile("len", F.lit(q), F.col("n"))).cast("bigint").alias(name)

    def over(limit: int) -> Column:
        above = F.sum(F.when(F.col("len") > limit, F.col("n")).otherwise(0))
        return round_to(ratio(above, F.sum("n")) * 100, 2).alias(f"over_{limit}")
    return counted.groupBy(group).agg(
        F.sum("n").alias("rows"), F.min("len").alias("len_min"), p(0.5, "len_p50"),
        p(0.9, "len_p90"), p(0.95, "len_p95"), p(0.99, "len_p99"), F.max("len").alias("len_max"),
        over(128), over(192), over(256))


def split_accounting(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Per split: raw rows, rows after cleaning, dropped, duplicates, leaked, kept."""
    raws = raw.groupBy("split").agg(F.count("*").alias("raw"))
    found = text_presence(cleaned)
    leak = (F.col("train") > 0) & ((F.col("eval") > 0) | (F.col("test") > 0))
    sums = found.agg(
        *[x for s in SPLITS for x in (
            F.sum(s).alias(f"after_{s}"), F.count_if(F.col(s) > 0).alias(f"texts_{s}"))],
        F.count_if(leak).alias("leaked"))
    rows = F.array(*[F.struct(
        F.lit(s).alias("split"), F.col(f"after_{s}").alias("after_clean"),
        (F.col(f"after_{s}") - F.col(f"texts_{s}")).alias("duplicates"),
        (F.col("leaked") if s == "train" else F.lit(0).cast("bigint")).alias("leaked"),
    ) for s in SPLITS])
    per_split = sums.select(F.inline(rows))
    return raws.join(F.broadcast(per_split), "split").withColumns({
        "dropped": F.col("raw") - F.col("after_clean"),
        "kept": F.col("after_clean") - F.col("duplicates") - F.col("leaked")})
