"""Documented query patterns over the canonical tables (DOC-01..16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio, round_to
from tidemark.operators.dedupe import keep_first
from tidemark.operators.joins import join_unique
from tidemark.operators.samples import interactions

# Post age band -> snapshots per hour inside the band.
SNAPSHOT_BANDS = (
    ("<1h", 1, 12.0), ("1-6h", 6, 2.0), ("6-24h", 24, 0.5), ("1-7d", 168, 1.0 / 12),
)
HOT_COMMENTS = 500


def since_last(df: DataFrame, column: str, interval: str) -> DataFrame:
    """Rows within an interval before the newest time of the frame (pushed to the scan)."""
    newest = df.agg(F.max(column)).scalar()
    return df.filter(F.col(column) >= newest - F.expr(f"INTERVAL {interval}"))


def recent_topic_posts(tables, topic_id: int, days: int = 7) -> DataFrame:
    """Posts of a topic in the last days, newest first."""
    links = tables.post_topic.filter(F.col("topic_id") == topic_id)
    recent = since_last(tables.post, "created_at", f"{days} DAYS")
    return recent.join(links, "post_id", "left_semi").orderBy(F.desc("created_at"), "post_id")


def snapshot_growth(engagement: DataFrame) -> DataFrame:
    """Interaction curve of each post with the gain since the previous snapshot.

    A post has at most one snapshot per second, so the window per post and day is bounded, and
    the value carried over from an earlier day comes from one row per post and day.
    """
    total = engagement.withColumn("interaction_count", interactions()).withColumn(
        "_day", F.to_date("captured_at"))
    last = total.groupBy("post_id", "_day").agg(
        F.max_by("interaction_count", "captured_at").alias("_last"))
    carried = last.select("post_id", "_day", F.lag("_last").over(
        Window.partitionBy("post_id").orderBy("_day")).alias("_carried"))
    in_day = Window.partitionBy("post_id", "_day").orderBy("captured_at")
    before = F.coalesce(F.lag("interaction_count").over(in_day), F.col("_carried"))
    return total.join(carried, ["post_id", "_day"]).withColumn(
        "gain", F.col("interaction_count") - before).drop("_day", "_carried")


def top_authors(tables, days: int = 1, limit: int = 50) -> DataFrame:
    """Most active authors of the last days with their trusted profile, null when absent."""
    counts = since_last(tables.post, "created_at", f"{days} DAYS").groupBy("user_id").agg(
        F.count("*").alias("post_cnt"))
    few = counts.orderBy(F.desc("post_cnt"), "user_id").limit(limit)
    trusted = tables.user.filter(F.col("profile_tier") >= 1)
    profiles = trusted.select(F.col("uid").alias("user_id"), "verified", "followers_count").join(
        F.broadcast(few.select("user_id")), "user_id", "left_semi")
    return few.join(profiles, "user_id", "left")


def repost_pairs(post: DataFrame) -> DataFrame:
    """Each repost with its original (one hop)."""
    reposts = post.filter(F.col("retweet_of") != 0).select(
        F.col("post_id").alias("repost_id"), F.col("user_id").alias("repost_user"),
        F.col("retweet_of").alias("original_id"))
    originals = post.select(F.col("post_id").alias("original_id"),
                            F.col("user_id").alias("original_user"), "text_raw")
    return join_unique(reposts, originals, "original_id", "repost_id", how="inner")


def earliest_discovery(discovery: DataFrame) -> DataFrame:
    """First entry of each post."""
    return keep_first(discovery, ["post_id"], ["discovered_at", "source_type", "source_value"])


def comment_inputs(tables, post_ids: DataFrame | None = None, limit: int | None = None
                   ) -> DataFrame:
    """Comments with their author profile, most liked first."""
    comments = tables.comment
    if post_ids is not None:
        comments = comments.join(post_ids, "post_id", "left_semi")
    if limit is not None:
        comments = comments.orderBy(F.desc("like_count"), "comment_id").limit(limit)
    users = tables.user.select(F.col("uid").alias("user_id"), "verified", "followers_count")
    return join_unique(comments, users, "user_id", "comment_id",
                       hot_from=tables.comment_versions.select("user_id")).select(
        "comment_id", "text_raw", "like_count", "created_at", "verified", "followers_count")


def retained(df: DataFrame, column: str, interval: str, now: Column | None = None) -> DataFrame:
    """Rows younger than the retention interval at ``now`` (default: newest row)."""
    if now is None:
        return since_last(df, column, interval)
    return df.filter(F.col(column) >= now - F.expr(f"INTERVAL {interval}"))


def age_band(hours: Column) -> Column:
    out = F.lit(">=7d")
    for name, upper, _ in reversed(SNAPSHOT_BANDS):
        out = F.when(hours < upper, name).otherwise(out)
    return out


def expected_snapshots(hours: Column) -> Column:
    """Snapshots a post of this age should have."""
    total, lower = F.lit(0.0), 0
    for _, upper, per_hour in SNAPSHOT_BANDS:
        inside = F.greatest(F.least(hours, F.lit(float(upper))) - F.lit(float(lower)), F.lit(0.0))
        total, lower = total + inside * F.lit(per_hour), upper
    return total


def snapshot_coverage(tables) -> DataFrame:
    """Observed against expected snapshots by age band at the newest snapshot."""
    newest = tables.engagement.agg(F.max("captured_at")).scalar()
    seen = tables.engagement.groupBy("post_id").agg(F.count("*").alias("observed"))
    hours = F.timestamp_diff("SECOND", F.col("created_at"), newest) / F.lit(3600.0)
    posts = tables.post.select("post_id", F.greatest(hours, F.lit(0.0)).alias("hours"))
    joined = posts.join(seen, "post_id", "left").select(
        age_band(F.col("hours")).alias("band"),
        F.coalesce("observed", F.lit(0)).alias("observed"),
        F.floor(expected_snapshots(F.col("hours")) * 1000 + 0.5).alias("expected"))
    return joined.groupBy("band").agg(
        F.count("*").alias("posts"), F.sum("observed").alias("observed"),
        (F.sum("expected") / 1000.0).alias("expected"),
    ).withColumn("coverage", round_to(ratio(F.col("observed"), F.col("expected"))))


def comment_coverage(tables) -> DataFrame:
    """Sampling tier of each post and sampled comments against the platform count."""
    newest = tables.engagement.groupBy("post_id").agg(
        F.max_by("comments_count", "captured_at").alias("platform"))
    sampled = tables.comment.groupBy("post_id").agg(F.count("*").alias("sampled"))
    tier = F.when(F.col("platform") > HOT_COMMENTS, "hot").otherwise("default")
    return newest.join(sampled, "post_id", "left").select(
        "post_id", tier.alias("tier"), "platform",
        F.coalesce("sampled", F.lit(0)).alias("sampled"),
    ).withColumn("coverage", round_to(ratio(F.col("sampled"), F.col("platform"))))


def total_spread(tables) -> DataFrame:
    """Interactions of each original plus those of its reposts."""
    newest = tables.engagement.groupBy("post_id").agg(
        F.max_by(interactions(), F.col("captured_at")).alias("n"))
    own = F.when(F.col("retweet_of") != 0, F.col("retweet_of")).otherwise(F.col("post_id"))
    rows = tables.post.select("post_id", own.alias("original_id")).join(newest, "post_id", "left")
    return rows.groupBy("original_id").agg(
        F.count("*").alias("posts"), F.coalesce(F.sum("n"), F.lit(0)).alias("spread"))


def rediscoveries(discovery: DataFrame) -> DataFrame:
    """How often each source found each post again."""
    return discovery.groupBy("post_id", "source_type").agg(
        F.count("*").alias("times"), F.min("discovered_at").alias("first_at"),
        F.max("discovered_at").alias("last_at"))


def entry_sequence(discovery: DataFrame) -> DataFrame:
    """Sources of each post in order of first entry (at most one per source type)."""
    entries = F.array_sort(F.collect_list(F.struct("first_at", "source_type")))
    return rediscoveries(discovery).groupBy("post_id").agg(
        F.array_join(F.transform(entries, lambda e: e["source_type"]), ">").alias("entry_sequence"))


def with_profile(df: DataFrame, user: DataFrame, spread: str) -> DataFrame:
    """Left join to profiles; a missing profile stays null, never 0."""
    profile = user.select(F.col("uid").alias("user_id"), "verified", "followers_count")
    return join_unique(df, profile, "user_id", spread)
