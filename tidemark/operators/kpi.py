"""Overview KPIs and emotion series (KPI-04..14, DQ-16, DQ-17)."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.numeric import local_day, mean_micros, ratio, round_to
from tidemark.operators.samples import (
    EMOTION_COUNTS, emotion_aggregates, interactions, latest_interactions, predictions_in,
    speakers,
)
from tidemark.operators.topics import emotion_by_day, series_of_days
from tidemark.operators.window import OFFSET, TimeWindow
from tidemark.schema import DEFAULTS, Settings


def _one(df: DataFrame, value, name: str) -> DataFrame:
    return df.agg(value.alias(name))


def posts_in(tables, window: TimeWindow) -> DataFrame:
    return window.within(tables.post, "created_at")


def post_count(tables, window: TimeWindow) -> DataFrame:
    """Posts created in the window; the table holds one row per post."""
    return _one(posts_in(tables, window), F.count("*"), "post_count")


def comment_count(tables, window: TimeWindow) -> DataFrame:
    """Distinct comment ids; the table key also holds the post, so ids are made distinct."""
    seen = window.within(tables.comment, "created_at").select("comment_id").distinct()
    return _one(seen, F.count("*"), "sampled_comment_count")


def active_topics(tables, window: TimeWindow) -> DataFrame:
    """Known topics linked to a post of the window."""
    linked = tables.post_topic.join(
        posts_in(tables, window), "post_id", "left_semi").select("topic_id").distinct()
    return _one(linked.join(tables.topic, "topic_id", "left_semi"), F.count("*"),
                "active_topic_count")


def total_interactions(tables, window: TimeWindow) -> DataFrame:
    """Newest snapshot of each post of the window, whenever it was taken."""
    newest = latest_interactions(tables.engagement).join(
        posts_in(tables, window), "post_id", "left_semi")
    return _one(newest, F.coalesce(F.sum("interaction_count"), F.lit(0)), "latest_interactions")


def kol_entry_posts(tables, window: TimeWindow) -> DataFrame:
    """Posts of the window that were discovered through a KOL."""
    kol = tables.discovery.filter(F.col("source_type") == "kol").select("post_id").distinct()
    found = posts_in(tables, window).join(kol, "post_id", "left_semi")
    return _one(found, F.count("*"), "kol_entry_post_count")


def verified_actors(tables, window: TimeWindow) -> DataFrame:
    """Verified users who posted or commented in the window."""
    seen = speakers(posts_in(tables, window), window.within(tables.comment, "created_at"))
    verified = tables.user.filter("verified").join(seen, "uid", "left_semi")
    return _one(verified, F.count("*"), "verified_actor_count")


def tier_distribution(tables, window: TimeWindow) -> DataFrame:
    """Share of each profile tier among users seen since the window start (no upper bound)."""
    seen = speakers(window.since(tables.post, "created_at"),
                    window.since(tables.comment, "created_at"))
    counts = tables.user.join(seen, "uid", "left_semi").groupBy("profile_tier").agg(
        F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("profile_tier", "n", round_to(ratio(F.col("n"), total)).alias("share"))


def trusted_tier_ratio(distribution: DataFrame) -> DataFrame:
    """Summed share of tiers whose profile fields can be trusted."""
    trusted = F.sum(F.when(F.col("profile_tier") >= 1, F.col("share")).otherwise(0.0))
    return _one(distribution, round_to(F.coalesce(trusted, F.lit(0.0))), "trusted_ratio")


def prediction_summary(tables, window: TimeWindow, s: Settings = DEFAULTS) -> DataFrame:
    """Sample count, ratios, risk index and confidence in one aggregate."""
    pred = predictions_in(tables.prediction, window, s.primary_model)
    weak = (F.col("confidence") < s.low_confidence) | (F.col("margin") < s.low_margin)
    total = pred.agg(*emotion_aggregates(), F.count_if(weak).alias("low_confidence_count"))
    negative = ratio(F.col("negative_count"), F.col("sample_count"))
    anger_fear = ratio(F.col("anger_fear_count"), F.col("sample_count"))
    return total.select(
        F.col("sample_count").alias("total"),
        round_to(negative).alias("negative_ratio"),
        round_to(anger_fear).alias("anger_fear_ratio"),
        risk_index(negative, anger_fear).alias("risk_index"),
        round_to(mean_micros(F.col("confidence_micros"), F.col("sample_count")))
        .alias("avg_confidence"),
        "low_confidence_count")


def risk_index(negative, anger_fear):
    return round_to(F.lit(100.0) * (F.lit(0.70) * negative + F.lit(0.30) * anger_fear), 1)


def _folded(parts: list[DataFrame], key: str) -> DataFrame:
    """Each part's rows per key, every other column as its maximum."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.filter(F.col(key).isNotNull()).groupBy(key).agg(*[
        F.max(c).alias(c) for c in stacked.columns if c != key])


def post_figures(tables, window: TimeWindow) -> DataFrame:
    """One row: posts of the window, their newest interactions, and those found through a KOL."""
    yes = F.lit(True)
    snapshots = tables.engagement.filter(F.col("captured_at").isNotNull()).select(
        "post_id", F.struct("captured_at", interactions().alias("total")).alias("newest"))
    facts = _folded([
        posts_in(tables, window).select("post_id", yes.alias("created")), snapshots,
        tables.discovery.filter(F.col("source_type") == "kol").select("post_id", yes.alias("kol")),
    ], "post_id").filter("created")
    return facts.agg(
        F.count("*").alias("post_count"),
        F.coalesce(F.sum("newest.total"), F.lit(0)).alias("latest_interactions"),
        F.count_if("kol").alias("kol_entry_post_count"))


def user_figures(tables, window: TimeWindow) -> DataFrame:
    """One row: verified users seen in the window, and the share of each tier since its start."""
    def seen(df: DataFrame) -> DataFrame:
        return window.since(df, "created_at").select(
            F.col("user_id").alias("uid"), window.holds(df, "created_at").alias("inside"))
    users = tables.user.select("uid", F.lit(True).alias("known"), "verified", "profile_tier")
    per_tier = _folded([users, seen(tables.post), seen(tables.comment)], "uid").filter(
        F.col("known") & F.col("inside").isNotNull()).groupBy("profile_tier").agg(
        F.count("*").alias("n"), F.count_if(F.col("verified") & F.col("inside")).alias("verified"))
    # a handful of tiers
    total = per_tier.agg(
        F.coalesce(F.sum("verified"), F.lit(0)).alias("verified_actor_count"),
        F.sum("n").alias("n"), F.collect_list(F.struct("profile_tier", "n")).alias("tiers"))
    shown = F.transform("tiers", lambda t: F.concat_ws(
        "=", t["profile_tier"].cast("string"),
        F.format_string("%.4f", round_to(ratio(t["n"], F.col("n"))))))
    return total.select("verified_actor_count",
                        F.array_join(F.array_sort(shown), ",").alias("profile_tiers"))


def overview(tables, window: TimeWindow, s: Settings = DEFAULTS) -> DataFrame:
    """All KPIs in one row: one fold per post, one per user, and three aggregates, each a scalar subquery."""
    posts, users = (
        frame.agg(F.first(F.struct(*frame.columns))).scalar()
        for frame in (post_figures(tables, window), user_figures(tables, window)))
    return prediction_summary(tables, window, s).withColumnRenamed(
        "total", "prediction_sample_count").withColumns({
            "post_count": posts["post_count"],
            "sampled_comment_count": comment_count(tables, window).scalar(),
            "active_topic_count": active_topics(tables, window).scalar(),
            "latest_interactions": posts["latest_interactions"],
            "kol_entry_post_count": posts["kol_entry_post_count"],
            "verified_actor_count": users["verified_actor_count"],
            "profile_tiers": users["profile_tiers"]})


def emotion_series(tables, window: TimeWindow, s: Settings = DEFAULTS) -> DataFrame:
    """Daily emotion counts of all samples."""
    return emotion_by_day(predictions_in(tables.prediction, window, s.primary_model))


def maintained_series(daily: DataFrame, prediction: DataFrame, window: TimeWindow,
                      s: Settings = DEFAULTS) -> DataFrame:
    """The same series from maintained daily sums (``streams.read_daily``).

    Days that lie wholly in the window are taken from the sums.  Only its first and last day, if the
    window cuts them, are counted from predictions, which the scan prunes to these days.
    """
    first, beyond = window.whole_days()
    kind = prediction.schema["source_created_at"].dataType.simpleString()

    def midnight(day: date):
        return F.lit(str(datetime.combine(day, time()) - OFFSET)).cast(kind)
    cut = predictions_in(prediction, window, s.primary_model).filter(
        (F.col("source_created_at") < midnight(first)) | (F.col("source_created_at") >= midnight(beyond)))
    edges = cut.groupBy(local_day(F.col("source_created_at")).alias("day")).agg(*emotion_aggregates())
    inner = daily.filter((F.col("model_version") == s.primary_model) & (F.col("day") >= F.lit(first))
                         & (F.col("day") < F.lit(beyond))).select(*edges.columns)
    return series_of_days(inner.unionByName(edges))


def series_totals(series: DataFrame) -> DataFrame:
    """Totals of a daily series per emotion, with shares and the negative share."""
    sums = series.agg(*[F.sum(c).alias(c) for c in EMOTION_COUNTS])
    total = sum((F.col(c) for c in EMOTION_COUNTS[1:]), F.col(EMOTION_COUNTS[0]))
    negative = F.col("emotion_1") + F.col("emotion_2") + F.col("emotion_3")
    rows = F.array(*[F.struct(label_name(F.lit(i)).alias("emotion"), F.col(c).alias("n"))
                     for i, c in enumerate(EMOTION_COUNTS)])
    return sums.select(
        F.explode(rows).alias("r"), total.alias("total"),
        round_to(ratio(negative, total)).alias("negative_share"),
    ).select("r.emotion", "r.n", round_to(ratio(F.col("r.n"), F.col("total"))).alias("share"),
             "negative_share")
