"""Evidence samples: score, filters, paging, reasons (EV-01..08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.numeric import local_iso, round_to
from tidemark.functions.text import contains_ignore_case
from tidemark.operators.joins import join_unique
from tidemark.operators.ranking import number_limited, number_rows
from tidemark.operators.samples import (
    busy_posts, busy_users, interactions, of_topic, predictions_in, topic_links,
)
from tidemark.operators.window import TimeWindow
from tidemark.schema import ANGER_FEAR_IDS, DEFAULTS, NEGATIVE_IDS, Settings
from tidemark.session import stored

ORDER = ("evidence_score", "source", "source_id")


def evidence_score(s: Settings = DEFAULTS) -> Column:
    """30 anger/fear or 20 other negative, 20 x confidence, 12 low margin, 3 ln(1 + interactions),
    10 verified author."""
    label = F.col("pred_label_id")
    score = (
        F.when(label.isin(*ANGER_FEAR_IDS), 30.0).when(label.isin(*NEGATIVE_IDS), 20.0)
        .otherwise(0.0)
        + F.col("confidence").cast("double") * F.lit(20.0)
        + F.when(F.col("margin") < s.low_margin, 12.0).otherwise(0.0)
        + F.log1p(F.col("interaction_count").cast("double")) * F.lit(3.0)
        + F.when(F.col("verified"), 10.0).otherwise(0.0))
    return round_to(score, 6)


def actor_role() -> Column:
    """verified_actor, tierN or tier0."""
    return F.when(F.col("verified"), "verified_actor").when(
        F.col("profile_tier") >= 1, F.concat(F.lit("tier"), F.col("profile_tier").cast("string"))
    ).otherwise("tier0")


def evidence_reason(s: Settings = DEFAULTS) -> Column:
    return F.concat_ws(
        " + ", label_name(F.col("pred_label_id")),
        F.when(F.col("interaction_count") > 0, "高互动"),
        F.when(F.col("actor_role") == "verified_actor", "认证账号"),
        F.when(F.col("margin") < s.low_margin, "低 margin"))


def _post_context(tables, window: TimeWindow, topic_id: int | None) -> DataFrame:
    """Per linked post: its lowest topic id and newest interactions in the window."""
    links = tables.post_topic if topic_id is None else topic_links(tables, topic_id)
    links = links.select("post_id", "topic_id")
    snapshots = of_topic(window.within(tables.engagement, "captured_at"), tables, topic_id,
                         "captured_at").select("post_id", "captured_at", interactions().alias("total"))
    return links.unionByName(snapshots, allowMissingColumns=True).groupBy("post_id").agg(
        F.min("topic_id").alias("topic_id"),
        F.coalesce(F.max_by("total", "captured_at"), F.lit(0)).alias("interaction_count"),
    ).filter(F.col("topic_id").isNotNull())


def _spoken(tables, window: TimeWindow, topic_id: int | None, q: str, author: int | None, s: Settings,
            kinds: tuple[str, ...]) -> DataFrame:
    """Predictions of the window, and of a topic's posts, with their text and author."""
    pred = of_topic(predictions_in(tables.prediction, window, s.primary_model), tables, topic_id,
                    "source_id").select(
        F.col("source_type").alias("source"), "source_id", "post_id", "source_created_at",
        "pred_label_id", "second_label_id", "confidence", "margin")

    def narrowed(texts: DataFrame) -> DataFrame:
        if q:
            texts = texts.filter(contains_ignore_case(q, F.col("content")))
        return texts if author is None else texts.filter(F.col("user_id") == author)

    parts = []
    if "post" in kinds:
        texts = narrowed(tables.post.select(
            F.col("post_id").alias("source_id"), "user_id", F.col("text_raw").alias("content")))
        parts.append(pred.filter(F.col("source") == "post").join(texts, "source_id"))
    if "comment" in kinds:
        texts = narrowed(tables.comment.select(
            F.col("comment_id").alias("source_id"), "post_id", "user_id",
            F.col("text_raw").alias("content")))
        parts.append(pred.filter(F.col("source") == "comment").join(
            texts, ["source_id", "post_id"]))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def evidence_feed(tables, window: TimeWindow, topic_id: int | None = None, q: str = "",
                  author: int | None = None, s: Settings = DEFAULTS,
                  kinds: tuple[str, ...] = ("post", "comment")) -> DataFrame:
    """Every evidence sample with its score, one row per (source, source_id)."""
    return _scored(tables, _spoken(tables, window, topic_id, q, author, s, kinds),
                   _post_context(tables, window, topic_id), s)


def _scored(tables, spoken: DataFrame, context: DataFrame, s: Settings) -> DataFrame:
    """Predictions with the context of their posts and their authors.

    A viral post or a very busy account is spread over many tasks by ``join_unique``.
    """
    placed = join_unique(spoken, context, "post_id", "source_id",
                         how="inner", hot_from=busy_posts(tables))
    users = tables.user.select(F.col("uid").alias("user_id"), "verified", "profile_tier")
    known = join_unique(placed, users, "user_id", "source_id", hot_from=busy_users(tables))
    return known.withColumn("evidence_score", evidence_score(s)).withColumn(
        "actor_role", actor_role())


def narrow_feed(tables, window: TimeWindow, topic_id: int | None = None, q: str = "",
                author: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """The feed without its texts.

    Both sides of the join by post are written first, so that what they shuffle is not on disk together
    with what the join shuffles.
    """
    with tables.keeping("comment"):  # predictions and authors
        spoken = stored(_spoken(tables, window, topic_id, q, author, s, ("post", "comment")).drop(
            "content"), "spoken")
        return _scored(tables, spoken, stored(_post_context(tables, window, topic_id), "context"), s)


def page(feed: DataFrame, limit: int, after: tuple[float, str, int] | None = None) -> DataFrame:
    """The next ``limit`` rows after a (score, source, source_id) key."""
    if after is not None:
        score, source, source_id = after
        same = F.col("evidence_score") == F.lit(score)
        feed = feed.filter(
            (F.col("evidence_score") < F.lit(score))
            | (same & (F.col("source") > source))
            | (same & (F.col("source") == source) & (F.col("source_id") > source_id)))
    return feed.orderBy(F.desc("evidence_score"), "source", "source_id").limit(limit)


def stored_feed(tables, window: TimeWindow, topic_id: int | None = None, q: str = "",
                author: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """The feed without its texts, written once for pages that follow each other."""
    return stored(narrow_feed(tables, window, topic_id, q, author, s), "feed")


def evidence_page(tables, window: TimeWindow, limit: int, topic_id: int | None = None, q: str = "",
                  author: int | None = None, s: Settings = DEFAULTS,
                  after: tuple[float, str, int] | None = None,
                  feed: DataFrame | None = None) -> DataFrame:
    """One page of the feed: narrow rows are ranked and written, then the texts of the page are fetched.

    ``feed`` is the feed of the same filters from ``stored_feed``; without it the feed is made here.
    """
    if feed is None:
        feed = narrow_feed(tables, window, topic_id, q, author, s)
    shown = stored(page(feed, limit, after), "page")
    # at most ``limit`` keys
    keys = F.broadcast(shown.select("source", "source_id", "post_id"))
    posts = tables.post.select(F.lit("post").alias("source"), F.col("post_id").alias("source_id"),
                               "post_id", F.col("text_raw").alias("content"))
    # the keys pass below the resolving of versions, so only versions of these comments are moved
    listed = F.broadcast(shown.filter("source = 'comment'").select(F.col("source_id").alias("comment_id")))
    comments = tables.comment.join(listed, "comment_id", "left_semi").select(F.lit("comment").alias("source"), F.col("comment_id").alias(
        "source_id"), "post_id", F.col("text_raw").alias("content"))
    texts = posts.unionByName(comments).join(keys, ["source", "source_id", "post_id"])
    return shown.join(texts, ["source", "source_id", "post_id"], "left")


def numbered_pages(feed: DataFrame, limit: int) -> DataFrame:
    """Rank and page number of every sample of the feed."""
    ranked = number_rows(feed.select(*ORDER), [
        F.desc("evidence_score"), F.asc("source"), F.asc("source_id")], "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / limit) + 1)


def next_key(shown: DataFrame, limit: int) -> DataFrame:
    """Key of the last row of a full page; no row when the page is not full."""
    # the last row has the lowest score and, within it, the largest (source, source_id)
    last = F.min_by("k", F.struct(F.col("evidence_score"), F.col("n")))
    order = [F.desc("evidence_score"), F.asc("source"), F.asc("source_id")]
    placed = number_limited(shown, order, "n").select(
        "evidence_score", (-F.col("n")).alias("n"), F.struct(*ORDER).alias("k"))
    return placed.agg(F.count("*").alias("rows"), last.alias("k")).filter(
        F.col("rows") >= limit).select("k.*")


def render_evidence(shown: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Public columns of one page, numbered ev_000001, ev_000002, ..."""
    numbered = number_limited(shown, [
        F.desc("evidence_score"), F.asc("source"), F.asc("source_id")], "n")
    return numbered.select(
        F.format_string("ev_%06d", "n").alias("sample_id"), "source",
        F.col("source_id").cast("string").alias("source_id"),
        F.col("post_id").cast("string").alias("post_id"),
        F.col("topic_id").cast("string").alias("topic_id"),
        local_iso(F.col("source_created_at")).alias("created_at"), "content",
        label_name(F.col("pred_label_id")).alias("pred_label"),
        round_to(F.col("confidence")).alias("confidence"),
        label_name(F.col("second_label_id")).alias("second_label"),
        round_to(F.col("margin")).alias("margin"), "interaction_count", "actor_role",
        "evidence_score", evidence_reason(s).alias("evidence_reason"))
