"""Context packs for answering questions about the overview or one topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import local_iso
from tidemark.functions.text import cut
from tidemark.operators import context as c
from tidemark.operators import evidence as e
from tidemark.operators import kpi
from tidemark.operators import topics as t
from tidemark.operators.window import TimeWindow, available_days
from tidemark.plans.actors import key_actors
from tidemark.plans.risk import risk_topics, topic_risk
from tidemark.schema import DATA_CAVEATS, DEFAULTS, RISK_FACTOR_WEIGHTS, Settings

TOPIC_FIELDS = ("topic_id", "title", "risk_score", "risk_level", "dominant_emotion",
                "negative_ratio", "negative_growth_label", "interaction_growth_label",
                "sample_count", "kol_entry_count", "verified_actor_count")
ACTOR_FIELDS = ("actor_id", "display_name", "roles", "dominant_emotion", "negative_ratio",
                "sample_count", "interaction_count", "actor_influence_score", "top_topic_title")
ONE_TOPIC_FIELDS = (*TOPIC_FIELDS, "lead", "post_sample_count", "sampled_comment_count",
                    "latest_interactions", "note", *[f"factor_{k}" for k in RISK_FACTOR_WEIGHTS])
TIMELINE_POINTS = 14
# what the parts of a pack read more than once and what is not stored as it is read
SHARED = ("comment", "post_topic", "engagement")


def shared_fields(window: TimeWindow, s: Settings) -> dict:
    """What every pack says about itself: window, model and caveats."""
    start, end = F.lit(window.start).cast("timestamp_ntz"), F.lit(window.end).cast("timestamp_ntz")
    return {
        "window": F.struct(
            F.lit(window.range_key).alias("range"), local_iso(start).alias("start"),
            local_iso(end).alias("end"), available_days(start, end).alias("available_days")),
        "model_version": F.lit(s.primary_model),
        "caveats": F.array(*[F.lit(x) for x in DATA_CAVEATS])}


def ranked_actors(actors: DataFrame, name: str) -> DataFrame:
    return c.ordered_list(actors, [F.desc("actor_influence_score"), F.asc("actor_id")], name)


def one_struct(row: DataFrame) -> Column:
    return row.select(F.struct("*").alias("x")).scalar()


def top_evidence(tables, window: TimeWindow, topic_id: int | None, n: int,
                 s: Settings) -> DataFrame:
    shown = e.render_evidence(e.evidence_page(tables, window, n, topic_id, s=s), s)
    rows = shown.select("sample_id", "source", "created_at",
                        cut(F.col("content"), 80).alias("content"), "pred_label", "confidence",
                        "second_label", "margin", "interaction_count", "evidence_reason")
    return c.ordered_list(rows, [F.asc("sample_id")], "evidence_samples")


def overview_context(tables, window: TimeWindow, s: Settings = DEFAULTS, n: int = 3) -> DataFrame:
    """KPI summary with the top topics, actors and evidence as one JSON document."""
    tables.keep(*SHARED)
    topics = risk_topics(tables, window, limit=n, s=s).select(*TOPIC_FIELDS)
    actors = key_actors(tables, window, limit=n, s=s).select(*ACTOR_FIELDS)
    summary = kpi.prediction_summary(tables, window, s).select(F.lit("overview").alias("scope"), "*")
    return c.context_pack(
        summary.withColumns(shared_fields(window, s)),
        top_risk_topics=c.ordered_list(
            topics, [F.desc("risk_score"), F.desc("sample_count"), F.asc("topic_id")], "t"),
        top_actors=ranked_actors(actors, "a"),
        evidence_samples=top_evidence(tables, window, None, n, s))


def known_topic(tables, window: TimeWindow, topic_id: int, s: Settings) -> DataFrame:
    """One row of a topic with its rendered risk; zeros when no post is linked to it."""
    base = t.topic_base(tables, window, topic_id, s).withColumn(
        "topic_id", F.col("topic_id").cast("string")).drop("post_count")
    raw = topic_risk(tables, window, topic_id, s)
    scored = t.render_topics(raw).drop("title", "lead")
    gains = raw.select(F.col("topic_id").cast("string").alias("topic_id"), "interaction_delta")
    joined = base.join(scored, "topic_id", "left").join(gains, "topic_id", "left")
    return joined.fillna(0).fillna({"risk_level": "low"})


def topic_context(tables, window: TimeWindow, topic_id: int, s: Settings = DEFAULTS,
                  n: int = 3) -> DataFrame:
    """One topic: risk, emotions, sources, last timeline points, actors and evidence."""
    tables.keep(*SHARED)
    samples = t.topic_samples(tables, window, topic_id, s)
    days = t.emotion_by_day(samples).select("day", "total", "negative_ratio").orderBy(
        F.desc("day")).limit(TIMELINE_POINTS)
    risk = known_topic(tables, window, topic_id, s).select(
        F.lit("topic").alias("scope"), *ONE_TOPIC_FIELDS)
    actors = key_actors(tables, window, topic_id, n, s).select(*ACTOR_FIELDS)
    return c.context_pack(
        risk.withColumns({
            **shared_fields(window, s),
            "emotion_distribution": one_struct(t.emotion_distribution(samples)),
            "source_counts": one_struct(t.topic_sources(tables, window, topic_id, s))}),
        timeline=c.ordered_list(days, [F.asc("day")], "d"), top_actors=ranked_actors(actors, "a"),
        evidence_samples=top_evidence(tables, window, topic_id, n, s))


def topic_detail(tables, window: TimeWindow, topic_id: int, s: Settings = DEFAULTS,
                 evidence_limit: int = 8, actor_limit: int = 8) -> DataFrame:
    """The whole topic page as one row: base, risk, timeline, mixes, actors, evidence."""
    tables.keep(*SHARED)
    samples = t.topic_samples(tables, window, topic_id, s)
    shown = e.render_evidence(e.evidence_page(
        tables, window, evidence_limit, topic_id, s=s), s)
    actors = key_actors(tables, window, topic_id, actor_limit, s)
    lists = {
        "timeline": c.ordered_list(t.emotion_by_day(samples), [F.asc("day")], "x"),
        "engagement_curve": c.ordered_list(
            t.engagement_curve(tables, window, topic_id), [F.asc("day")], "x"),
        "top_actors": c.ordered_list(actors, [
            F.desc("role_count"), F.desc("actor_influence_score"), F.desc("sample_count"),
            F.asc("actor_id")], "x"),
        "evidence_samples": c.ordered_list(shown, [F.asc("sample_id")], "x"),
    }
    row = known_topic(tables, window, topic_id, s).withColumns({
        "emotion_distribution": one_struct(t.emotion_distribution(samples)),
        "source_counts": one_struct(t.topic_sources(tables, window, topic_id, s))})
    return row.withColumns({name: df.scalar() for name, df in lists.items()})
