"""Risk-topic ranking and topic detail: the flagship compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import topics as t
from tidemark.operators.window import TimeWindow
from tidemark.schema import DEFAULTS, Settings
from tidemark.session import stored


def scored_topics(tables, window: TimeWindow, q: str = "", s: Settings = DEFAULTS,
                  caps_scope: str = "window") -> DataFrame:
    """Scored candidate topics.

    ``caps_scope='window'`` normalises with the unsearched candidates, so that a topic has one
    score everywhere; ``'search'`` normalises within the search result.
    """
    pool = stored(t.topic_candidates_with_factors(tables, window, "", s), "topics")
    found = pool.filter(t.matches(q)) if q else pool
    return t.factor_points(t.with_caps(found, pool if caps_scope == "window" else found))


def risk_topics(tables, window: TimeWindow, q: str = "", limit: int | None = None,
                s: Settings = DEFAULTS, caps_scope: str = "window") -> DataFrame:
    """The risk ranking: top topics by score, then by sample count."""
    scored = scored_topics(tables, window, q, s, caps_scope)
    return t.render_topics(t.rank_topics(scored, s.topic_limit if limit is None else limit))


def topic_risk(tables, window: TimeWindow, topic_id: int, s: Settings = DEFAULTS) -> DataFrame:
    """Risk of one topic with the formula and caps of the ranking."""
    known = stored(t.add_raw_factors(t.known_topics(
        tables, t.topic_totals(tables, window, s)), s), "topics")
    pool = known.filter(F.col("post_count") >= s.topic_min_posts)
    return t.factor_points(t.with_caps(known.filter(F.col("topic_id") == topic_id), pool))
