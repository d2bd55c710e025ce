"""Key-actor ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.operators import actors as a
from tidemark.operators.window import TimeWindow
from tidemark.schema import DEFAULTS, Settings


def key_actors(tables, window: TimeWindow, topic_id: int | None = None,
               limit: int | None = None, s: Settings = DEFAULTS) -> DataFrame:
    profiles = a.actor_profiles(tables, window, topic_id, s)
    return a.render_actors(a.rank_actors(profiles, limit or s.actor_limit))
