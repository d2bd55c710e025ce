"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.window import TimeWindow, resolve_window
from tidemark.schema import Settings
from tidemark.sources.bindings import star_tables
from tidemark.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}

# the star-schema tables hold a few posts a day, so the stable-day threshold is lower
STABLE_DAY = 5
SETTINGS = Settings(stable_day_threshold=STABLE_DAY)


class Run:
    """What a query function gets: the tables and, on demand, a resolved window."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.tables: Tables = star_tables(spark, root)
        self._windows: dict[str, TimeWindow] = {}

    def window(self, range_key: str = "all_available") -> TimeWindow:
        if range_key not in self._windows:
            self._windows[range_key] = resolve_window(self.tables.post, range_key, STABLE_DAY)
        return self._windows[range_key]


def query(name: str, sql: str | None = None):
    """Register ``fn(run) -> DataFrame`` and the SQL that must give the same rows."""
    def register(fn: Callable[[Run], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, root: fn(Run(spark, root))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def with_views(body: str) -> str:
    """Prepend the views a statement uses, in definition order."""
    wanted: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                visit(VIEWS[name])
    visit(body)
    body = body.strip()
    ctes = [f"{n} as ({VIEWS[n].strip()})" for n in VIEWS if n in wanted]
    if not ctes:
        return body
    if re.match(r"with\s", body, re.I):
        return "with " + ",\n".join(ctes) + ",\n" + body[4:].lstrip()
    return "with " + ",\n".join(ctes) + "\n" + body
