"""Registry of canonical tables: loaded on first use, newest version of each key only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedupe import latest_version, latest_with_first_seen
from tidemark.schema import FIRST_SEEN, TABLE_KEYS, TABLE_SCHEMAS
from tidemark.session import stored


class Tables:
    """Attribute access to named DataFrames, each built once per registry."""

    def __init__(self, spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]]):
        self.spark = spark
        self._loaders = dict(loaders)
        self._frames: dict[str, DataFrame] = {}
        self._kept: set[str] = set()

    def keep(self, *names: str) -> None:
        """Write tables once for a plan that reads them several times.

        Resolving versions, grouping or making rows distinct moves every row of a table, and readers with
        different columns do not share that.  Tables made of these are built anew on top of the written ones.
        """
        for name in names:
            if name in self._loaders:
                self.once(name, lambda: getattr(self, name))  # noqa: B023

    @contextmanager
    def keeping(self, *names: str) -> Iterator[None]:
        """``keep`` for the plans that are built inside; plans built later do not see the written tables."""
        added = {n for n in names if n in self._loaders and n not in self._kept}
        self.keep(*added)
        try:
            yield
        finally:
            self._kept -= added
            self._frames = {n: self._frames[n] for n in self._kept}

    def is_kept(self, name: str) -> bool:
        return name in self._kept

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that is written on first use, under a name of its own."""
        if name not in self._kept:
            self._frames[name] = stored(make(), "kept")
            self._kept.add(name)
            self._frames = {n: self._frames[n] for n in self._kept}
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name not in self._loaders:
                raise AttributeError(f"no table {name!r}; known: {sorted(self._loaders)}")
            self._frames[name] = self._loaders[name]()
        return self._frames[name]

    def names(self) -> list[str]:
        return sorted(self._loaders)


def current_rows(df: DataFrame, table: str) -> DataFrame:
    """Resolve versions of a canonical table: newest row per key, earliest first-seen time."""
    rule = TABLE_KEYS[table]
    if rule is None:
        return df
    keys, version = rule
    ties = [f.name for f in df.schema.fields
            if f.name not in (*keys, version) and f.dataType.typeName() not in ("array", "map")]
    if table in FIRST_SEEN and FIRST_SEEN[table] != version:
        return latest_with_first_seen(df, keys, version, FIRST_SEEN[table], ties)
    return latest_version(df, keys, version, ties)


def canonical_tables(spark: SparkSession, root: str) -> Tables:
    """Tables stored as ``root/<table>`` parquet folders in the canonical schema.

    ``<table>`` holds the newest rows, ``<table>_versions`` all stored rows.
    """
    def versions_of(table: str) -> DataFrame:
        return spark.read.schema(TABLE_SCHEMAS[table]).parquet(f"{root}/{table}")

    current = {n: (lambda n=n: current_rows(versions_of(n), n)) for n in TABLE_SCHEMAS}
    versions = {f"{n}_versions": (lambda n=n: versions_of(n)) for n in TABLE_SCHEMAS}
    return Tables(spark, {**current, **versions})


NO_MONTH = "none"


def month_of(month: Column) -> Column:
    return F.coalesce(month.cast("string"), F.lit(NO_MONTH))


def add_month(df: DataFrame, column: str, name: str = "month") -> DataFrame:
    """Month partition column (yyyyMM) of a time column; a null time has the month NO_MONTH."""
    return df.withColumn(name, month_of(F.date_format(column, "yyyyMM")))


def write_by_month(df: DataFrame, path: str, column: str, mode: str = "overwrite") -> None:
    """Store a fact table in month folders of a time column."""
    add_month(df, column).hint("rebalance", "month").write.mode(mode).partitionBy("month").parquet(path)


def rows_of_dates(facts: DataFrame, dates: DataFrame, column: str, day: str = "day") -> DataFrame:
    """Fact rows of the days of a date table, which is filtered by any of its own columns.

    Facts and dates meet by month and by day; the month comes from the folders, so the filter on the dates
    prunes folders when the query runs.
    """
    wanted = add_month(dates.select(F.col(day).alias("_day")), "_day", "_month").distinct()
    on = (facts["month"].cast("string") == wanted["_month"]) & (
        F.to_date(facts[column]) == wanted["_day"])
    return facts.join(wanted, on).drop("_day", "_month")
