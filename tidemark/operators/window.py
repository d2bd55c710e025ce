"""Data window and range resolution (KPI-01..03, KPI-15)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import local_day, local_iso
from tidemark.schema import DEFAULTS

OFFSET = timedelta(hours=8)
ALL = "all_available"


def data_window(post: DataFrame, stable_day_threshold: int | None = None) -> DataFrame:
    """One row: start_ts, end_ts (UTC) and available_days of the stable data.

    The start is the first local day with enough crawled posts, or the first crawl when no day
    reaches the threshold.  One pass, partially aggregated per day.
    """
    need = DEFAULTS.stable_day_threshold if stable_day_threshold is None else stable_day_threshold
    days = post.groupBy(local_day(F.col("first_crawled_at")).alias("day")).agg(
        F.count("*").alias("n"), F.max("created_at").alias("last"),
        F.min("first_crawled_at").alias("first"))
    ends = days.agg(
        F.min(F.when(F.col("n") >= need, F.col("day"))).alias("stable_day"),
        F.min("first").alias("first"), F.max("last").alias("end_ts"))
    midnight = F.col("stable_day").cast("timestamp_ntz") - F.expr("INTERVAL 8 HOURS")
    return ends.select(
        F.coalesce(midnight, F.col("first").cast("timestamp_ntz")).alias("start_ts"),
        F.col("end_ts").cast("timestamp_ntz").alias("end_ts"),
    ).withColumn("available_days", available_days(F.col("start_ts"), F.col("end_ts")))


def available_days(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(1), F.datediff(local_day(end), local_day(start)) + 1).cast("bigint")


def range_window(base: DataFrame, range_key: str) -> DataFrame:
    """Apply a range to the one-row data window and add the truncated midpoint."""
    length = range_length(range_key)
    start = F.col("start_ts")
    if length is not None:
        seconds = int(length.total_seconds())
        start = F.greatest(start, F.col("end_ts") - F.expr(f"INTERVAL {seconds} SECONDS"))
    half = F.timestamp_diff("SECOND", F.col("start_ts"), F.col("end_ts")) / 2
    return base.withColumn("start_ts", start).withColumn(
        "mid_ts", F.timestamp_add("SECOND", F.floor(half).cast("int"), F.col("start_ts"))
    ).withColumn("available_days", available_days(F.col("start_ts"), F.col("end_ts"))).withColumn(
        "range_key", F.lit(range_key if length is not None else ALL))


def range_length(range_key: str) -> timedelta | None:
    """'24h', '7d', any '<n>h' or '<n>d'; everything else means all available data."""
    found = re.fullmatch(r"(\d+)([hd])", range_key or "")
    if not found:
        return None
    n = int(found.group(1))
    return timedelta(hours=n) if found.group(2) == "h" else timedelta(days=n)


def window_meta(base: DataFrame) -> DataFrame:
    """Range options and partial-history flag of the data window."""
    days = F.col("available_days")
    return base.select(
        local_iso(F.col("start_ts")).alias("start_iso"),
        local_iso(F.col("end_ts")).alias("end_iso"),
        "available_days", (days < 30).alias("is_partial_history"),
        F.array_join(F.array_compact(F.array(
            F.lit(ALL), F.when(days >= 1, "24h"), F.when(days >= 7, "7d"))), ",")
        .alias("range_options"))


@dataclass(frozen=True)
class TimeWindow:
    """A resolved window; its bounds become literals, so scans prune on them."""

    start: datetime
    mid: datetime
    end: datetime
    range_key: str = ALL

    def literal(self, bound: str, kind: str) -> Column:
        return F.lit(getattr(self, bound).isoformat(sep=" ")).cast(kind)

    def whole_days(self) -> tuple[date, date]:
        """First local day that lies wholly in the window, and the one after the last such day."""
        first = (self.start + OFFSET - timedelta(microseconds=1)).date() + timedelta(days=1)
        beyond = (self.end + OFFSET + timedelta(microseconds=1)).date()
        return first, max(first, beyond)

    def within(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose time lies in the window, both ends included."""
        kind = df.schema[column].dataType.simpleString()
        return df.filter(F.col(column).between(
            self.literal("start", kind), self.literal("end", kind)))

    def holds(self, df: DataFrame, column: str) -> Column:
        """Whether a time lies in the window; false for no time."""
        kind = df.schema[column].dataType.simpleString()
        return F.coalesce(F.col(column).between(
            self.literal("start", kind), self.literal("end", kind)), F.lit(False))

    def since(self, df: DataFrame, column: str) -> DataFrame:
        kind = df.schema[column].dataType.simpleString()
        return df.filter(F.col(column) >= self.literal("start", kind))

    def recent(self, df: DataFrame, column: str) -> Column:
        """True in the second half of the window."""
        return F.col(column) >= self.literal("mid", df.schema[column].dataType.simpleString())


def resolve_window(post: DataFrame, range_key: str = ALL,
                   stable_day_threshold: int | None = None) -> TimeWindow:
    """Evaluate the one-row window; the only result fetched to the driver."""
    row = range_window(data_window(post, stable_day_threshold), range_key).first()
    if row is None or row["end_ts"] is None:
        raise ValueError("no posts, so there is no data window")
    return TimeWindow(row["start_ts"], row["mid_ts"], row["end_ts"], row["range_key"])
