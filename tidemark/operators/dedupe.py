"""Keep-one-row-per-key operators.

All of them are row_number() = 1 filters: Spark prunes each map task to one row
per key before the shuffle, so a key that holds a third of the rows is cheap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")


def latest_version(df: DataFrame, keys: Sequence[str], version: str,
                   ties: Sequence[str] = ()) -> DataFrame:
    """The newest version of each key; ``ties`` decide between equal versions (larger wins)."""
    return _first_by(df, keys, [F.desc(version), *[F.desc(t) for t in ties]])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _first_by(df, keys, [F.col(o).asc() if isinstance(o, str) else o for o in order])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _first_by(df, keys, [F.desc(o) for o in order])


def first_seen(df: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Earliest value of an immutable column over all versions of a key."""
    return df.groupBy(*keys).agg(F.min(column).alias(column))


def latest_with_first_seen(df: DataFrame, keys: Sequence[str], version: str, column: str,
                           ties: Sequence[str] = ()) -> DataFrame:
    """The newest version of each key carrying the earliest value of ``column``."""
    rest = [c for c in df.columns if c not in (*keys, column)]
    newest = F.max_by(F.struct(*rest), F.struct(version, *ties)).alias("_newest")
    folded = df.groupBy(*keys).agg(newest, F.min(column).alias(column))
    return folded.select(*keys, "_newest.*", column)


def exclude_contents(df: DataFrame, *others: DataFrame, key: str = "content") -> DataFrame:
    """Rows whose key appears in none of the other frames.

    Long texts are shuffled once per distinct value: the excluded side is reduced to
    distinct hashes with their texts, and the hash is confirmed by equality.
    """
    blocked = None
    for other in others:
        part = other.select(F.col(key).alias("_text"))
        blocked = part if blocked is None else blocked.unionByName(part)
    blocked = blocked.filter(F.col("_text").isNotNull()).distinct().withColumn(
        "_hash", F.xxhash64("_text"))
    keyed = df.withColumn("_key", F.xxhash64(key))
    match = (keyed["_key"] == blocked["_hash"]) & (keyed[key] == blocked["_text"])
    return keyed.join(blocked, match, "left_anti").drop("_key")
