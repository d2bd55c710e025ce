"""Conversation history and nested context packs (CX-01..10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import shorten
from tidemark.operators.dedupe import keep_first
from tidemark.operators.ranking import top_per_group
from tidemark.schema import DATA_CAVEATS, REQUEST_NAMES

KEEP_MESSAGES = 200
PROMPT_MESSAGES = 20
SESSION_DAYS = 7
MAX_REFS = 8
MAX_REQUESTS = 3
DEFAULT_REQUESTS = ("risk_topics", "actors", "evidence")
DEFAULT_LIMIT = 5
MAX_LIMIT = 8


def last_messages(messages: DataFrame, n: int = PROMPT_MESSAGES) -> DataFrame:
    """The newest n messages of each conversation."""
    return top_per_group(messages, ["conv_id"], [F.desc("turn")], n, "_n").drop("_n")


def active_sessions(messages: DataFrame, limit: int | None = None, days: int = SESSION_DAYS) -> DataFrame:
    """Conversations updated within the retention of the newest one, newest first."""
    sessions = messages.groupBy("conv_id").agg(
        F.max("created_at").alias("updated_at"), F.count("*").alias("message_count"))
    newest = messages.agg(F.max("created_at")).scalar()
    alive = sessions.filter(F.col("updated_at") >= newest - F.expr(f"INTERVAL {days} DAYS"))
    newest_first = alive.orderBy(F.desc("updated_at"), "conv_id")
    return newest_first if limit is None else newest_first.limit(limit)


def session_rollup(messages: DataFrame, title_chars: int = 40) -> DataFrame:
    """Message count, title from the first user text, role of the last message."""
    first_user = F.min_by(F.when(F.col("role") == "user", shorten(F.col("text"), title_chars)),
                          F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("message_count"),
        F.coalesce(first_user, F.lit("新对话")).alias("title"),
        F.max_by("role", "turn").alias("last_role"))


def clip_messages(messages: DataFrame, max_chars: int = 500) -> DataFrame:
    """Roles reduced to user / assistant, texts shortened for a prompt."""
    role = F.when(F.col("role").isin("user", "assistant"), F.col("role")).otherwise("assistant")
    return messages.select("conv_id", "turn", role.alias("role"),
                           shorten(F.col("text"), max_chars).alias("content"))


def valid_refs(answers: DataFrame, evidence: DataFrame, key: str, limit: int = MAX_REFS
               ) -> DataFrame:
    """References of each answer that exist, in their order, among the first ``limit``."""
    listed = answers.select(key, F.posexplode(F.slice("refs", 1, limit)).alias("pos", "ref"))
    found = listed.join(evidence.select(F.col("sample_id").alias("ref")).distinct(), "ref",
                        "left_semi")
    kept = found.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))),
                                              lambda s: s["ref"]).alias("refs"))
    return answers.select(key).join(kept, key, "left").withColumn(
        "refs", F.coalesce("refs", F.array().cast("array<string>")))


def merge_caveats(given: Column, defaults: tuple[str, ...] = DATA_CAVEATS) -> Column:
    """Up to four given caveats, then the missing defaults, six at most."""
    fixed = F.array(*[F.lit(x) for x in defaults])
    first = F.slice(given, 1, 4)
    return F.slice(F.concat(first, F.array_except(fixed, first)), 1, 6)


def sanitize_requests(requests: DataFrame, key: str) -> DataFrame:
    """Allowed request names of each key: first occurrence, three at most, limit in 1..8.

    A key without any allowed name gets the default set.  Input: key, pos, name, raw_limit.
    """
    allowed = F.col("name").isin(*REQUEST_NAMES)
    first = keep_first(requests.filter(allowed), [key, "name"], ["pos"])
    few = top_per_group(first, [key], [F.asc("pos")], MAX_REQUESTS, "n")
    whole = F.col("raw_limit").cast("string").try_cast("int")
    limit = F.least(F.greatest(F.coalesce(whole, F.lit(DEFAULT_LIMIT)), F.lit(1)), F.lit(MAX_LIMIT))
    chosen = few.select(key, "n", "name", limit.alias("limit"))
    empty = requests.groupBy(key).agg(F.count_if(allowed).alias("_ok")).filter("_ok = 0")
    default = empty.select(key, F.posexplode(F.array(*[F.lit(x) for x in DEFAULT_REQUESTS]))
                           .alias("n", "name"))
    return chosen.unionByName(default.select(
        key, (F.col("n") + 1).alias("n"), "name", F.lit(DEFAULT_LIMIT).alias("limit")))


def ordered_list(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """One row with the rows of a limited frame as an ordered array of structs."""
    ranked = df.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    fields = F.struct(*[c for c in df.columns])
    pairs = F.array_sort(F.collect_list(F.struct(F.col("_n"), fields.alias("row"))))
    return ranked.agg(F.transform(pairs, lambda s: s["row"]).alias(name))


def context_pack(row: DataFrame, **lists: DataFrame) -> DataFrame:
    """One JSON document: the fields of a one-row frame plus named one-row arrays."""
    packed = row.withColumns({name: df.scalar() for name, df in lists.items()})
    return packed.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("context"))
