"""Longest-match conversion with a dictionary of phrases, compiled into one trie."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_PHRASES = 500_000


def read_phrases(spark: SparkSession, path: str | list[str]) -> dict[str, str]:
    """Dictionary files of lines 'phrase<tab>conversion [other conversions]'; the first one counts.

    A dictionary is a configuration table that every task holds; more than ``MOST_PHRASES`` lines
    are refused.  Of lines that repeat a phrase the smallest conversion counts.
    """
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(F.size(parts) >= 2).select(
        parts[0].alias("phrase"), F.split(parts[1], " ")[0].alias("to")).filter("phrase <> ''")
    rows = lines.groupBy("phrase").agg(F.min("to").alias("to")).limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return {r["phrase"]: r["to"] for r in rows}


def trie_pattern(phrases: list[str]) -> str:
    """A pattern that matches the longest of the phrases at a place, as a trie of branches.

    Phrases with a common beginning share a branch, so a place is decided by one descent.
    """
    root: dict = {}
    for phrase in phrases:
        node = root
        for letter in phrase:
            node = node.setdefault(letter, {})
        node[""] = {}

    # built from the leaves up without recursion; phrases may be long
    done: dict[int, str] = {}
    todo = [(root, False)]
    while todo:
        node, ready = todo.pop()
        if not ready:
            todo.append((node, True))
            todo += [(child, False) for letter, child in node.items() if letter]
            continue
        ends, branches = "" in node, {k: v for k, v in sorted(node.items()) if k}
        leaves = [k for k, v in branches.items() if done[id(v)] == ""]
        parts = [re.escape(k) + done[id(v)] for k, v in branches.items() if done[id(v)] != ""]
        if len(leaves) > 1:
            parts.append("[" + "".join(map(re.escape, leaves)) + "]")
        elif leaves:
            parts.append(re.escape(leaves[0]))
        inner = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})" if parts else ""
        done[id(node)] = f"(?:{inner})?" if ends and inner else inner
    return done[id(root)]


def convert(col: Column, phrases: dict[str, str]) -> Column:
    """Every longest phrase replaced, from the left; other characters stay.

    A single character is a phrase of length one, so a character table is the fallback of the phrases.
    Only texts that hold the first character of a phrase meet Python.
    """
    if not phrases:
        return col
    pattern = trie_pattern(list(phrases))

    @F.arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        find = re.compile(pattern)
        return pa.array([None if t is None else find.sub(lambda m: phrases[m.group()], t)
                         for t in texts.to_pylist()], pa.string())

    first = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted({p[0] for p in phrases})) + "]"
    return F.coalesce(replace(F.when(col.rlike(first), col)), col)


def convert_frame(df: DataFrame, phrases: dict[str, str], column: str = "content") -> DataFrame:
    return df.withColumn(column, convert(F.col(column), phrases))
