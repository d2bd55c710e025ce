"""Training-corpus pipeline: the documents that stay, encoded, after five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's ``docs``, so a lost executor costs at most one stage.  All stages but the last
return the columns of ``documents``, extra ones included; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard_join, langid, line_dedup
from tidemark.llm.common import read_table, stored

RANKS = "byte_bpe_50k.tiktoken"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go: no letter, or no language likely enough."""
    return langid.keep_identified(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line passages go from all documents but the first; a document that loses
    every line goes as a whole."""
    total, removed = (F.col(c) for c in line_dedup.count_names(docs))
    done = line_dedup.dedup_lines(docs).filter((removed == 0) | (removed < total))
    changed = removed > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(
            changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the smallest id."""
    return jaccard_join.one_per_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and hash of the token ids of each document, and the hash of their decoded bytes."""
    return bpe.token_report(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("tokens", tokens),
]

# Trained and iterative stages have no SQL form; tests compare them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
