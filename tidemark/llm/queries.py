"""One query per operator over its whole table, and the SQL it has to agree with."""

from __future__ import annotations

import public_tokenizers

from tidemark.llm import (bpe, decontaminate, exact_stream, fim, importance, jaccard_join, langid,
                          line_dedup, quality, rules, secrets, suffix_dedup, warc)
from tidemark.llm.common import read_table


def op1_secret_scan(spark, root):
    return secrets.secret_report(read_table(spark, root, "documents"))


def op2_decontamination(spark, root):
    return decontaminate.contamination_report(
        read_table(spark, root, "documents"), read_table(spark, root, "benchmark"))


def op3_quality(spark, root):
    return quality.quality_report(
        read_table(spark, root, "documents"), read_table(spark, root, "labels"))


def op4_bpe(spark, root):
    return bpe.token_report(
        read_table(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN)


def op5_suffix_dedup(spark, root):
    return suffix_dedup.repeat_report(read_table(spark, root, "documents"))


def op6_exact_dedup(spark, root):
    return exact_stream.dedup_stream(read_table(spark, root, "documents"))


def op7_jaccard_join(spark, root):
    return jaccard_join.jaccard_report(read_table(spark, root, "documents"))


def op8_language(spark, root):
    return langid.language_report(read_table(spark, root, "documents"))


def op9_line_dedup(spark, root):
    return line_dedup.line_report(read_table(spark, root, "documents"))


def op10_warc(spark, root):
    return warc.archive_report(read_table(spark, root, "pages"))


def op11_importance(spark, root):
    return importance.importance_report(
        read_table(spark, root, "documents"), read_table(spark, root, "benchmark"))


def op12_fill_in_middle(spark, root):
    return fim.fim_report(read_table(spark, root, "documents"))


def op13_quality_rules(spark, root):
    return rules.rules_report(read_table(spark, root, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_decontamination, op3_quality, op4_bpe, op5_suffix_dedup,
    op6_exact_dedup, op7_jaccard_join, op8_language, op9_line_dedup, op10_warc, op11_importance,
    op12_fill_in_middle, op13_quality_rules)}

ORACLES = {
    "op6_exact_dedup": exact_stream.EXACT_SQL,
    "op9_line_dedup": line_dedup.LINE_SQL,
    "op10_warc": warc.WARC_SQL,
    "op12_fill_in_middle": fim.FIM_SQL,
}
