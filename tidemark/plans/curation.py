"""Raw labelled text to training splits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.text import clean_text
from tidemark.operators.quality import clean_frame, clean_splits


def prepare_splits(raw: DataFrame, cleaner=clean_text, unknown: str = "fail") -> DataFrame:
    """Clean, keep the first row of each content per split, drop train rows that leak.

    Input: id, content, label (English), split.  Leakage is judged on deduplicated splits.
    """
    return clean_splits(clean_frame(raw, cleaner, unknown))
