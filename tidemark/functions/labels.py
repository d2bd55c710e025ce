"""Label ids, names and aliases as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import LABEL_ALIASES, LABELS, LABELS_EN


def _lookup(pairs: dict, key: Column) -> Column:
    items = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.try_element_at(F.create_map(*items), key)


def label_name(label_id: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in LABELS]), (label_id + 1).cast("int"))


def label_id(name: Column) -> Column:
    return _lookup({n: i for i, n in enumerate(LABELS)}, name).cast("bigint")


def english_label_id(name: Column) -> Column:
    """Id of an English label name; null when unknown."""
    return _lookup({n: i for i, n in enumerate(LABELS_EN)}, name).cast("bigint")


def normalize_label(raw: Column) -> Column:
    """Label or known alias to one of the six labels; null when unknown, '' when empty."""
    text = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    known = {**{x: x for x in LABELS}, **LABEL_ALIASES}
    return F.when(text == "", F.lit("")).otherwise(_lookup(known, text))
