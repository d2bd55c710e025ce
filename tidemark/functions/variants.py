"""JSON columns as VARIANT: parsed once, read by many paths, mixed types kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, into: str) -> DataFrame:
    """``df`` with the VARIANT of a JSON text; text that is no JSON is null."""
    return df.withColumn(into, F.try_parse_json(F.col(f"`{column}`")))


def add_paths(df: DataFrame, column: str, paths: dict[str, tuple[str, str]],
              kinds: dict[str, str] | None = None, sizes: dict[str, str] | None = None) -> DataFrame:
    """One column per path of a JSON text column, which is parsed once per row.

    ``paths`` maps a name to (path, type); a value that does not fit its type is null, as is a missing one.
    ``kinds`` gives the JSON type at a path (number, string, boolean, array, object, null) and
    ``sizes`` the length of an array.  Added columns replace columns of their name.
    """
    inner = "_variant"
    while inner in df.columns:
        inner = "_" + inner
    value = F.col(inner)
    out = {n: F.try_variant_get(value, p, t) for n, (p, t) in paths.items()}
    for name, path in (kinds or {}).items():
        kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
        out[name] = F.when(kind.isNull() | (kind == "VOID"), "null").when(
            kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(
            kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").otherwise("number")
    for name, path in (sizes or {}).items():
        found = F.try_variant_get(value, path, "array<variant>")
        out[name] = F.when(found.isNotNull(), F.size(found).cast("bigint"))
    return parsed(df, column, inner).withColumns(out).drop(inner)


def stringify_json(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Top-level fields of mixed type as strings: 1 and "1" both become '1', nulls stay null."""
    return add_paths(df, column, {n: (f"$.{n}", "string") for n in names})
