"""Line dedup over overlapping three-line windows.

Lines are the parts of the text between line feeds.  A window is three consecutive lines; windows
of white space only do not count.  Of equal windows anywhere in the table the one with the smallest
(doc_id, line) is first; every line covered by a later one goes.  Each removed line is preceded by
an equal line that stays, since a covering window always refers to a strictly earlier place.

Null and empty texts have one empty line and no window, so they stay as they are.  Rows that repeat
both doc_id and text are one document and stay or lose lines together.  Null ids sort first.
"""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import (REST, ROW, free_name, map_batches, packed, same_document, stored,
                                 texts_of, with_row_key)

WINDOW = 3


def line_windows(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, row, line, window): the 128-bit hash of each run of ``size`` lines."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batch: pa.RecordBatch):
        at, lines, found = [], [], []
        for i, body in enumerate(texts_of(batch.column(2))):
            parts = body.split(b"\n")
            if len(parts) < size:
                continue
            marks = [xxhash.xxh3_128_digest(p) for p in parts]
            solid = [bool(p.strip()) for p in parts]
            for k in range(len(parts) - size + 1):
                if any(solid[k:k + size]):
                    at.append(i)
                    lines.append(k)
                    found.append(xxhash.xxh3_128_digest(b"".join(marks[k:k + size])))
        rows = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(lines, pa.int32()),
             pa.array(found, pa.binary())], ["doc_id", ROW, "__line", "__window"])

    narrow = with_row_key(docs, text).select("doc_id", ROW, F.col(text).alias("__text"))
    return map_batches(narrow, cut, f"doc_id {kind}, {ROW} long, __line int, __window binary")


def later_windows(windows: DataFrame) -> DataFrame:
    """Windows that are equal to an earlier one.  First places are folded in the map tasks; the
    join of a hot window is split at run time, since neither side needs its rows together."""
    place = F.struct("doc_id", ROW, "__line")
    first = windows.groupBy("__window").agg(
        F.count("*").alias("__n"), F.min(place).alias("__first")).filter("__n > 1").drop("__n")
    return windows.join(first, "__window").filter(~place.eqNullSafe(F.col("__first"))).select(
        "doc_id", ROW, "__line")


def count_names(docs: DataFrame) -> tuple[str, str]:
    """Names of the two columns that ``dedup_lines`` adds; a taken name gets underscores in front."""
    return free_name("__n_lines", docs.columns), free_name("__n_removed", docs.columns)


def dedup_lines(docs: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with the text that stays, and the columns of ``count_names``."""
    windows = stored(line_windows(docs, text, size), "line-windows")
    starts = later_windows(windows).groupBy("doc_id", ROW).agg(
        F.collect_set("__line").alias("__starts"))
    inner = packed(docs, "doc_id", text)
    joined = same_document(with_row_key(inner, text), starts)

    def apply(batch: pa.RecordBatch):
        names = batch.schema.names
        body, at = batch.column(names.index(text)), batch.column(names.index("__starts"))
        out, total, gone = [], [], []
        for value, begins in zip(body.to_pylist(), at.to_pylist()):
            lines = (value or "").split("\n")
            total.append(len(lines))
            if not begins:
                out.append(value)
                gone.append(0)
                continue
            covered = {k for b in begins for k in range(b, b + size)}
            out.append("\n".join(x for k, x in enumerate(lines) if k not in covered))
            gone.append(len(covered))
        columns = [pa.array(out, pa.string()) if n == text else batch.column(i)
                   for i, n in enumerate(names) if n not in ("__starts", ROW)]
        kept = [n for n in names if n not in ("__starts", ROW)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())],
            [*kept, "__n_lines", "__n_removed"])

    added = [F.lit(0).cast("long").alias(n) for n in ("__n_lines", "__n_removed")]
    schema = inner.select("*", *added).schema
    lines, removed = count_names(docs)
    return map_batches(joined, apply, schema).select(
        *[F.col(f"`{c}`") if c in ("doc_id", text) else F.col(REST).getField(c).alias(c)
          for c in docs.columns],
        F.col("__n_lines").alias(lines), F.col("__n_removed").alias(removed))


def line_report(docs: DataFrame) -> DataFrame:
    """Per document: lines, removed lines and the hash of the text that stays."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


LINE_SQL = """
with d as (select doc_id, coalesce(text, '') as t from documents),
l as (select doc_id, t, string_split(t, chr(10)) as ls from d),
n as (select doc_id, t, ls, unnest(range(len(ls))) as i from l),
w as (select doc_id, t, i, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] as win from n
      where i + 3 <= len(ls)
        and trim(ls[i + 1] || ls[i + 2] || ls[i + 3],
                 ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
f as (select win, min({'d': doc_id, 'i': i}) as first from w group by win having count(*) > 1),
later as (select distinct w.doc_id, w.i from w join f using (win)
          where {'d': w.doc_id, 'i': w.i} <> f.first),
gone as (select distinct doc_id, i + unnest([0, 1, 2]) as i from later)
select n.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
       sha256(coalesce(string_agg(n.ls[n.i + 1], chr(10) order by n.i) filter (gone.i is null), ''))
         as kept_sha256
from n left join gone on gone.doc_id = n.doc_id and gone.i = n.i
group by n.doc_id
"""
