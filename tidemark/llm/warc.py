"""WARC archives from a chunked record table, and back.

A page's payload is one value of its table, so Spark holds it as one value too; nothing here makes
a second whole copy of it.  Its task cuts it into rows (record, chunk number, bytes) one after the other
with a running digest, and every row becomes one WARC record, so an oversized payload is a first
record and ``continuation`` segments, as the format provides.  Spark's text writer puts the records
into gzip files of bounded size, in any storage that Spark can write.  The reader walks through an
archive with a bounded buffer; segments meet by record and are digested one after the other.

Payloads of at least ``min_bytes`` that are equal (SHA-1 and length) are stored once: the page with
the largest id is the response and the others are revisits of it.  A null payload counts as
empty.  Rows that repeat id and payload of the response are responses too.  A page without an id
is a response when no equal page has one, else a revisit.  An empty table gives no archive rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored
from tidemark.session import scratch_path

CHUNK_BYTES = 64 << 10
ROWS_PER_FILE = 512  # rows of at most two chunks: an archive holds 64 MB of records at most
BREAK = b"\r\n\r\n"
CAPTURED = "1970-01-01T00:00:00Z"
READ_BYTES = 256 << 10


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def planned(pages: DataFrame, payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Each page with its payload's bytes, length and SHA-1, record type and referred page."""
    rows = pages.select(
        F.col("page_id").alias("__page"), F.col("url").cast("string").alias("__url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("__body"))
    marks = [F.unhex(F.sha1("__body")).alias("__sha"),
             F.length("__body").cast("long").alias("__size")]
    groups = stored(
        rows.select("__page", *marks).filter(F.col("__size") >= min_bytes)
        .groupBy("__sha", "__size").agg(F.max("__page").alias("__keep"), F.count("*").alias("__n"))
        .filter("__n > 1").drop("__n"), "warc-groups")
    refers = F.when(F.col("__keep").isNotNull() & ~F.col("__page").eqNullSafe(F.col("__keep")),
                    F.col("__keep"))
    return rows.select("*", *marks).join(groups, ["__sha", "__size"], "left").select(
        "__page", "__url", "__body", "__sha", "__size", refers.alias("__refers"))


CHUNK_TYPE = ("__record long, __page string, __url string, __sha binary, __size long, __refers string, "
              "__chunks int, __chunk int, __bytes binary")


def chunks_of(batch: pa.RecordBatch, chunk: int) -> Iterator[dict]:
    """The chunk rows of some pages, one at a time.  A payload is read where the batch holds it, cut
    without copying more than a chunk, and digested on the way; revisits have one row without bytes."""
    column = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        row = {n: c[i].as_py() for n, c in column.items() if n != "__body"}
        body = column["__body"][i].as_buffer() if row["__refers"] is None else None
        view = memoryview(body) if body is not None else memoryview(b"")
        row["__chunks"] = max(1, -(-len(view) // chunk))
        digest = hashlib.sha1()
        for number in range(row["__chunks"]):
            data = bytes(view[number * chunk:(number + 1) * chunk])
            digest.update(data)
            yield {**row, "__chunk": number, "__bytes": data}
        if row["__refers"] is None and digest.digest() != row["__sha"]:
            raise ValueError(f"payload of page {row['__page']} changed while it was cut")


def numbered(plan: DataFrame) -> DataFrame:
    """Pages with a record identifier; ids as text, the payload as it is."""
    return plan.select(
        F.monotonically_increasing_id().alias("__record"), F.col("__page").cast("string").alias("__page"),
        "__url", "__sha", "__size", F.col("__refers").cast("string").alias("__refers"), "__body")


def chunk_rows(plan: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table: (record, chunk number, bytes) and what the record's header needs."""
    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                rows, size = [], 0
                for row in chunks_of(part, chunk):
                    rows.append(row)
                    size += len(row["__bytes"]) + 256
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, CHUNKS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, CHUNKS)
    return numbered(plan).mapInArrow(cut, CHUNK_TYPE)


CHUNKS = pa.schema([
    ("__record", pa.int64()), ("__page", pa.string()), ("__url", pa.string()), ("__sha", pa.binary()),
    ("__size", pa.int64()), ("__refers", pa.string()), ("__chunks", pa.int32()),
    ("__chunk", pa.int32()), ("__bytes", pa.binary())])


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = ["WARC/1.1"] + [f"{k}: {v}" for k, v in fields if v is not None]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + BREAK


def one_line(value: str | None) -> str | None:
    return None if value is None else value.replace("\r", "%0D").replace("\n", "%0A")


def record_of(row: dict) -> bytes:
    """The WARC record of one chunk row, without the closing break."""
    name, page = row["__record"], row["__page"]
    number, chunks, data = row["__chunk"], row["__chunks"], row["__bytes"]
    kind = "revisit" if row["__refers"] is not None else "response" if number == 0 else "continuation"
    if kind == "response":
        data = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
                f"{row['__size']}").encode() + BREAK + data
    return header([
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:record:{name}:{number}>"),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", one_line(row["__url"])),
        ("WARC-Refers-To", f"<urn:page:{row['__refers']}>" if kind == "revisit" else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
         if kind == "revisit" else None),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(row['__sha'])}" if number == 0 else None),
        ("WARC-Segment-Number", number + 1 if chunks > 1 else None),
        ("WARC-Segment-Origin-ID", f"<urn:record:{name}:0>" if number else None),
        ("WARC-Segment-Total-Length", row["__size"] if chunks > 1 and number == chunks - 1 else None),
        ("X-Page-ID", page if number == 0 else None),
        ("X-Payload-Length", row["__size"] if number == 0 else None),
        ("Content-Type", "application/http; msgtype=response" if kind == "response"
         else "application/octet-stream"),
        ("Content-Length", len(data)),
    ]) + data


def write_archives(pages: DataFrame, path: str, payload: str = "html", min_bytes: int = 0,
                   chunk: int = CHUNK_BYTES) -> None:
    """Write gzip WARC files under ``path``, each of at most ROWS_PER_FILE rows of about a chunk.

    Small records share a row, so the bytes of a file are bounded from above and not tiny.
    """
    def format_rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch):
                rows, total, held, size = [], 0, [], 0
                for row in chunks_of(part, chunk):
                    held.append(record_of(row))
                    size += len(held[-1])
                    if size >= CHUNK_BYTES:
                        rows.append(BREAK.join(held))
                        total, held, size = total + size, [], 0
                    if total > READ_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])
                        rows, total = [], 0
                if held:
                    rows.append(BREAK.join(held))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    lines = numbered(planned(pages, payload, min_bytes)).mapInArrow(format_rows, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option(
        "compression", "gzip").option("maxRecordsPerFile", ROWS_PER_FILE).text(path)


class Archive:
    """Pulls records out of a gzip archive with a buffer of one read and one record."""

    def __init__(self, data: bytes):
        self.data, self.at = memoryview(data), 0
        self.inflate, self.buffer = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.at >= len(self.data):
            return False
        piece = self.data[self.at:self.at + READ_BYTES]
        self.at += len(piece)
        while piece:
            self.buffer += self.inflate.decompress(piece)
            piece = self.inflate.unused_data
            if piece:  # the next gzip member
                self.inflate = zlib.decompressobj(31)
        return True

    def records(self) -> Iterator[tuple[dict[str, str], bytes]]:
        while True:
            while (cut := self.buffer.find(BREAK)) < 0:
                if not self._more():
                    if self.buffer.strip():
                        raise ValueError("the archive ends inside a record")
                    return
            lines = self.buffer[:cut].decode("utf-8", "surrogatepass").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = dict(line.split(": ", 1) for line in lines[1:])
            begin = cut + len(BREAK)
            end = begin + int(fields["Content-Length"])
            while len(self.buffer) < end + len(BREAK):
                if not self._more():
                    raise ValueError("the archive ends inside a record")
            yield fields, bytes(self.buffer[begin:end])
            del self.buffer[:end + len(BREAK)]


SEGMENTS = pa.schema([
    ("__record", pa.string()), ("__segment", pa.int32()), ("__total", pa.int64()),
    ("__page", pa.string()), ("__size", pa.int64()), ("__said", pa.string()),
    ("__digest", pa.string()), ("__kind", pa.string()), ("__refers", pa.string()),
    ("__bytes", pa.binary())])
SEGMENT_TYPE = ("__record string, __segment int, __total long, __page string, __size long, "
                "__said string, __digest string, __kind string, __refers string, __bytes binary")


def between(value: str | None, mark: str) -> str | None:
    return None if value is None else value.removeprefix(f"<urn:{mark}:").removesuffix(">")


def segment_of(fields: dict[str, str], data: bytes) -> dict:
    kind = fields["WARC-Type"]
    number = int(fields.get("WARC-Segment-Number", 1))
    if kind == "response":
        data = data[data.index(BREAK) + len(BREAK):]
    origin = fields.get("WARC-Segment-Origin-ID", fields["WARC-Record-ID"])
    alone = "WARC-Segment-Number" not in fields
    said = fields.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
    size = fields.get("X-Payload-Length")
    row = {"__record": between(origin, "record"), "__segment": number, "__total": None,
           "__page": fields.get("X-Page-ID"), "__size": None if size is None else int(size),
           "__said": said, "__kind": kind, "__refers": between(fields.get("WARC-Refers-To"), "page"),
           "__digest": None, "__bytes": None}
    if "WARC-Segment-Total-Length" in fields:
        row["__total"] = int(fields["WARC-Segment-Total-Length"])
    if kind == "revisit":
        row["__digest"] = said
    elif alone:  # digested where it is read; the bytes go no further
        row["__digest"] = base32_sha1(hashlib.sha1(data).digest())
        if row["__digest"] != said or len(data) != row["__size"]:
            raise ValueError(f"payload of record {row['__record']} is damaged")
    else:
        row["__bytes"] = data
    return row


def read_segments(spark, path: str) -> DataFrame:
    """One row per WARC record; only segments of an oversized payload carry bytes."""
    def walk(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for fields, data in Archive(batch.column(0)[i].as_py()).records():
                    rows.append(segment_of(fields, data))
                    size += len(rows[-1]["__bytes"] or b"") + 256
                    if size > READ_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, SEGMENTS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SEGMENTS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(walk, SEGMENT_TYPE)


def read_archives(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every stored page.

    Segments are dealt by record and sorted by number; the digest moves on from row to row.
    """
    def digest(batches: Iterator[pa.RecordBatch]):
        state: dict = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["__digest"] is not None:
                    out.append(row)
                    continue
                if row["__segment"] == 1:
                    state = {"row": row, "sha": hashlib.sha1(), "size": 0, "next": 1}
                if not state or state["row"]["__record"] != row["__record"] or (
                        state["next"] != row["__segment"]):
                    raise ValueError(f"a segment of record {row['__record']} is missing")
                state["sha"].update(row["__bytes"])
                state["size"] += len(row["__bytes"])
                state["next"] += 1
                if row["__total"] is not None:
                    whole = state["row"]
                    whole["__digest"] = base32_sha1(state["sha"].digest())
                    if state["size"] != row["__total"] or whole["__digest"] != whole["__said"]:
                        raise ValueError(f"payload of record {row['__record']} is damaged")
                    out.append(whole)
                    state = {}
            for row in out:
                row["__bytes"] = None
            yield pa.RecordBatch.from_pylist(out, SEGMENTS)
        if state:
            raise ValueError(f"record {state['row']['__record']} has no last segment")

    # a record is written once, so no key is hot; one oversized payload streams through one task
    dealt = read_segments(spark, path).repartition("__record").sortWithinPartitions(
        "__record", "__segment")
    return dealt.mapInArrow(digest, SEGMENT_TYPE).select(
        F.col("__page").cast(id_type).alias("page_id"), F.col("__size").alias("payload_bytes"),
        F.col("__digest").alias("payload_digest"), F.col("__kind").alias("record_type"),
        F.col("__refers").cast(id_type).alias("refers_to"))


def archive_report(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK_BYTES) -> DataFrame:
    """Write the archives of ``pages`` to the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, min_bytes=min_bytes, chunk=chunk)
    return read_archives(spark, path, pages.schema["page_id"].dataType.simpleString())


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, strlen(body) as n, sha1(body) as s from p),
k as (select s, n, max(page_id) as keep from h group by s, n),
v as (select h.*, k.keep, list_transform(range(8), lambda c:
        cast('0x' || substr(h.s, cast(c * 5 + 1 as bigint), 5) as bigint)) as q
      from h join k using (s, n))
select page_id, n as payload_bytes,
       list_aggregate(list_transform(q, lambda x:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31) + 1, 1) ||
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31) + 1, 1)), 'string_agg', '')
         as payload_digest,
       case when page_id = keep then 'response' else 'revisit' end as record_type,
       case when page_id <> keep then keep end as refers_to
from v
"""
