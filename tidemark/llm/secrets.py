"""Secret scan: keyword automaton, anchored patterns near its hits, embedded checksums.

One Aho-Corasick automaton finds the keywords of every kind in the lower-cased text; a kind's
pattern is tried only at the places of its keywords.  Kinds whose format embeds a checksum are
kept only when the checksum fits.  Runs of hexadecimal digits have no keyword; they are found by
their own pattern in one pass.

Per kind, matches are leftmost and do not overlap; a match that is too short is used up and
dropped.  Null and empty texts have no spans.  Every row gives one row, repeated rows too.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches
from tidemark.llm.decontaminate import ascii_lower

# Fixed formats: the order of the kinds is the order of ties.
KINDS = ("assign", "access", "hex", "forge", "package", "board")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "forge": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "package": ("npm_",),
    "board": ("glsa_",),
}
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
FORGE = re.compile("gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
PACKAGE = re.compile("npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BOARD = re.compile("(glsa_[A-Za-z0-9]{32})_([0-9a-f]{8})(?![A-Za-z0-9])")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(number: int, width: int) -> str:
    out = ""
    while number:
        number, rest = divmod(number, 62)
        out = DIGITS62[rest] + out
    return out.rjust(width, "0")


def crc62(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of the random part in base 62."""
    return base62(zlib.crc32(match[1].encode()), 6) == match[2]


def crc_hex(match: re.Match) -> bool:
    return f"{zlib.crc32(match[1].encode()):08x}" == match[2]


RULES = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "forge": (FORGE, crc62),
    "package": (PACKAGE, crc62),
    "board": (BOARD, crc_hex),
}


def keyword_automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def find_spans(text: str, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind; offsets in code points, end exclusive."""
    out = []
    used = dict.fromkeys(RULES, 0)
    starts: dict[str, list[int]] = {}
    for end, (kind, length) in automaton.iter(ascii_lower(text)):
        starts.setdefault(kind, []).append(end - length + 1)
    for kind, places in starts.items():
        pattern, valid = RULES[kind]
        for place in sorted(places):
            if place < used[kind]:
                continue
            match = pattern.match(text, place)
            if match:
                used[kind] = match.end()
                if valid(match):
                    out.append((place, match.end(), kind))
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, spans: array of kind, start, end, value) of every row, without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                      ("value", pa.string())])
    made: list = []

    def find(batch: pa.RecordBatch):
        if not made:
            made.append(keyword_automaton())
        rows = []
        for value in batch.column(1).to_pylist():
            spans = find_spans(value, made[0]) if value else []
            rows.append([{"kind": k, "start": a, "end": b, "value": value[a:b]}
                         for a, b, k in spans])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    narrow = docs.select("doc_id", F.col(text).alias("__text"))
    return map_batches(narrow, find, f"doc_id {kind}, "
                       "spans array<struct<kind:string,start:int,end:int,value:string>>")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their places and the places of all kinds."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return scan_secrets(docs).select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one mark."""
    def clean(batch: pa.RecordBatch):
        automaton = keyword_automaton()
        names = batch.schema.names
        out = []
        for value in batch.column(names.index(text)).to_pylist():
            if value:
                pieces, at = [], 0
                for a, b, _ in find_spans(value, automaton):
                    if a >= at:
                        pieces += [value[at:a], mark]
                    at = max(at, b)
                value = "".join([*pieces, value[at:]])
            out.append(value)
        columns = [pa.array(out, pa.string()) if n == text else batch.column(i)
                   for i, n in enumerate(names)]
        yield pa.RecordBatch.from_arrays(columns, names)
    return map_batches(docs, clean, docs.schema)


def brute_force(text: str | None) -> tuple[int, int, int, str]:
    """Counts and hash of the base kinds with plain patterns; for tests."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    counts = [sum(1 for s in spans if s[1] == k) for k in range(3)]
    return (*counts, hashlib.sha256(joined.encode()).hexdigest())
