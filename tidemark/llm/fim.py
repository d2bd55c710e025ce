"""Fill-in-middle transformation, cut with SWAR words.

A text is cut after whole units, runs of ASCII letters or single other code points.  Its UTF-8
bytes are viewed as little-endian 64-bit words.  Bytes that end a unit are marked in the top bit of
their lane by arithmetic on whole words, counted per word, and the k-th mark is found by a search in
the running counts and a select inside one word.  No list of units is ever made.

Results of odd cases: null text is the empty text; empty texts and texts that already hold a
sentinel stay plain; a null key counts as the empty string; rows that repeat a key and a text get
equal results.  All columns of the input stay as they are and one struct column is added, whose name
is a parameter; a column of that name is replaced, as ``withColumn`` does.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts_of

SEED = 1
RATE = 90  # texts of a hundred that are cut
SPM = 20  # of a hundred cut texts, those that start with the suffix
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SHAPE = "units long, form string, prefix_chars long, middle_chars long, output string"
BLOCK_BYTES = 4 << 20

_TOP = np.uint64(0x8080808080808080)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_ONES = np.uint64(0x0101010101010101)
_CASE = np.uint64(0x2020202020202020)
_TO_A = _ONES * np.uint64(0x80 - ord("a"))
_PAST_Z = _ONES * np.uint64(0x80 - ord("z") - 1)
# bytes below a place in the word
_BELOW = np.array([(1 << (8 * k)) - 1 for k in range(8)], np.uint64)


def following(marks: np.ndarray) -> np.ndarray:
    """Marks of the byte after each byte."""
    out = marks >> np.uint64(8)
    out[:-1] |= marks[1:] << np.uint64(56)
    return out


def inner_bytes(words: np.ndarray) -> np.ndarray:
    """Marks of the bytes that continue a code point (10xxxxxx)."""
    return words & ~(words << np.uint64(1)) & _TOP


def letter_bytes(words: np.ndarray) -> np.ndarray:
    """Marks of A-Z and a-z.  Lanes are cut to seven bits, so no sum reaches the next lane."""
    low = (words | _CASE) & _LOW7
    return (low + _TO_A) & ~(low + _PAST_Z) & ~words & _TOP


def unit_ends(words: np.ndarray) -> np.ndarray:
    """Marks of the bytes that end a unit."""
    letters = letter_bytes(words)
    return _TOP & ~(following(inner_bytes(words)) | (letters & following(letters)))


def select_in_word(marks: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Byte place of the nth mark (1 to 8) of each word."""
    running = (marks >> np.uint64(7)) * _ONES
    reached = (running + (np.uint64(0x80) - nth.astype(np.uint64)) * _ONES) & _TOP
    return 8 - np.bitwise_count(reached).astype(np.int64)


class Units:
    """Units and code points of many texts, each padded to whole words by at least one byte."""

    def __init__(self, texts: list[bytes]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        lengths = sizes // 8 + 1
        self.first = np.concatenate(([0], np.cumsum(lengths)))
        packed = b"".join(t.ljust(n * 8) for t, n in zip(texts, lengths.tolist()))
        words = np.frombuffer(packed, "<u8")
        inside = np.full(len(words), ~np.uint64(0))
        inside[self.first[1:] - 1] = _BELOW[sizes % 8]
        self.ends = unit_ends(words) & inside
        self.leads = ~inner_bytes(words) & _TOP & inside
        self.ends_before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.ends), dtype=np.int64)))
        self.leads_before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.leads), dtype=np.int64)))
        self.counts = np.diff(self.ends_before[self.first])

    def cut_after(self, units: np.ndarray) -> np.ndarray:
        """Byte offset in each text behind so many units."""
        begin = self.first[:-1]
        wanted = self.ends_before[begin] + units
        word = np.searchsorted(self.ends_before, wanted) - 1
        at = np.maximum(word, 0)
        place = select_in_word(self.ends[at], np.maximum(wanted - self.ends_before[at], 1))
        return np.where(units > 0, (at - begin) * 8 + place + 1, 0)

    def chars_before(self, offsets: np.ndarray) -> np.ndarray:
        """Code points of each text before a byte offset."""
        begin = self.first[:-1]
        word = begin + offsets // 8
        part = np.bitwise_count(self.leads[word] & _BELOW[offsets % 8])
        return self.leads_before[word] - self.leads_before[begin] + part


_SENTINEL = re.compile(b"|".join(s.encode() for s in (PREFIX, SUFFIX, MIDDLE)))


def rearrange(texts: list[bytes], dice: list[str], rate: int, spm: int) -> pa.StructArray:
    """The struct of ``SHAPE`` for each text; ``dice`` holds 32 hex digits or more per text."""
    units = Units(texts)
    h = np.array([[int(d[k:k + 8], 16) for k in (0, 8, 16, 24)] for d in dice],
                 np.int64).reshape(-1, 4)
    ends = np.sort(h[:, :2] % (units.counts + 1)[:, None], axis=1)
    low, high = units.cut_after(ends[:, 0]), units.cut_after(ends[:, 1])
    before, through = units.chars_before(low), units.chars_before(high)
    cut = np.array([bool(t) and not _SENTINEL.search(t) for t in texts], bool) & (h[:, 2] % 100 < rate)
    turned = h[:, 3] % 100 < spm
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    form, output = [], []
    for t, yes, back, a, b in zip(texts, cut.tolist(), turned.tolist(), low.tolist(), high.tolist()):
        if not yes:
            form.append("plain")
            output.append(t)
        elif back:
            form.append("spm")
            output.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
        else:
            form.append("psm")
            output.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
    return pa.StructArray.from_arrays(
        [pa.array(units.counts), pa.array(form, pa.string()),
         pa.array(before, mask=~cut), pa.array(through - before, mask=~cut),
         pa.array(output, pa.binary()).cast(pa.string())],
        ["units", "form", "prefix_chars", "middle_chars", "output"])


def blocks(sizes: list[int], limit: int):
    """Runs of rows of about ``limit`` bytes; one longer text is a run of its own."""
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > limit:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def cutter(rate: int, spm: int):
    """An Arrow function of (text, hex digits); only these two columns meet Python."""
    @F.arrow_udf(SHAPE)
    def cut(text: pa.Array, dice: pa.Array) -> pa.Array:
        texts, digits = texts_of(text), dice.to_pylist()
        parts = [rearrange(texts[a:b], digits[a:b], rate, spm)
                 for a, b in blocks(list(map(len, texts)), BLOCK_BYTES)]
        return pa.concat_arrays(parts) if parts else rearrange([], [], rate, spm)
    return cut


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM,
                   text: str = "text", key: str = "doc_id", into: str = "fim") -> DataFrame:
    """``docs`` with the struct column ``into``; without a shuffle."""
    dice = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
                           ).cast("binary"), 256)
    return docs.withColumn(into, cutter(rate, spm)(F.col(f"`{text}`"), dice))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from.

    Each sentinel occurs once in a rearranged text: no sentinel overlaps itself or another, so
    neither the parts nor their seams can make a second one.
    """
    def part(of, mark, n):
        return F.split_part(of, F.lit(mark), F.lit(n))

    head, tail = part(output, SUFFIX, 1), part(output, SUFFIX, 2)
    psm = F.concat(F.substr(head, F.lit(len(PREFIX) + 1)), part(tail, MIDDLE, 2), part(tail, MIDDLE, 1))
    front, rest = part(output, PREFIX, 1), part(output, PREFIX, 2)
    spm = F.concat(part(rest, MIDDLE, 1), part(rest, MIDDLE, 2),
                   F.substr(front, F.lit(len(SUFFIX) + 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """Units, form, part lengths and hashes of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs.select("doc_id", "text"))
    return made.select(
        "doc_id", F.col("fim.units").alias("n"), F.col("fim.form").alias("form"),
        F.col("fim.prefix_chars").alias("prefix_chars"),
        F.col("fim.middle_chars").alias("middle_chars"),
        F.sha2(F.col("fim.output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")).cast("binary"), 256
               ).alias("restored_sha256"))


FIM_SQL = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || coalesce(doc_id::varchar, '')) as h
           from documents),
u as (select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as us,
             ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2,
             ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
c as (select doc_id, t, us, len(us) as n,
             least(h1 % (len(us) + 1), h2 % (len(us) + 1)) as a,
             greatest(h1 % (len(us) + 1), h2 % (len(us) + 1)) as b,
             case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
                       or h3 % 100 >= 90 then 'plain'
                  when h4 % 100 < 20 then 'spm' else 'psm' end as form from u),
p as (select doc_id, t, n, form, coalesce(array_to_string(us[1:a], ''), '') as pre,
             coalesce(array_to_string(us[a + 1:b], ''), '') as mid,
             coalesce(array_to_string(us[b + 1:n], ''), '') as suf from c)
select doc_id, n::bigint as n, form,
       case when form <> 'plain' then length(pre) end as prefix_chars,
       case when form <> 'plain' then length(mid) end as middle_chars,
       sha256(case form when 'plain' then t
                        when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
                        else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
       sha256(case form when 'plain' then t else pre || mid || suf end) as restored_sha256
from p
"""


_UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def brute_force(key, text: str | None, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) by plain lists of units, for tests."""
    text = text or ""
    units = _UNIT.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    if h4 % 100 < spm:
        return len(units), "spm", len(pre), len(mid), f"{SUFFIX}{suf}{PREFIX}{pre}{MIDDLE}{mid}"
    return len(units), "psm", len(pre), len(mid), f"{PREFIX}{pre}{SUFFIX}{suf}{MIDDLE}{mid}"
