"""Text cleaning, keys, keyword hits and search as Columns."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import (
    ANGER_SAD_WORDS, BUCKETS, EMOTION_TERMS, FEAR_WORDS, OBJECTIVE_CUES, SARCASM_TERMS,
    SURPRISE_WORDS,
)

# Fixed patterns.  Word and space classes are spelled out so that they mean the
# same in Java, RE2 and Python: letters, numbers and underscore of any script.
SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
WORD = r"\p{L}\p{N}_"
URL = rf"https?://[^{SPACE}]+"
REPOST = rf"//[{SPACE}]*@[^{SPACE}:：]+[:：]?"
MENTION = rf"@[{WORD}\-]+"
HASHTAG = r"#([^#]+)#"
SPACES = rf"[{SPACE}]+"
LEGACY_URL = r"https?://(?:[A-Za-z0-9$\-_@.&+!*(),]|%[0-9a-fA-F]{2})+"
EMAIL = rf"[{WORD}.\-]+@[{WORD}.\-]+\.[{WORD}]+"
NON_WORD = r"[^\p{L}\p{N}]+"
FEATURES = {
    "url": URL,
    "at_mention": MENTION,
    "topic": rf"#[^#{SPACE}]+#",
    "retweet": rf"//[{SPACE}]*@",
    "wb_emoji": r"\[[^\[\]]{1,8}\]",
}
# Customary bounds for short posts; whole texts are the default.
MAX_CHARS = 512
LEGACY_MAX_CHARS = 140
NEAR_KEY_CHARS = 160

# Frequent traditional characters and their simplified forms, position by position.
# A fuller table is a parameter of the cleaners.
TRADITIONAL = "們個來這時說國會對學發經現長開關問題間見門東車馬鳥魚龍風飛電買賣讀書話語請謝認識讓給紅綠級紙線細組織結終繼續愛戀親實寶寫應該雖樣機樂歡氣溫熱點無業專義習鄉雙變歷萬與為產傷淚憤懼驚嚇樓圖團園圓衛護讚"
SIMPLIFIED = "们个来这时说国会对学发经现长开关问题间见门东车马鸟鱼龙风飞电买卖读书话语请谢认识让给红绿级纸线细组织结终继续爱恋亲实宝写应该虽样机乐欢气温热点无业专义习乡双变历万与为产伤泪愤惧惊吓楼图团园圆卫护赞"

# Characters whose presence may change a text under NFKC.  All others (ASCII, most of Latin-1,
# Latin Extended-A, the basic CJK block and its comma and full stop) are stable in any sequence.
NFKC_UNSTABLE = (r"[\u00A0\u00A8\u00AA\u00AF\u00B2-\u00B5\u00B8-\u00BA\u00BC-\u00BE"
                 r"\u0132-\u3000\u3003-\u4DFF\u9FA6-\x{10FFFF}]")


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # one text at a time becomes a Python object
    return pa.array((None if not t.is_valid else unicodedata.normalize("NFKC", t.as_py())
                     for t in texts), texts.type)


def nfkc(col: Column) -> Column:
    """Unicode NFKC.  Only texts that could change are sent to Python."""
    candidate = F.when(col.rlike(NFKC_UNSTABLE), col)
    return F.coalesce(_nfkc(candidate), col)


def to_simplified(col: Column, table: dict[str, str] | None = None) -> Column:
    """Traditional to simplified, character by character."""
    if table is None:
        return F.translate(col, TRADITIONAL, SIMPLIFIED)
    return F.translate(col, "".join(table), "".join(table.values()))


def drop_urls(col: Column) -> Column:
    return F.regexp_replace(col, URL, "")


def drop_reposts(col: Column) -> Column:
    return F.regexp_replace(col, REPOST, "")


def drop_mentions(col: Column) -> Column:
    return F.regexp_replace(col, MENTION, "")


def unwrap_hashtags(col: Column) -> Column:
    return F.regexp_replace(col, HASHTAG, "$1")


def squeeze(col: Column, max_chars: int | None = None) -> Column:
    """Collapse white space, trim, and optionally keep the first ``max_chars`` characters."""
    out = F.trim(F.regexp_replace(col, SPACES, " "))
    return out if max_chars is None else F.substring(out, 1, max_chars)


def strip_markup(col: Column) -> Column:
    """The regex part of the cleaner, in its fixed order: URLs, reposts, mentions, hashtags."""
    return unwrap_hashtags(drop_mentions(drop_reposts(drop_urls(F.lower(col)))))


def clean_text(col: Column, max_chars: int | None = None,
               table: dict[str, str] | None = None, unicode_form: bool = True) -> Column:
    """The standard cleaner; a missing text becomes ''.  The order of steps matters."""
    text = F.coalesce(col, F.lit(""))
    if unicode_form:
        text = nfkc(text)
    return squeeze(strip_markup(to_simplified(text, table)), max_chars)


def clean_text_legacy(col: Column, max_chars: int | None = None,
                      table: dict[str, str] | None = None, unicode_form: bool = True) -> Column:
    """The older cleaner: stricter URLs, e-mail removal, no hashtag or repost step."""
    text = nfkc(col) if unicode_form else col
    text = F.lower(to_simplified(text, table))
    for pattern in (LEGACY_URL, EMAIL, MENTION):
        text = F.regexp_replace(text, pattern, "")
    return squeeze(text, max_chars)


def near_dedupe_key(col: Column, max_chars: int | None = None) -> Column:
    """Letters and numbers only; optionally the first ``max_chars`` of them."""
    compact = F.regexp_replace(col, NON_WORD, "")
    return compact if max_chars is None else F.substring(compact, 1, max_chars)


def content_hash(col: Column) -> Column:
    """Stable 64-bit hash of a text as 16 hex digits."""
    return F.substring(F.sha2(col, 256), 1, 16)


def feature_flags(col: Column) -> dict[str, Column]:
    return {name: col.rlike(pattern) for name, pattern in FEATURES.items()}


def in_length_band(col: Column, low: int = 4, high: int = MAX_CHARS) -> Column:
    return F.length(col).between(low, high)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(col: Column) -> Column:
    return F.translate(col, _UPPER, _UPPER.lower())


def search_argument(raw: str | None) -> str:
    return (raw or "").strip()


def contains_ignore_case(query: str, *cols: Column) -> Column:
    """True when any column contains the query; only ASCII letters are folded."""
    needle = F.lit("".join(c.lower() if c in _UPPER else c for c in search_argument(query)))
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(F.contains(ascii_lower(col), needle), F.lit(False))
    return hit


def shorten(col: Column, max_chars: int) -> Column:
    """Trimmed text, cut to ``max_chars`` with '...' when longer."""
    text = F.trim(F.coalesce(col, F.lit("")))
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.rtrim(F.substring(text, 1, max_chars)), F.lit("..."))
    )


def cut(col: Column, max_chars: int) -> Column:
    """Text cut to ``max_chars`` with '...' when longer, blanks as they are."""
    text = F.coalesce(col, F.lit(""))
    return F.when(F.length(text) <= max_chars, text).otherwise(
        F.concat(F.substring(text, 1, max_chars), F.lit("...")))


def topic_title_key(title: Column) -> Column:
    """Topic title without surrounding blanks and '#', in lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(title), r"^#+|#+$", "")))


def topic_title_id(title: Column) -> Column:
    """Stable id of a normalised title: the first 60 bits of its SHA-256."""
    digits = F.substring(F.sha2(topic_title_key(title), 256), 1, 15)
    return F.conv(digits, 16, 10).cast("bigint")


def reply_json(text: Column) -> Column:
    """The JSON object inside a model reply, with or without a code fence; null when absent."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


# ------------------------------------------------------------------ keywords
def alternation(words: Iterable[str]) -> str:
    """Longest-first alternation of literal words."""
    ordered = sorted(set(words), key=lambda w: (-len(w), w))
    return "|".join(re.escape(w) for w in ordered)


def distinct_hits(text: Column, words: Sequence[str]) -> Column:
    """Distinct matches of the words, longest first, then by text descending."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(alternation(words)), F.lit(0)))
    return longest_first(found)


def longest_first(words: Column) -> Column:
    keyed = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    return F.transform(F.sort_array(keyed, asc=False), lambda s: s["w"])


@dataclass(frozen=True)
class KeywordLists:
    """Words of the mining buckets; the defaults are the fixed lists."""

    fear: Sequence[str] = FEAR_WORDS
    surprise: Sequence[str] = SURPRISE_WORDS
    anger_sad_boundary: Sequence[str] = ANGER_SAD_WORDS
    objective: Sequence[str] = OBJECTIVE_CUES
    emotion: Sequence[str] = EMOTION_TERMS
    sarcasm: Sequence[str] = SARCASM_TERMS

    def bucket_hits(self, text: Column) -> dict[str, Column]:
        hits = {b: distinct_hits(text, getattr(self, b)) for b in BUCKETS[:3]}
        hits["hard_negative"] = self.hard_negative_hits(text)
        return hits

    def hard_negative_hits(self, text: Column) -> Column:
        """(objective cue and emotion term) or sarcasm, as a word list; empty otherwise."""
        return self._hard(text.rlike(alternation(self.objective)),
                          distinct_hits(text, self.emotion), distinct_hits(text, self.sarcasm))

    @staticmethod
    def _hard(objective: Column, emotion: Column, sarcasm: Column) -> Column:
        words = F.concat(
            F.when(objective, F.array(F.lit("objective_cue"))).otherwise(
                F.array().cast("array<string>")),
            emotion, sarcasm,
        )
        hit = (objective & (F.size(emotion) > 0)) | (F.size(sarcasm) > 0)
        return F.when(hit, longest_first(F.array_distinct(words))).otherwise(
            F.array().cast("array<string>"))

    def any_hit(self, text: Column) -> Column:
        """True when some bucket has a hit; stops at the first match of each pattern."""
        words = [w for b in BUCKETS[:3] for w in getattr(self, b)] + list(self.sarcasm)
        return text.rlike(alternation(words)) | (
            text.rlike(alternation(self.objective)) & text.rlike(alternation(self.emotion)))

    def add_hits(self, df: DataFrame, content: str = "content") -> DataFrame:
        """One ``_hits_<bucket>`` array per bucket; each pattern runs once per text."""
        text = F.col(content)
        scanned = df.withColumns({
            **{f"_hits_{b}": distinct_hits(text, getattr(self, b)) for b in BUCKETS[:3]},
            "_emotion": distinct_hits(text, self.emotion),
            "_sarcasm": distinct_hits(text, self.sarcasm),
            "_objective": text.rlike(alternation(self.objective))})
        hard = self._hard(F.col("_objective"), F.col("_emotion"), F.col("_sarcasm"))
        return scanned.withColumn("_hits_hard_negative", hard).drop(
            "_emotion", "_sarcasm", "_objective")
