"""TXT-* and DQ-01..14/18: text functions and dataset quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import VIEWS, query
from checks.views import growth, iso, label, ratio, rnd
from tidemark.functions import labels as lb
from tidemark.functions import numeric as nu
from tidemark.functions import text as tx
from tidemark.operators import quality as q
from tidemark.functions import phrases as ph
from tidemark.functions import variants as vr
from tidemark.plans.curation import prepare_splits
from tidemark.session import scratch_path
from tidemark.schema import LABEL_ALIASES, LABELS, LABELS_EN

EN = "[" + ", ".join(f"'{x}'" for x in LABELS_EN) + "]"
VIEWS["v_raw"] = f"""select n.id, n.content, case when l.doc_id is null then null
  when n.id % 17 = 0 then 'joy' else {EN}[cast(n.label_id as int) + 1] end "label", n.split
  from v_text_noisy n left join labels l on l.doc_id = n.id"""
VIEWS["v_raw_known"] = """select * from v_raw where "label" <> 'joy'"""


def raw(run):
    marks = run.tables.labels.select(F.col("doc_id").alias("_id"))
    noisy = run.tables.text_noisy
    names = F.array(*[F.lit(x) for x in LABELS_EN])
    label = F.when(F.col("_id").isNull(), None).when(F.col("id") % 17 == 0, "joy").otherwise(
        F.element_at(names, (F.col("label_id") + 1).cast("int")))
    return noisy.join(marks, noisy["id"] == F.col("_id"), "left").select(
        "id", "content", label.alias("label"), "split")


def rx(col: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({col}, '{pattern}', '{to}', 'g')"


def squeeze(col: str, n: int | None) -> str:
    out = f"trim({rx(col, tx.SPACES, ' ')})"
    return out if n is None else f"substr({out}, 1, {n})"


def clean_sql(col: str, n: int | None = None) -> str:
    out = f"lower({col})"
    for pattern, to in ((tx.URL, ""), (tx.REPOST, ""), (tx.MENTION, ""), (tx.HASHTAG, r"\1")):
        out = rx(out, pattern, to)
    return squeeze(out, n)


def legacy_sql(col: str, n: int | None = None) -> str:
    out = f"lower({col})"
    for pattern in (tx.LEGACY_URL, tx.EMAIL, tx.MENTION):
        out = rx(out, pattern)
    return squeeze(out, n)


VIEWS["v_clean"] = f"""select id, {clean_sql('content')} "content", label_id, split
  from v_text_noisy"""
NOISY = "v_text_noisy"


def text_query(name: str, column, sql: str, source: str = NOISY, out: str = "result",
               key: str = "id") -> None:
    """One column computed from the content of every noisy text."""
    table = {"v_text_noisy": "text_noisy", "v_text": "text"}[source]

    def fn(run):
        return getattr(run.tables, table).select(key, column(F.col("content")).alias(out))
    query(name, f"select {key}, {sql} {out} from {source}")(fn)


text_query("txt_01", tx.clean_text, clean_sql("content"))
text_query("txt_01_whole", lambda c: tx.clean_text(c, None), clean_sql("content", None))
text_query("txt_02", tx.nfkc, "content")
text_query("txt_03", tx.to_simplified,
           f"translate(content, '{tx.TRADITIONAL}', '{tx.SIMPLIFIED}')")
text_query("txt_04", F.lower, "lower(content)")
text_query("txt_05", tx.drop_urls, rx("content", tx.URL))
text_query("txt_06", tx.drop_reposts, rx("content", tx.REPOST))
text_query("txt_07", tx.drop_mentions, rx("content", tx.MENTION))
text_query("txt_08", tx.unwrap_hashtags, rx("content", tx.HASHTAG, r"\1"))
text_query("txt_09", lambda c: tx.squeeze(c, 512), squeeze("content", 512))
text_query("txt_10", tx.clean_text_legacy, legacy_sql("content"))
text_query("txt_10_whole", lambda c: tx.clean_text_legacy(c, None), legacy_sql("content", None))
text_query("txt_11", tx.near_dedupe_key, rx("content", tx.NON_WORD))
text_query("txt_17", tx.content_hash, "substr(sha256(content), 1, 16)")
text_query("txt_25", lambda c: tx.shorten(c, 80), """case when length(trim(content)) <= 80 then
  trim(content) else rtrim(substr(trim(content), 1, 80)) || '...' end""")


@query("txt_15", "select id, " + ", ".join(
    f"regexp_matches(content, '{p}') \"{n}\"" for n, p in tx.FEATURES.items())
    + " from v_text_noisy")
def txt_15(run):
    return run.tables.text_noisy.select("id", *[
        f.alias(n) for n, f in tx.feature_flags(F.col("content")).items()])


@query("txt_16", "select id, length(content) n from v_text where length(content) between 4 and 512")
def txt_16(run):
    return run.tables.text.filter(tx.in_length_band(F.col("content"))).select(
        "id", F.length("content").alias("n"))


# stand-in words that occur in the documents
WORDS = tx.KeywordLists(
    fear=("free", "license", "licen"), surprise=("###", "$", "##"),
    anger_sad_boundary=("blest", "blester", "tion"), objective=("erst", "the "),
    emotion=("heit", "keit", "que", "wh", "une"), sarcasm=("***", "%%%", "oi o"))


def hits_sql(words, text: str = "content") -> str:
    pattern = tx.alternation(words).replace("'", "''")
    found = f"list_distinct(regexp_extract_all({text}, '{pattern}'))"
    return sorted_sql(found)


def sorted_sql(found: str) -> str:
    return (f"list_transform(list_reverse_sort(list_transform({found}, "
            "lambda w: {'n': length(w), 'w': w})), lambda s: s.w)")


HARD = f"""case when (len(emo) > 0 and obj) or len(sar) > 0 then {sorted_sql(
    "list_distinct(list_concat(case when obj then ['objective_cue'] else [] end,"
    " list_concat(emo, sar)))")} else [] end"""
OBJECTIVE = tx.alternation(WORDS.objective)
VIEWS["v_hits0"] = f"""select id, content, label_id, split, {hits_sql(WORDS.fear)} h_fear,
  {hits_sql(WORDS.surprise)} h_surprise, {hits_sql(WORDS.anger_sad_boundary)} h_anger,
  {hits_sql(WORDS.emotion)} emo, {hits_sql(WORDS.sarcasm)} sar,
  regexp_matches(content, '{OBJECTIVE}') obj from v_text"""
VIEWS["v_hits"] = f"select *, {HARD} h_hard from v_hits0"


def listed(name: str, col: str) -> str:
    return f"case when len({col}) > 0 then '{name}:' || array_to_string({col}, '|') end"


VIEWS["v_bucket"] = f"""select id, content, label_id, split, concat_ws(',',
  case when len(h_fear) > 0 then 'fear' end, case when len(h_surprise) > 0 then 'surprise' end,
  case when len(h_anger) > 0 then 'anger_sad_boundary' end,
  case when len(h_hard) > 0 then 'hard_negative' end) target_buckets,
  case when len(h_fear) > 0 then 'fear' when len(h_surprise) > 0 then 'surprise'
  when len(h_anger) > 0 then 'anger_sad_boundary' else 'hard_negative' end target_bucket,
  concat_ws(';', {listed('fear', 'h_fear')}, {listed('surprise', 'h_surprise')},
  {listed('anger_sad_boundary', 'h_anger')}, {listed('hard_negative', 'h_hard')})
  matched_keywords, len(h_fear) + len(h_surprise) + len(h_anger) + len(h_hard) keyword_count
  from v_hits where len(h_fear) + len(h_surprise) + len(h_anger) + len(h_hard) > 0"""


@query("txt_12", """select id, array_to_string(h_fear, '|') fear, array_to_string(h_surprise, '|')
  surprise, array_to_string(h_anger, '|') anger_sad_boundary from v_hits""")
def txt_12(run):
    hits = WORDS.bucket_hits(F.col("content"))
    return run.tables.text.select("id", *[
        F.array_join(hits[b], "|").alias(b) for b in ("fear", "surprise", "anger_sad_boundary")])


@query("txt_13", "select id, array_to_string(h_hard, '|') hard_negative from v_hits")
def txt_13(run):
    return run.tables.text.select("id", F.array_join(
        WORDS.hard_negative_hits(F.col("content")), "|").alias("hard_negative"))


@query("txt_14", """select id, target_buckets, target_bucket, matched_keywords,
  cast(keyword_count as int) keyword_count from v_bucket""")
def txt_14(run):
    from tidemark.operators.mining import add_buckets
    return add_buckets(run.tables.text, WORDS).select(
        "id", "target_buckets", "target_bucket", "matched_keywords", "keyword_count")


@query("txt_18", """select topic_id from v_topic where contains(lower(title), 'ring')
  or contains(lower(lead), 'ring')""")
def txt_18(run):
    return run.tables.topic.filter(tx.contains_ignore_case(
        " RING ", F.col("title"), F.col("lead"))).select("topic_id")


@query("txt_19", f"""select id, {label('label_id')} label_name, label_id round_trip,
  coalesce(list_position({EN}, "label") - 1, -1)
  english_id from (select t.id, t.label_id, r."label" from v_text t join v_raw r on r.id = t.id)""")
def txt_19(run):
    both = raw(run).select("id", "label").join(run.tables.text.select("id", "label_id"), "id")
    name = lb.label_name(F.col("label_id"))
    return both.select("id", name.alias("label_name"), lb.label_id(name).alias("round_trip"),
                       F.coalesce(lb.english_label_id(F.col("label")).cast("int"), F.lit(-1))
                       .alias("english_id"))


ALIASES = [*LABEL_ALIASES, *LABELS, "喜怒", "", " 开心 "]
ALIAS_SQL = "[" + ", ".join(f"'{x}'" for x in ALIASES) + "]"
KNOWN_SQL = "map {" + ", ".join(
    f"'{k}': '{v}'" for k, v in {**{x: x for x in LABELS}, **LABEL_ALIASES}.items()) + "}"


@query("txt_20", f"""select id, raw, case when trim(raw) = '' then '' else
  {KNOWN_SQL}[trim(raw)] end "label" from (select id, {ALIAS_SQL}[cast(id % {len(ALIASES)} as int)
  + 1] raw from v_text)""")
def txt_20(run):
    words = F.array(*[F.lit(x) for x in ALIASES])
    raw_label = F.element_at(words, (F.col("id") % len(ALIASES) + 1).cast("int"))
    return run.tables.text.select("id", raw_label.alias("raw")).withColumn(
        "label", lb.normalize_label(F.col("raw")))


REPLY_SQL = """case event_id % 4 when 0 then props when 1 then '```json' || chr(10) || props
  || chr(10) || '```' when 2 then 'Answer: ' || props || ' done.' else 'no answer' end"""


def replies(run):
    kind = F.col("event_id") % 4
    fence = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    text = F.when(kind == 0, F.col("props")).when(kind == 1, fence).when(
        kind == 2, F.concat(F.lit("Answer: "), F.col("props"), F.lit(" done."))
    ).otherwise("no answer")
    return run.tables.events.select("event_id", "value", "event_type", text.alias("reply"))


@query("txt_21", f"""select event_id, case when event_id % 4 < 3 then
  json_extract_string(props, '$.k') end k from events""")
def txt_21(run):
    found = tx.reply_json(F.col("reply"))
    return replies(run).select("event_id", F.get_json_object(found, "$.k").alias("k"))


@query("txt_22", f"""select event_id, "label", case when second_raw = "label" then '' else second_raw end
  second_label, confidence, coalesce(case when flag is null then confidence < 0.75
  else lower(trim(flag)) in ('1', 'true', 'yes', 'y', '是', '需要') end, false)
  needs_human_review, case when "label" is null then 'label'
  when not (confidence between 0 and 1) then 'confidence' end error from (
  select event_id, {ALIAS_SQL}[cast(event_id % {len(ALIASES)} as int) + 1] raw,
  {KNOWN_SQL}[trim({ALIAS_SQL}[cast(event_id % {len(ALIASES)} as int) + 1])] "label",
  coalesce({KNOWN_SQL}[trim({ALIAS_SQL}[cast(user_id % {len(ALIASES)} as int) + 1])], '') second_raw,
  value / 50.0::double confidence, case event_id % 5 when 0 then 'Yes' when 1 then 'no'
  when 2 then ' TRUE ' else null end flag from events)""")
def txt_22(run):
    from tidemark.operators.annotation import validate_payload
    words = F.array(*[F.lit(x) for x in ALIASES])
    kind = F.col("event_id") % 5
    replies = run.tables.events.select(
        "event_id",
        F.element_at(words, (F.col("event_id") % len(ALIASES) + 1).cast("int")).alias("label"),
        F.element_at(words, (F.col("user_id") % len(ALIASES) + 1).cast("int"))
        .alias("second_label"),
        (F.col("value") / 50.0).alias("confidence"),
        F.when(kind == 0, "Yes").when(kind == 1, "no").when(kind == 2, " TRUE ")
        .alias("needs_human_review"), F.lit("").alias("reason"))
    return validate_payload(replies).select(
        "event_id", "label", "second_label", "confidence", "needs_human_review", "error")


@query("txt_23", """select topic_id, lower(trim(regexp_replace('## ' || title || '#', '^#+|#+$',
  '', 'g'))) title_key from v_topic""")
def txt_23(run):
    title = F.concat(F.lit("## "), F.col("title"), F.lit("#"))
    return run.tables.topic.select("topic_id", tx.topic_title_key(title).alias("title_key"))


@query("txt_23_id", """select topic_id, k title_key, ('0x' || substr(sha256(k), 1, 15))::bigint title_id
  from (select topic_id, lower(trim(regexp_replace('## ' || title || '#', '^#+|#+$', '', 'g'))) k
  from v_topic)""")
def txt_23_id(run):
    title = F.concat(F.lit("## "), F.col("title"), F.lit("#"))
    return run.tables.topic.select("topic_id", tx.topic_title_key(title).alias("title_key"),
                                   tx.topic_title_id(title).alias("title_id"))


@query("txt_24_paths", """select event_id, cast(json_extract_string(props, '$.k') as bigint) k,
  case when event_id % 3 = 0 then user_id::varchar when event_id % 3 = 1 then event_type end who,
  case event_id % 3 when 0 then 'number' when 1 then 'string' else 'null' end kind,
  list_count([event_id, user_id]) places, user_id other, 'n' || event_id deep from events""")
def txt_24_paths(run):
    """Six paths of one parsed document; ``who`` is a number, a string or missing."""
    who = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(', "who": '), F.col("user_id"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit(', "who": "'), F.col("event_type"), F.lit('"'))
    ).otherwise(F.lit(""))
    raw_json = F.concat(F.rtrim(F.col("props"), F.lit("}")), who, F.lit(', "at": ['), F.col("event_id"),
                        F.lit(", "), F.col("user_id"), F.lit('], "o": {"p": {"q": "n'),
                        F.col("event_id"), F.lit('"}}}'))
    events = run.tables.events.select("event_id", raw_json.alias("raw_json"))
    parsed = vr.add_paths(events, "raw_json", {
        "k": ("$.k", "bigint"), "who": ("$.who", "string"), "other": ("$.at[1]", "bigint"),
        "deep": ("$.o.p.q", "string")}, kinds={"kind": "$.who"}, sizes={"places": "$.at"})
    return parsed.drop("raw_json")


@query("txt_03_phrases", "select id, regexp_replace(content, 'th([a-z])|([a-z])([a-z])|"
       "([0-9])([0-9])([0-9])', '\\1\\3\\2\\6\\5\\4', 'g') \"out\" from v_text_noisy")
def txt_03_phrases(run):
    """A dictionary of 1702 phrases: 'th' and a letter lose 'th', two letters change places, three
    digits are turned round; longer phrases win."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    table = {a + b: b + a for a in letters for b in letters} | {
        f"th{a}": a for a in letters} | {f"{n:03d}": f"{n:03d}"[::-1] for n in range(1000)}
    path = scratch_path(run.spark, "phrases")
    rows = [(f"{k}\t{v} other",) for k, v in table.items()]
    run.spark.createDataFrame(rows, "value string").write.text(path)
    phrases = ph.read_phrases(run.spark, path)
    return run.tables.text_noisy.select("id", ph.convert(F.col("content"), phrases).alias("out"))


@query("txt_24", "select event_id, cast(json_extract_string(props, '$.k') as bigint) k from events")
def txt_24(run):
    return run.tables.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def number_query(name: str, source: str, key: str, cols: dict) -> None:
    """Columns computed from one table: {name: (Column function, SQL)}."""
    table = source.removeprefix("v_")

    def fn(run):
        return getattr(run.tables, table).select(key, *[c().alias(n) for n, (c, _) in cols.items()])
    query(name, f"select {key}, " + ", ".join(f"{s} {n}" for n, (_, s) in cols.items())
          + f" from {source}")(fn)


VALUE = "(value - 20.0::double) / 7.0::double"
number_query("txt_26", "events", "event_id", {"growth": (
    lambda: nu.growth_label((F.col("value") - 20.0) / 7.0), growth(VALUE))})
number_query("txt_29", "v_user", "uid", {"bucket": (
    lambda: nu.followers_bucket(F.col("followers_count"), F.col("profile_tier")),
    """case when profile_tier < 1 or followers_count <= 0 then '未覆盖' when followers_count
    < 10000 then '<1w' when followers_count < 100000 then '1w-10w' when followers_count
    < 1000000 then '10w-100w' else '100w+' end""")})
number_query("txt_30", "events", "event_id", {"level": (
    lambda: nu.risk_level(F.col("value")), """case when value >= 80 then 'high'
    when value >= 60 then 'medium_high' when value >= 40 then 'medium' else 'low' end""")})
number_query("txt_31", "events", "event_id", {"r": (
    lambda: nu.round_to(nu.ratio(F.col("value"), F.col("user_id")), 6),
    rnd(ratio("value", "user_id"), 6))})
number_query("txt_32", "events", "event_id", {"r": (
    lambda: nu.round_to(nu.clip_norm(F.col("value") - 20.0, F.lit(55.0)), 6),
    rnd("least(greatest(value - 20.0::double, 0.0) / greatest(55.0::double, 1e-9), 1.0)", 6))})
number_query("txt_33", "events", "event_id", {"r": (
    lambda: nu.round_to(nu.log_norm(F.col("user_id") - 5, F.lit(120)), 6),
    rnd("""case when user_id - 5 > 0 then least(ln(1 + (user_id - 5)::double)
    / ln(1 + 120.0::double), 1.0) else 0.0 end""", 6))})
TEXTUAL = "case event_id % 4 when 0 then 'NaN' when 1 then value::varchar when 2 then 'x' end"
number_query("txt_34", "events", "event_id", {
    "f": (lambda: nu.to_number(F.when(F.col("event_id") % 4 == 0, "NaN").when(
        F.col("event_id") % 4 == 1, F.col("value").cast("string")).when(
        F.col("event_id") % 4 == 2, "x"), -1.0),
        "case when event_id % 4 = 1 then value else -1.0::double end"),
    "i": (lambda: nu.to_whole(F.when(F.col("event_id") % 4 == 1, F.col("value").cast("string"))),
          "case when event_id % 4 = 1 then trunc(value)::bigint else 0 end")})
number_query("txt_35", "events", "event_id", {"r": (
    lambda: nu.round_to(F.col("value") / 3.0, 4), rnd("value / 3.0::double", 4))})
number_query("txt_36", "events", "event_id", {"t": (
    lambda: nu.local_iso(F.col("ts")), iso("ts"))})
number_query("txt_37", "events", "event_id", {"d": (
    lambda: nu.local_day(F.col("ts")).cast("string"),
    "cast(cast(ts + interval 8 hours as date) as varchar)")})
number_query("txt_38", "v_user", "uid", {"shown": (
    lambda: nu.compact_count(F.col("followers_count") * 1000),
    f"""case when followers_count * 1000 >= 100000000 then
    printf('%.1f', {rnd('followers_count * 1000 / 1e8', 1)}) || '亿'
    when followers_count * 1000 >= 10000 then
    printf('%.1f', {rnd('followers_count * 1000 / 1e4', 1)}) || '万'
    else (followers_count * 1000)::varchar end""")})


@query("txt_27", """select id, printf('business-targeted-%07d', row_number() over (
  order by sha256(content), id)) sample_id from v_text""")
def txt_27(run):
    from tidemark.operators.ranking import number_rows
    hashed = run.tables.text.select("id", F.sha2("content", 256).alias("h"))
    return number_rows(hashed, [F.asc("h"), F.asc("id")], "n").select(
        "id", F.format_string("business-targeted-%07d", "n").alias("sample_id"))


@query("txt_28", """select id, 'bucket=' || target_bucket || ';flags=' || concat_ws(',',
  case when keyword_count > 3 then 'many' end, case when label_id in (1, 3) then 'anger_fear' end)
  || ';keywords=' || matched_keywords candidate_reason from v_bucket""")
def txt_28(run):
    from tidemark.operators.mining import add_buckets, reason_text
    found = add_buckets(run.tables.text, WORDS)
    flags = F.concat_ws(",", F.when(F.col("keyword_count") > 3, "many"),
                        F.when(F.col("label_id").isin(1, 3), "anger_fear"))
    return found.select("id", reason_text(
        bucket=F.col("target_bucket"), flags=flags, keywords=F.col("matched_keywords"),
    ).alias("candidate_reason"))


# ------------------------------------------------------------------------ quality
@query("dq_01", f"""select id, {clean_sql('content')} "content", list_position({EN}, "label") - 1
  label_id from v_raw_known where "label" is not null and length({clean_sql('content')}) > 0""")
def dq_01(run):
    return q.clean_frame(raw(run), unknown="drop").select(
        "id", "content", F.col("label_id").cast("int").alias("label_id"))


@query("dq_02", """select count(*) conflicting_contents, cast(coalesce(sum(n), 0) as bigint)
  affected_rows from (select content, count(*) n from v_text group by 1
  having count(distinct label_id) > 1)""")
def dq_02(run):
    return q.label_conflicts(run.tables.text)


@query("dq_03", """select id, label_id from (select *, row_number() over (partition by content
  order by id) rn from v_text) where rn = 1""")
def dq_03(run):
    return q.dedupe_content(run.tables.text).select("id", "label_id")


VIEWS["v_split_first"] = """select * exclude (rn) from (select *, row_number() over (
  partition by split, content order by id) rn from v_text) where rn = 1"""
VIEWS["v_no_leak"] = """select * from v_split_first where split <> 'train' or content not in (
  select content from v_split_first where split in ('eval', 'test'))"""


@query("dq_04", "select id, split, label_id from v_no_leak")
def dq_04(run):
    first = q.dedupe_content(run.tables.text, "id", ("split",))
    return q.remove_leakage(first).select("id", "split", "label_id")


@query("dq_05", """select id from (select *, row_number() over (partition by content order by id)
  rn from v_text) where rn = 1 and content not in (select text from benchmark)
  and content not in (select text from conversations where text is not null)
  and content not in (select content from v_text where split = 'test')""")
def dq_05(run):
    from tidemark.operators.dedupe import exclude_contents
    t = run.tables
    others = [t.benchmark.select(F.col("text").alias("content")),
              t.conversations.select(F.col("text").alias("content")),
              t.text.filter("split = 'test'").select("content")]
    return exclude_contents(q.dedupe_content(t.text), *others).select("id")


NEAR = rx("content", tx.NON_WORD)


@query("dq_06", f"""select id from (select id, row_number() over (partition by {NEAR} order by id)
  rn from v_text) where rn = 1""")
def dq_06(run):
    from tidemark.operators.dedupe import keep_first
    keyed = run.tables.text.select("id", tx.near_dedupe_key(F.col("content")).alias("k"))
    return keep_first(keyed, ["k"], ["id"]).select("id")


@query("dq_07", """select split, count(*) "rows", count(*) filter (where "label" is null)
  none_label, count(*) filter (where "label" is not null and length(content) = 0) empty_content,
  cast(min(length(content)) filter (where "label" is not null) as int) len_min,
  cast(floor(quantile_cont(length(content), 0.5) filter (where "label" is not null)) as bigint)
  len_p50, cast(floor(quantile_cont(length(content), 0.95) filter (where "label" is not null))
  as bigint) len_p95, cast(max(length(content)) filter (where "label" is not null) as int) len_max
  from v_raw group by 1""")
def dq_07(run):
    return q.overview(raw(run)).withColumns({
        "rows": F.col("rows"), "len_min": F.col("len_min"), "len_max": F.col("len_max")})


@query("dq_08", "select split, " + ", ".join(
    f"count(*) filter (where \"label\" = '{x}') n_{x}, " + rnd(ratio(
        f"count(*) filter (where \"label\" = '{x}')", "count(*)")) + f" pct_{x}"
    for x in LABELS_EN) + ', count(*) total from v_raw where "label" is not null group by 1')
def dq_08(run):
    return q.label_distribution(raw(run))


@query("dq_09", """select split, "label", count(*) n from v_raw where "label" = 'joy'
  group by 1, 2""")
def dq_09(run):
    return q.unknown_labels(raw(run))


VALID = """(select * from v_raw where "label" is not null and length(content) > 0)"""
VIEWS["v_valid"] = """select t.id, t.content, r."label", t.split from v_text t join v_raw r
  on r.id = t.id where r."label" is not null and length(t.content) > 0"""


def labelled_text(run):
    return raw(run).select("id", "label").join(
        run.tables.text.select("id", "content", "split"), "id")


@query("dq_10", f"""select split, count(*) "valid", count(distinct content) unique_texts,
  count(*) - count(distinct content) dup_rows,
  {rnd(ratio('(count(*) - count(distinct content))', 'count(*)') + ' * 100', 2)} dup_pct
  from v_valid group by 1""")
def dq_10(run):
    return q.duplicate_table(labelled_text(run))


@query("dq_11", " union all ".join(f"""select '{s}' other, count(*) filter (where content in (
  select content from v_valid where split = 'train')) overlap,
  {rnd(ratio("count(*) filter (where content in (select content from v_valid where split = 'train'))", 'count(*)') + ' * 100', 2)} pct
  from (select distinct content from v_valid where split = '{s}')""" for s in ("eval", "test")))
def dq_11(run):
    return q.overlap_table(labelled_text(run))


@query("dq_12", 'select split, count(*) "valid", ' + ", ".join(
    f"count(*) filter (where regexp_matches(content, '{p}')) n_{n}, " + rnd(ratio(
        f"count(*) filter (where regexp_matches(content, '{p}'))", "count(*)") + " * 100", 2)
    + f" pct_{n}" for n, p in tx.FEATURES.items()) + f" from {VALID} group by 1")
def dq_12(run):
    return q.feature_table(raw(run))


@query("dq_13", """select split, id, "label", cast(len as int) len, cast(n as int) n, long_rows
  from (select *, row_number() over (partition by split order by len desc, id) n,
  count(*) over (partition by split) long_rows from (select split, id, "label", length(content)
  len from v_valid where length(content) > 500)) where n <= 2""")
def dq_13(run):
    return q.long_texts(labelled_text(run))


@query("dq_13_empty", """select split, id, "label", cast(n as int) n, empty_rows from (
  select *, row_number() over (partition by split order by id) n, count(*) over (
  partition by split) empty_rows from (select split, id, "label" from v_raw
  where id % 10 in (3, 7, 8) and id % 20 <> 3)) where n <= 3""")
def dq_13_empty(run):
    # some texts blanked, so that every split has rows without text
    blank = F.col("id") % 10
    hole = blank.isin(3, 7, 8) & (F.col("id") % 20 != 3)
    return q.empty_texts(raw(run).withColumn(
        "content", F.when(hole, F.lit("")).otherwise(F.col("content"))))


@query("dq_14", """select split, count(*) "rows", cast(min(n) as int) len_min,
  cast(floor(quantile_cont(n, 0.5)) as bigint) len_p50,
  cast(floor(quantile_cont(n, 0.9)) as bigint) len_p90,
  cast(floor(quantile_cont(n, 0.95)) as bigint) len_p95,
  cast(floor(quantile_cont(n, 0.99)) as bigint) len_p99, cast(max(n) as int) len_max, """
       + ", ".join(rnd(ratio(f"count(*) filter (where n > {t})", "count(*)") + " * 100", 2)
                   + f" over_{t}" for t in (128, 192, 256))
       + " from (select split, length(content) n from v_clean) group by 1")
def dq_14(run):
    cleaned = run.tables.text_noisy.withColumn("content", tx.clean_text(F.col("content")))
    return q.length_profile(cleaned)


VIEWS["v_cleaned_raw"] = f"""select id, {clean_sql('content')} "content", "label", split
  from v_raw_known where "label" is not null and length({clean_sql('content')}) > 0"""


@query("dq_18", """select r.split, r.n raw, c.n after_clean, r.n - c.n dropped,
  c.n - c.u duplicates, case when r.split = 'train' then (select count(*) from (
  select distinct content from v_cleaned_raw where split = 'train') where content in (
  select content from v_cleaned_raw where split <> 'train')) else 0 end leaked,
  c.u - case when r.split = 'train' then (select count(*) from (select distinct content
  from v_cleaned_raw where split = 'train') where content in (select content
  from v_cleaned_raw where split <> 'train')) else 0 end kept
  from (select split, count(*) n from v_raw group by 1) r join (
  select split, count(*) n, count(distinct content) u from v_cleaned_raw group by 1) c
  on c.split = r.split""")
def dq_18(run):
    rows = raw(run)
    return q.split_accounting(rows, q.clean_frame(rows, unknown="drop"))


@query("dq_18_splits", """select id, split from (select *, row_number() over (
  partition by split, content order by id) rn from v_cleaned_raw) where rn = 1 and (
  split <> 'train' or content not in (select content from v_cleaned_raw
  where split <> 'train'))""")
def dq_18_splits(run):
    return prepare_splits(raw(run), unknown="drop").select("id", "split")
