"""SRC-*, CX-*, STR-*: sources and sinks, conversation context, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import ORACLES, SETTINGS, VIEWS, query
from checks.selection import letter_scorer, probs_sql
from checks.text import clean_sql
from checks.topics import busiest
from checks.views import LABEL_LIST, big, iso, ratio, rnd
from tidemark.functions.numeric import local_iso, round_to
from tidemark.functions.text import clean_text
from tidemark.functions.variants import stringify_json
from tidemark.operators import context as cx
from tidemark.operators import kpi
from tidemark.plans.context import overview_context, topic_context, topic_detail
from tidemark.session import scratch_path
from tidemark.sources import io
from tidemark.sources import tables as sources_tables
from tidemark.streaming import state as ss
from tidemark.streaming import streams as st

# ------------------------------------------------------------------------- sources
@query("src_01", "select id, content, cast(label_id as varchar) \"label\" from v_text")
def src_01(run):
    path = scratch_path(run.spark, "raw")
    rows = run.tables.text.select("id", "content", F.col("label_id").cast("string").alias("label"))
    arrays = F.to_json(F.array(F.struct("id", "content", "label")))
    rows.select(arrays.alias("value")).write.text(path)
    return io.read_raw(run.spark, path, multi_line=False)


@query("src_02", "select id, content, label_id from v_text")
def src_02(run):
    root = scratch_path(run.spark, "mixed")
    text = run.tables.text.select("id", "content", "label_id", "split")
    text.filter("split = 'train'").write.parquet(f"{root}/train.parquet")
    io.write_csv(text.filter("split = 'eval'"), f"{root}/eval.csv")
    io.write_jsonl(text.filter("split = 'test'"), f"{root}/test.jsonl")
    return io.read_table(run.spark, [f"{root}/train.parquet", f"{root}/eval.csv",
                                     f"{root}/test.jsonl"],
                         "id bigint, content string, label_id bigint, split string").drop("split")


@query("src_04", "select id, content, lang from v_text")
def src_04(run):
    return io.keep_optional(run.tables.text, ["id", "content"], ["lang", "region_name", "id"])


@query("src_05", f"""select post_id, text_raw, {iso('created_at')} created_at from v_post
  where created_at >= timestamp '1998-01-01' and text_raw <> ''""")
def src_05(run):
    path = scratch_path(run.spark, "export")
    rows = io.export_business(run.tables.post, ["post_id"], "1998-01-01 00:00:00")
    rows.write.parquet(path)
    return run.spark.read.parquet(path).select(
        "post_id", "text_raw", local_iso(F.col("created_at")).alias("created_at"))


def exported(run):
    t = run.tables
    frames = {"post": t.post, "comment": t.comment, "engagement": t.engagement, "user": t.user}
    times = {"post": "created_at", "comment": "created_at", "engagement": "captured_at"}
    root = scratch_path(run.spark, "tables")
    return io.export_tables(frames, times, "1998-01-01 00:00:00", root), root


SINCE = "timestamp '1998-01-01'"
MANIFEST = f"""select 'post' "table", count(*) n_rows from v_post where created_at >= {SINCE}
  union all select 'comment', count(*) from v_comment where created_at >= {SINCE}
  union all select 'engagement', count(*) from v_engagement where captured_at >= {SINCE}
  union all select 'user', count(*) from v_user"""


@query("src_06", MANIFEST)
def src_06(run):
    return exported(run)[0]


@query("src_07", f"""select "table", m.n_rows expected, l.n actual, case when m.n_rows = l.n then
  'OK' else 'WARN' end status from ({MANIFEST}) m join (select 'post' "table", count(*) n
  from v_post union all select 'comment', count(*) from v_comment union all
  select 'engagement', count(*) from v_engagement union all select 'user', count(*) from v_user) l
  using ("table")""")
def src_07(run):
    t = run.tables
    loaded = io.row_counts({"post": t.post, "comment": t.comment, "engagement": t.engagement,
                            "user": t.user})
    return io.reconcile_counts(exported(run)[0], loaded)


@query("src_08", "select id, content, label_id, split from v_text")
def src_08(run):
    path = scratch_path(run.spark, "splits")
    io.write_split(run.tables.text.withColumn("track", F.lit("usual")), path)
    return run.spark.read.parquet(path).filter("track = 'usual'").select(
        "id", "content", "label_id", "split")


@query("src_09", "select id, content from v_text union all select id, content from v_text")
def src_09(run):
    root = scratch_path(run.spark, "reports")
    rows = run.tables.text.select("id", "content")
    io.write_jsonl(rows, f"{root}/r.jsonl")
    io.write_csv(rows, f"{root}/r.csv")
    return io.read_table(run.spark, [f"{root}/r.jsonl", f"{root}/r.csv"],
                         "id bigint, content string")


@query("src_10", "select id::varchar id, content, label_id::varchar label_id from v_text")
def src_10(run):
    return io.stringify(run.tables.text, ["id", "label_id"]).select("id", "content", "label_id")


@query("src_11", """select comment_id, post_id from v_comment where comment_id > 5000
  order by comment_id limit 500""")
def src_11(run):
    return io.pull_page(run.tables.comment, "comment_id", 5000, 500).select(
        "comment_id", "post_id")


@query("src_03", "select id, content, label_id from v_text")
def src_03(run):
    text = io.require_columns(run.tables.text, ["id", "content", "split"])
    return io.keep_optional(text, ["id", "content"], ["label_id", "annotator", "id"])


@query("src_10_mixed", """select id, label_id::varchar "label", case when id % 3 = 0 then null
  else (id % 2 = 0)::varchar end flag from v_text""")
def src_10_mixed(run):
    """Records whose fields are numbers in some rows and strings in others."""
    label = F.col("label_id").cast("string")
    quoted = F.when(F.col("id") % 2 == 0, label).otherwise(F.concat(F.lit('"'), label, F.lit('"')))
    flag = F.when(F.col("id") % 3 == 0, "null").otherwise((F.col("id") % 2 == 0).cast("string"))
    record = F.concat(F.lit('{"label": '), quoted, F.lit(', "flag": '), flag, F.lit("}"))
    path = scratch_path(run.spark, "records")
    run.tables.text.select("id", record.alias("record")).write.parquet(path)
    return stringify_json(run.spark.read.parquet(path), "record", ["label", "flag"]).drop("record")


@query("src_11_keyset", """select comment_id, post_id from v_comment where comment_id > 5000""")
def src_11_keyset(run):
    path = scratch_path(run.spark, "comments")
    run.tables.comment.select("comment_id", "post_id").write.parquet(path)
    return io.read_keyset(run.spark, path, "comment_id", "comment_id long, post_id long", after=5000)


@query("src_11_stream", """select comment_id, post_id from v_comment""")
def src_11_stream(run):
    """The table is read up to a key, grows, and is read on with the same checkpoint."""
    source, path = scratch_path(run.spark, "comments"), scratch_path(run.spark, "pulled")
    rows = run.tables.comment.select("comment_id", "post_id")
    for part in ("comment_id <= 9000", "comment_id > 9000"):
        rows.filter(part).write.mode("append").parquet(source)
        pulled = io.read_keyset(run.spark, source, "comment_id", "comment_id long, post_id long", True)
        pulled.writeStream.format("parquet").option("path", path).option(
            "checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return run.spark.read.parquet(path)


@query("doc_10", """select source_type, source_id, strftime(source_created_at, '%Y-%m-%d') "day"
  from v_prediction where model_version = 'primary' and dayofweek(source_created_at) = 1
  and month(source_created_at) % 5 = 0""")
def doc_10(run):
    """Predictions of the Mondays of every fifth month, from month folders."""
    path = scratch_path(run.spark, "by-month")
    sources_tables.write_by_month(run.tables.prediction, path, "source_created_at")
    facts = run.spark.read.parquet(path).filter("model_version = 'primary'")
    dates = scratch_path(run.spark, "dates")
    run.tables.prediction.select(F.to_date("source_created_at").alias("day")).distinct().write.parquet(dates)
    wanted = run.spark.read.parquet(dates).filter("dayofweek(day) = 2 and month(day) % 5 = 0")
    return sources_tables.rows_of_dates(facts, wanted, "source_created_at").select(
        "source_type", "source_id", F.date_format("source_created_at", "yyyy-MM-dd").alias("day"))


@query("src_12", """select model_version, source_type, source_id, case when source_type = 'post'
  and model_version = 'primary' then (pred_label_id + 1) % 6 else pred_label_id end pred_label_id,
  case when source_type = 'post' and model_version = 'primary' then 2 else 1 end predicted_at
  from v_prediction""")
def src_12(run):
    path = scratch_path(run.spark, "predictions")
    first = run.tables.prediction.withColumn("predicted_at", F.lit(1))
    io.upsert_predictions(run.spark, path, first)
    again = run.tables.prediction.filter(
        "source_type = 'post' and model_version = 'primary'").withColumns({
            "pred_label_id": (F.col("pred_label_id") + 1) % 6, "predicted_at": F.lit(2)})
    io.upsert_predictions(run.spark, path, again)
    return run.spark.read.parquet(path).select(
        "model_version", "source_type", "source_id", "pred_label_id", "predicted_at")


RUN_NAME = """event_type || '-' || case when user_id % 2 = 0 then 'usual' else 'virus' end || '-'
  || strftime(ts, '%Y%m%d') || '-0000'"""


@query("src_13", f"""select name, model, track, timestamp_, epochs_run, best_epoch,
  case when lo = 0 then 'no train_args.json' when n < 30 then 'no final_test_report.json' end
  problem, case when n >= 30 then n / 200.0::double end test_loss,
  case when n >= 30 then n end test_samples, case when n >= 30 then n / 100.0::double end first_f1,
  case when n >= 30 then n end cell from (select {RUN_NAME} name, event_type model, case when user_id % 2 = 0 then 'usual'
  else 'virus' end track, strftime(ts, '%Y%m%d') || '-0000' timestamp_, count(*) n,
  min(event_id % 3) lo, count(*) epochs_run, arg_max(event_id, (value, -event_id)) best_epoch
  from events group by 1, 2, 3, 4)""")
def src_13(run):
    track = F.when(F.col("user_id") % 2 == 0, "usual").otherwise("virus")
    name = F.concat_ws("-", "event_type", track, F.date_format("ts", "yyyyMMdd"), F.lit("0000"))
    events = run.tables.events.withColumn("path", F.concat(F.lit("/runs/"), name, F.lit("/f.json")))
    folded = events.groupBy("path").agg(F.count("*").alias("n"),
                                        F.min(F.col("event_id") % 3).alias("lo"))
    args = folded.filter("lo <> 0").select("path", F.lit("base").alias("pretrained"))
    reports = folded.filter("n >= 30").select(
        "path", (F.col("n") / 100.0).alias("macro_f1"), (F.col("n") / 100.0).alias("accuracy"),
        (F.col("n") / 200.0).alias("loss"), F.col("n").alias("samples"),
        F.array((F.col("n") / 100.0)).alias("per_class_f1"),
        F.array(F.array("n")).alias("confusion_matrix"))
    history = events.select("path", F.col("event_id").alias("epoch"),
                            F.col("value").alias("macro_f1"), F.lit(1).alias("train_time_s"),
                            F.lit(1).alias("eval_time_s"))
    return io.join_runs(args, reports, history).select(
        "name", "model", "track", F.col("timestamp").alias("timestamp_"), "epochs_run",
        "best_epoch", "problem", "test_loss", "test_samples",
        F.col("per_class_f1")[0].alias("first_f1"), F.col("confusion_matrix")[0][0].alias("cell"))


@query("src_14", "select text \"content\" from documents union select text from conversations")
def src_14(run):
    root = scratch_path(run.spark, "contents")
    run.tables.documents.select("text").write.parquet(f"{root}/a.parquet")
    io.write_jsonl(run.tables.conversations.select(F.col("text").alias("content")),
                   f"{root}/b.jsonl")
    return io.read_contents(run.spark, [f"{root}/a.parquet", f"{root}/b.jsonl",
                                        f"{root}/absent.parquet", f"{root}/c.xlsx"])


# -------------------------------------------------------------------- conversations
@query("cx_01", """select conv_id, turn, role from (select *, row_number() over (
  partition by conv_id order by turn desc) n from conversations) where n <= 4""")
def cx_01(run):
    return cx.last_messages(run.tables.conversations, 4).select("conv_id", "turn", "role")


@query("cx_02", """select conv_id, turn from (select *, row_number() over (partition by conv_id
  order by turn desc) n from conversations) where n <= 200""")
def cx_02(run):
    return cx.last_messages(run.tables.conversations, cx.KEEP_MESSAGES).select("conv_id", "turn")


SAID = "timestamp '2024-01-01' + to_hours(cast(conv_id as bigint)) + to_minutes(cast(turn as bigint))"


def dated(run):
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id as int), "
                "cast(turn as int), 0)")
    return run.tables.conversations.withColumn("created_at", at)


@query("cx_03", f"""select conv_id, {iso('updated_at')} updated_at, message_count from (
  select conv_id, max({SAID}) updated_at, count(*) message_count from conversations group by 1)
  where updated_at >= (select max({SAID}) from conversations) - interval 7 days
  order by updated_at desc, conv_id""")
def cx_03(run):
    return cx.active_sessions(dated(run)).withColumn(
        "updated_at", local_iso(F.col("updated_at")))


def short(text: str, n: int) -> str:
    t = f"trim({text})"
    return (f"case when length({t}) <= {n} then {t} else rtrim(substr({t}, 1, {n})) || '...' end")


@query("cx_04", f"""select conv_id, count(*) message_count, coalesce(arg_min({short('text', 40)},
  turn) filter (where role = 'user'), '新对话') title, arg_max(role, turn) last_role
  from conversations group by 1""")
def cx_04(run):
    return cx.session_rollup(run.tables.conversations)


@query("cx_05", f"""select conv_id, turn, case when role in ('user', 'assistant') then role
  else 'assistant' end "role", {short('text', 500)} "content" from conversations""")
def cx_05(run):
    return cx.clip_messages(run.tables.conversations)


@query("cx_06", """with x as (select conv_id, turn, k, (turn * 3 + k) % 50 r from conversations,
  range(8) t(k)), y as (select conv_id, turn, string_agg(printf('ev_%06d', r), ',' order by k) refs
  from x where r in (select turn from conversations) group by 1, 2)
  select conv_id, turn, coalesce(refs, '') refs from conversations left join y
  using (conv_id, turn)""")
def cx_06(run):
    ref = lambda n: F.format_string("ev_%06d", n)
    messages = run.tables.conversations.select(
        F.concat_ws("/", "conv_id", "turn").alias("msg"), "conv_id", "turn")
    refs = F.array(*[ref((F.col("turn") * 3 + k) % 50) for k in range(12)])
    evidence = messages.select(ref(F.col("turn")).alias("sample_id"))
    found = cx.valid_refs(messages.select("msg", refs.alias("refs")), evidence, "msg")
    parts = F.split("msg", "/")
    return found.select(parts[0].cast("bigint").alias("conv_id"),
                        parts[1].cast("bigint").alias("turn"),
                        F.array_join("refs", ",").alias("refs"))


CAVEATS = "[" + ", ".join(f"'{x}'" for x in cx.DATA_CAVEATS) + "]"


@query("cx_07", f"""select conv_id, turn, array_to_string(list_concat(g[1:4], list_filter({CAVEATS},
  lambda x: not list_contains(g[1:4], x)))[1:6], '|') caveats from (select conv_id, turn,
  [role, 'c' || turn, {CAVEATS}[1], 'd', 'e'] g from conversations)""")
def cx_07(run):
    given = F.array(F.col("role"), F.concat(F.lit("c"), F.col("turn").cast("string")),
                    F.lit(cx.DATA_CAVEATS[0]), F.lit("d"), F.lit("e"))
    return run.tables.conversations.select(
        "conv_id", "turn", F.array_join(cx.merge_caveats(given), "|").alias("caveats"))


@query("cx_08")
def cx_08(run):
    """One JSON document; its parts are the checked rankings."""
    return overview_context(run.tables, run.window(), SETTINGS)


@query("cx_09")
def cx_09(run):
    return topic_context(run.tables, run.window(), busiest(run), SETTINGS)


@query("top_19")
def top_19(run):
    detail = topic_detail(run.tables, run.window(), busiest(run), SETTINGS)
    lists = ("timeline", "engagement_curve", "top_actors", "evidence_samples",
             "emotion_distribution", "source_counts")
    return detail.withColumns({x: F.to_json(x) for x in lists})


REQ = """case event_type when 'click' then 'actors' when 'view' then 'evidence'
  when 'purchase' then 'risk_topics' when 'signup' then 'overview' else 'shell' end"""


@query("cx_10", f"""with r as (select user_id, event_id, {REQ} name, event_id % 12 l from events),
  a as (select * from (select *, row_number() over (partition by user_id, name order by event_id) k
  from r where name <> 'shell') where k = 1),
  b as (select *, row_number() over (partition by user_id order by event_id) n from a)
  select user_id, cast(n as int) n, name, cast(least(greatest(l, 1), 8) as int) "limit" from b
  where n <= 3 union all select user_id, d.n, d.name, 5 from (select user_id from r group by 1
  having count(*) filter (where name <> 'shell') = 0) e,
  (values (1, 'risk_topics'), (2, 'actors'), (3, 'evidence')) d(n, name)""")
def cx_10(run):
    requests = run.tables.events.selectExpr(
        "user_id", "event_id pos", REQ + " name", "event_id % 12 raw_limit")
    return cx.sanitize_requests(requests, "user_id")


# -------------------------------------------------------------------------- streams
def stream(run, name):
    return st.read_stream(run.spark, f"{run.root}/{name}.parquet")


def to_table(run, df, mode: str, name: str) -> str:
    path = scratch_path(run.spark, name)
    st.run_available(df, mode, f"{path}-state", st.change_sink(path))
    return path


VIEWS["v_doc_clean"] = f"""select doc_id source_id, {clean_sql('text')} "content"
  from documents"""


@query("str_01", f"""select source_id, pred_label, {rnd('confidence', 6)} confidence from (
  select *, {LABEL_LIST}[top + 1] pred_label from {probs_sql('v_doc_clean')})""")
def str_01(run):
    path = scratch_path(run.spark, "scored")
    texts = stream(run, "documents").selectExpr(
        "'post' source_type", "doc_id source_id", "doc_id post_id",
        "timestamp_ntz '2024-01-01 00:00:00' source_created_at", "text text_raw")
    sink = st.scoring_sink(path, letter_scorer, "letters", clean_text)
    st.run_available(texts, "append", f"{path}-state", sink)
    return run.spark.read.parquet(path).select(
        "source_id", "pred_label", round_to(F.col("confidence"), 6).alias("confidence"))


@query("str_02", """select strftime(ts, '%Y-%m-%d') "day", event_type, count(*) n from events
  group by 1, 2""")
def str_02(run):
    counts = st.daily_counts(stream(run, "events"), "ts", "event_type")
    path = to_table(run, counts, "update", "daily")
    return st.read_changes(run.spark, path, ["day", "event_type"]).withColumn(
        "day", F.date_format("day", "yyyy-MM-dd"))


ROWS_PER_FILE = 2_000_000


@query("str_02_series")
def str_02_series(run):
    """The emotion series from daily sums that a stream of predictions maintains."""
    source, path = scratch_path(run.spark, "predictions"), scratch_path(run.spark, "daily")
    # a third of the files per batch, so that days and models come in several batches; the files of a
    # batch grow in number and not in size
    files = 1 + run.tables.lineitem.count() // ROWS_PER_FILE
    run.tables.prediction.repartitionByRange(3 * files, "source_created_at").write.parquet(source)
    st.run_available(st.read_stream(run.spark, source, files), "append", f"{path}-state",
                     st.daily_sink(path))
    return kpi.maintained_series(st.read_daily(run.spark, path), run.spark.read.parquet(source),
                                 run.window())


ORACLES["str_02_series"] = ORACLES["kpi_13"]


@query("str_03", f"""select post_id, arg_max(i, (captured_at, i)) interaction_count,
  {iso('max(captured_at)')} as_of from (select l_orderkey + 1 post_id, l_shipdate captured_at,
  cast(l_quantity as bigint) + cast(floor(l_extendedprice / 100) as bigint) + l_linenumber i
  from lineitem) group by 1""")
def str_03(run):
    snapshots = stream(run, "lineitem").selectExpr(
        "l_orderkey + 1 post_id", "l_shipdate captured_at",
        "cast(l_quantity as bigint) comments_count",
        "cast(floor(l_extendedprice / 100) as bigint) attitudes_count",
        "cast(l_linenumber as bigint) reposts_count")
    path = scratch_path(run.spark, "snapshots")
    with ss.disk_state(run.spark, empty_batches=False):
        st.run_available(ss.newest_snapshots(snapshots), "update", f"{path}-state",
                         ss.newest_sink(path))
    return ss.read_newest(run.spark, path).withColumn("as_of", local_iso(F.col("as_of")))


@query("str_04", "select distinct l_orderkey * 10 + l_linenumber comment_id from lineitem")
def str_04(run):
    versions = stream(run, "lineitem").selectExpr(
        "l_orderkey * 10 + l_linenumber comment_id", "l_shipdate created_at")
    once = st.drop_repeats(versions, ["comment_id"], "created_at", "4000 days")
    path = to_table(run, once, "append", "versions")
    return run.spark.read.parquet(path).select("comment_id")


@query("str_05", f"""select user_id, {iso('min(ts)')} "start", {iso('max(ts) + interval 30 minutes')}
  "end", count(*) events from (select *, sum(fresh) over (partition by user_id order by ts, event_id)
  g from (select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id)
  < interval 30 minutes then 0 else 1 end fresh from events)) group by user_id, g""")
def str_05(run):
    path = scratch_path(run.spark, "sessions")
    with ss.disk_state(run.spark):
        st.run_available(ss.user_sessions(stream(run, "events")), "append", f"{path}-state",
                         st.change_sink(path))
    closed = run.spark.read.parquet(path).drop("batch_id")
    return closed.unionByName(ss.open_sessions(run.spark, f"{path}-state")).select(
        "user_id", local_iso(F.col("start")).alias("start"), local_iso(F.col("end")).alias("end"),
        "events")


WEEK = "cast(floor(epoch(ts) / 604800) as bigint)"


@query("str_06", f"""select strftime(make_timestamp({WEEK} * 604800 * 1000000), '%Y-%m-%d')
  "start", negative, previous, {rnd(ratio('(negative - previous)', '(previous + 5.0)'), 6)} growth
  from (select any_value(ts) ts, count(*) filter (where event_type in ('error')) negative,
  coalesce(lag(count(*) filter (where event_type in ('error'))) over (order by {WEEK}), 0) previous
  from events group by {WEEK})""")
def str_06(run):
    halves = st.half_window_counts(stream(run, "events"), "ts",
                                   F.col("event_type").isin("error"), "7 days")
    path = to_table(run, halves, "update", "halves")
    counts = st.read_changes(run.spark, path, ["start"])
    return st.half_window_alerts(counts).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


