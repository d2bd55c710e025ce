"""KPI-* and DQ-16/17: windows, overview figures, emotion series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import STABLE_DAY, VIEWS, query
from checks.views import EMOTIONS, SIX, big, day, iso, label, ratio, rnd
from tidemark.operators import kpi as k
from tidemark.operators import window as w

DAYS = ("greatest(1, date_diff('day', cast(start_ts + interval 8 hours as date), "
        "cast(end_ts + interval 8 hours as date)) + 1)")


def times(df, *cols):
    from tidemark.functions.numeric import local_iso
    return df.withColumns({c: local_iso(F.col(c)) for c in cols})


@query("kpi_01", f"""select {iso('start_ts')} start_ts, {iso('end_ts')} end_ts,
  {big(DAYS)} available_days from w_base""")
def kpi_01(run):
    return times(w.data_window(run.tables.post, STABLE_DAY), "start_ts", "end_ts")


@query("kpi_01_fallback", f"""select {iso('start_ts')} start_ts, {iso('end_ts')} end_ts,
  {big(DAYS)} available_days from (select min(first_crawled_at) start_ts,
  max(created_at) end_ts from v_post)""")
def kpi_01_fallback(run):
    return times(w.data_window(run.tables.post, 10**12), "start_ts", "end_ts")


@query("kpi_02", " union all ".join(
    f"select '{r}' range_key, {iso('start_ts')} start_ts, {iso('end_ts')} end_ts, "
    f"{big(DAYS)} available_days from {v}"
    for r, v in (("all_available", "w_all"), ("7d", "w_7d"), ("24h", "w_24h"))))
def kpi_02(run):
    base = w.data_window(run.tables.post, STABLE_DAY)
    parts = [w.range_window(base, r) for r in ("all_available", "7d", "24h")]
    stacked = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return times(stacked, "start_ts", "end_ts").select(
        "range_key", "start_ts", "end_ts", "available_days")


@query("kpi_03", f"select {iso('mid_ts')} mid_ts from w_all")
def kpi_03(run):
    base = w.data_window(run.tables.post, STABLE_DAY)
    return times(w.range_window(base, "all_available"), "mid_ts").select("mid_ts")


@query("kpi_04", "select count(distinct post_id) post_count from posts_all")
def kpi_04(run):
    return k.post_count(run.tables, run.window())


@query("kpi_05", "select count(distinct comment_id) sampled_comment_count from comments_all")
def kpi_05(run):
    return k.comment_count(run.tables, run.window())


ACTIVE = """select count(distinct topic_id) active_topic_count from v_post_topic
  where topic_id in (select topic_id from v_topic)
  and post_id in (select post_id from posts_{0})"""
TOTAL = big("coalesce(sum(i), 0)")
INTERACTIONS = """select {1} latest_interactions from (select arg_max(comments_count
  + attitudes_count + reposts_count, captured_at) i from v_engagement
  where post_id in (select post_id from posts_{0}) group by post_id)"""
KOL = """select count(distinct post_id) kol_entry_post_count from v_discovery
  where source_type = 'kol' and post_id in (select post_id from posts_{0})"""
VERIFIED = """select count(distinct uid) verified_actor_count from v_user where verified
  and uid in (select user_id from posts_{0} union select user_id from comments_{0})"""


@query("kpi_06", ACTIVE.format("all"))
def kpi_06(run):
    return k.active_topics(run.tables, run.window())


@query("kpi_07", INTERACTIONS.format("all", TOTAL))
def kpi_07(run):
    return k.total_interactions(run.tables, run.window())


@query("kpi_08", KOL.format("all"))
def kpi_08(run):
    return k.kol_entry_posts(run.tables, run.window())


@query("kpi_09", VERIFIED.format("all"))
def kpi_09(run):
    return k.verified_actors(run.tables, run.window())


def summary_sql(sfx: str) -> str:
    neg, af = ratio("negative_count", "sample_count"), ratio("anger_fear_count", "sample_count")
    return f"""select sample_count total, {rnd(neg)} negative_ratio, {rnd(af)} anger_fear_ratio,
      {rnd(f'100.0::double * (0.70::double * {neg} + 0.30::double * {af})', 1)} risk_index,
      {rnd(ratio('confidence_micros', 'sample_count * 1000000.0'))} avg_confidence,
      low_confidence_count from (select {EMOTIONS}, count(*) filter (where
      confidence < 0.70::double or margin < 0.15::double) low_confidence_count from p_{sfx})"""


@query("kpi_10", summary_sql("all"))
def kpi_10(run):
    return k.prediction_summary(run.tables, run.window())


@query("kpi_11", f"select risk_index from ({summary_sql('all')})")
def kpi_11(run):
    return k.prediction_summary(run.tables, run.window()).select("risk_index")


def tier_view(sfx: str) -> None:
    VIEWS[f"tier_{sfx}"] = f"""select profile_tier, n,
      {rnd(ratio('n', 'sum(n) over ()'))} share from (
      select profile_tier, count(distinct uid) n from v_user where uid in (
      select user_id from v_post, w_{sfx} w where created_at >= w.start_ts union
      select user_id from v_comment, w_{sfx} w where created_at >= w.start_ts) group by 1)"""


tier_view("all")


@query("kpi_12", f"""select s.total prediction_sample_count, s.negative_ratio,
  s.anger_fear_ratio, s.risk_index, s.avg_confidence, s.low_confidence_count,
  (select count(*) from posts_all) post_count,
  (select count(distinct comment_id) from comments_all) sampled_comment_count,
  ({ACTIVE.format('all')}) active_topic_count,
  ({INTERACTIONS.format('all', TOTAL)}) latest_interactions,
  ({KOL.format('all')}) kol_entry_post_count, ({VERIFIED.format('all')}) verified_actor_count,
  (select string_agg(profile_tier || '=' || printf('%.4f', share), ',' order by profile_tier)
   from tier_all) profile_tiers from ({summary_sql('all')}) s""")
def kpi_12(run):
    return k.overview(run.tables, run.window())


SERIES = f"""select {day('source_created_at')} "day", {EMOTIONS} from p_all group by 1"""


@query("kpi_13", f"""select "day", {SIX}, sample_count total,
  {rnd(ratio('negative_count', 'sample_count'))} negative_ratio,
  {rnd(ratio('confidence_micros', 'sample_count * 1000000.0'))} avg_confidence from ({SERIES})""")
def kpi_13(run):
    return k.emotion_series(run.tables, run.window())


ALL_SIX = "(" + " + ".join(f"sum(emotion_{i})" for i in range(6)) + ")"


@query("kpi_14", " union all ".join(
    f"select {label(str(i))} emotion, {big(f'sum(emotion_{i})')} n, "
    f"{rnd(ratio(f'sum(emotion_{i})', ALL_SIX))} share, "
    f"{rnd(ratio('(sum(emotion_1) + sum(emotion_2) + sum(emotion_3))', ALL_SIX))} negative_share"
    f" from ({SERIES})" for i in range(6)))
def kpi_14(run):
    return k.series_totals(k.emotion_series(run.tables, run.window()))


@query("kpi_15", f"""select {iso('start_ts')} start_iso, {iso('end_ts')} end_iso,
  {big(DAYS)} available_days, {DAYS} < 30 is_partial_history,
  'all_available' || case when {DAYS} >= 1 then ',24h' else '' end
  || case when {DAYS} >= 7 then ',7d' else '' end range_options from w_base""")
def kpi_15(run):
    return w.window_meta(w.data_window(run.tables.post, STABLE_DAY))


@query("dq_16", "select * from tier_all")
def dq_16(run):
    return k.tier_distribution(run.tables, run.window())


@query("dq_17", f"select {rnd('sum(share) filter (where profile_tier >= 1)')} trusted_ratio "
       "from tier_all")
def dq_17(run):
    return k.trusted_tier_ratio(k.tier_distribution(run.tables, run.window()))
