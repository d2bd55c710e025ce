"""TOP-*: topic analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import SETTINGS, VIEWS, query
from checks.views import DOMINANT, EMOTIONS, SIX, big, day, growth, iso, label, micros, ratio, rnd
from tidemark.operators import topics as t
from tidemark.operators.samples import EMOTION_COUNTS
from tidemark.plans.risk import risk_topics, scored_topics, topic_risk

TYPES = ("hot", "keyword", "kol", "retweet")
FACTORS = ("negative_ratio", "negative_growth", "interaction_growth", "anger_fear",
           "kol_verified", "source_diversity")


def topic_views(sfx: str, q: str = "", tag: str | None = None) -> None:
    """Views t_*: candidates, metrics, raw factors, caps and scores of one window."""
    tag = tag or sfx
    search = (f"and (contains(lower(title), '{q}') or contains(lower(lead), '{q}'))" if q else "")
    VIEWS.update({
        f"t_cand_{tag}": f"""select pt.topic_id, any_value(t.title) title, any_value(t.lead) lead,
          count(distinct pt.post_id) post_count from v_post_topic pt
          join v_topic t on t.topic_id = pt.topic_id
          where pt.post_id in (select post_id from p_{sfx}) {search}
          group by 1 having count(distinct pt.post_id) >= 3""",
        f"t_emo_{tag}": f"""select pt.topic_id, {EMOTIONS},
          count(*) filter (where source_type = 'post') post_samples,
          count(*) filter (where source_type = 'comment') comment_samples,
          count(*) filter (where pred_label_id in (1, 2, 3) and source_created_at >= w.mid_ts)
            recent_negative,
          count(*) filter (where pred_label_id in (1, 2, 3) and source_created_at < w.mid_ts)
            previous_negative
          from p_{sfx} sp join v_post_topic pt on pt.post_id = sp.post_id, w_{sfx} w
          where pt.topic_id in (select topic_id from t_cand_{tag}) group by 1""",
        f"t_growth_{sfx}": f"""select post_id,
          arg_min(comments_count + attitudes_count + reposts_count, captured_at) earliest,
          arg_max(comments_count + attitudes_count + reposts_count, captured_at) latest
          from eng_{sfx} group by 1""",
        f"t_eng_{tag}": f"""select pt.topic_id, {big('sum(earliest)')} earliest_interactions,
          {big('sum(latest)')} latest_interactions,
          {big('sum(greatest(latest - earliest, 0))')} interaction_delta
          from v_post_topic pt join t_growth_{sfx} e on e.post_id = pt.post_id group by 1""",
        f"t_src_{tag}": "select pt.topic_id, " + ", ".join(
            f"count(distinct pd.post_id) filter (where source_type = '{x}') source_{x}"
            for x in TYPES) + f""" from v_post_topic pt join v_discovery pd
          on pd.post_id = pt.post_id where pd.post_id in (select post_id from p_{sfx})
          group by 1""",
        f"t_act_{tag}": f"""select pt.topic_id,
          count(distinct pd.post_id) filter (where pd.source_type = 'kol') kol_entry_count,
          count(distinct u.uid) filter (where u.verified) verified_actor_count,
          count(distinct u.uid) filter (where u.profile_tier >= 1
            and u.followers_count >= 10000) high_follower_actor_count
          from v_post_topic pt join posts_{sfx} p on p.post_id = pt.post_id
          left join v_discovery pd on pd.post_id = pt.post_id
          left join v_user u on u.uid = p.user_id group by 1""",
        f"t_raw0_{tag}": f"""select c.topic_id, c.title, c.lead, c.post_count, {SIX},
          coalesce(sample_count, 0) sample_count, negative_count, anger_fear_count,
          confidence_micros, post_samples, comment_samples, recent_negative, previous_negative,
          coalesce(earliest_interactions, 0) earliest_interactions,
          coalesce(latest_interactions, 0) latest_interactions,
          coalesce(interaction_delta, 0) interaction_delta,
          coalesce(source_hot, 0) source_hot, coalesce(source_keyword, 0) source_keyword,
          coalesce(source_kol, 0) source_kol, coalesce(source_retweet, 0) source_retweet,
          coalesce(kol_entry_count, 0) kol_entry_count,
          coalesce(verified_actor_count, 0) verified_actor_count,
          coalesce(high_follower_actor_count, 0) high_follower_actor_count
          from t_cand_{tag} c left join t_emo_{tag} using (topic_id)
          left join t_eng_{tag} using (topic_id) left join t_src_{tag} using (topic_id)
          left join t_act_{tag} using (topic_id)""",
        f"t_raw_{tag}": f"""select *, {ratio('negative_count', 'sample_count')} negative_ratio_raw,
          {ratio('anger_fear_count', 'sample_count')} anger_fear_ratio_raw,
          {ratio('(recent_negative - previous_negative)', '(previous_negative + 5.0)')}
            negative_growth_raw,
          {ratio('interaction_delta', 'greatest(earliest_interactions, 1)')}
            interaction_growth_ratio,
          kol_entry_count + verified_actor_count + high_follower_actor_count kol_verified_raw,
          ({' + '.join(f'(source_{x} > 0)::int' for x in TYPES)}) / 4.0::double
            source_diversity_raw from t_raw0_{tag}""",
        f"t_caps_{tag}": "select " + ", ".join(
            f"coalesce(quantile_disc({c}, 0.95) filter (where {c} > 0), 1.0)::double cap_{n}"
            for n, c in (("negative_growth", "negative_growth_raw"),
                         ("interaction_growth", "interaction_delta"),
                         ("kol_verified", "kol_verified_raw"))) + f" from t_raw_{tag}",
    })


def norm(value: str, cap: str) -> str:
    return f"least(greatest({value}::double, 0.0) / greatest({cap}, 1e-9), 1.0)"


def score_view(tag: str, caps: str) -> None:
    VIEWS[f"t_pts_{tag}"] = f"""select r.*, c.*, 25.0::double * negative_ratio_raw
        points_negative_ratio,
      20.0::double * {norm('negative_growth_raw', 'cap_negative_growth')} points_negative_growth,
      20.0::double * {norm('interaction_delta', 'cap_interaction_growth')}
        points_interaction_growth,
      15.0::double * anger_fear_ratio_raw points_anger_fear,
      10.0::double * {norm('kol_verified_raw', 'cap_kol_verified')} points_kol_verified,
      10.0::double * source_diversity_raw points_source_diversity
      from t_raw_{tag} r, {caps} c"""
    total = " + ".join(f"points_{k}" for k in FACTORS)
    VIEWS[f"t_score_{tag}"] = f"""select *, case when risk_score >= 80 then 'high'
      when risk_score >= 60 then 'medium_high' when risk_score >= 40 then 'medium'
      else 'low' end risk_level from (select *, {rnd(total, 1)} risk_score from t_pts_{tag})"""


for sfx in ("all", "365d"):
    topic_views(sfx)
    score_view(sfx, f"t_caps_{sfx}")
topic_views("all", "widget", "widget")
score_view("widget", "t_caps_all")

SHARES = ", ".join(
    rnd(ratio(f"source_{x}", "(source_hot + source_keyword + source_kol + source_retweet)"))
    + f" share_{x}" for x in TYPES)


def ranked_sql(tag: str) -> str:
    return f"""select cast(topic_id as varchar) topic_id, title, lead, post_count, risk_score,
      risk_level, {label(DOMINANT)} dominant_emotion,
      {rnd('negative_ratio_raw')} negative_ratio, {rnd('negative_growth_raw')} negative_growth,
      {growth('negative_growth_raw')} negative_growth_label,
      {rnd('interaction_growth_ratio')} interaction_growth,
      {growth('interaction_growth_ratio')} interaction_growth_label,
      latest_interactions, sample_count, post_samples post_sample_count,
      comment_samples sampled_comment_count, kol_entry_count, verified_actor_count,
      high_follower_actor_count, {SHARES}, {SIX},
      {rnd(ratio('confidence_micros', 'sample_count * 1000000.0'))} avg_confidence,
      {', '.join(rnd(f'points_{k}', 1) + f' factor_{k}' for k in FACTORS)},
      '负面率 ' || printf('%.1f', {rnd(rnd('negative_ratio_raw') + ' * 100', 1)})
        || '%，主导情绪为' || {label(DOMINANT)} note
      from (select * from t_score_{tag} where sample_count > 0
      order by risk_score desc, sample_count desc, topic_id limit 20)"""


@query("top_10", ranked_sql("all"))
def top_10(run):
    return risk_topics(run.tables, run.window(), s=SETTINGS)


@query("top_10_year", ranked_sql("365d"))
def top_10_year(run):
    return risk_topics(run.tables, run.window("365d"), s=SETTINGS)


@query("top_10_search", ranked_sql("widget"))
def top_10_search(run):
    return risk_topics(run.tables, run.window(), q=" WIDGET", s=SETTINGS)


@query("top_01", "select * from t_cand_all")
def top_01(run):
    found = t.candidate_topics(run.tables, t.topic_totals(run.tables, run.window()))
    return found.select("topic_id", "title", "lead", "post_count")


@query("top_02", f"""select topic_id, {SIX}, sample_count, post_samples, comment_samples,
  {rnd(ratio('confidence_micros', 'sample_count * 1000000.0'))} avg_confidence, negative_count,
  recent_negative, previous_negative, anger_fear_count from
  (select pt.topic_id, {EMOTIONS}, count(*) filter (where source_type = 'post') post_samples,
    count(*) filter (where source_type = 'comment') comment_samples,
    count(*) filter (where pred_label_id in (1, 2, 3) and source_created_at >= w.mid_ts)
      recent_negative,
    count(*) filter (where pred_label_id in (1, 2, 3) and source_created_at < w.mid_ts)
      previous_negative
   from p_all sp join v_post_topic pt on pt.post_id = sp.post_id, w_all w group by 1)""")
def top_02(run):
    from tidemark.functions.numeric import mean_micros, round_to
    totals = t.topic_totals(run.tables, run.window()).filter("sample_count > 0")
    return totals.select(
        "topic_id", *EMOTION_COUNTS, "sample_count", "post_samples", "comment_samples",
        round_to(mean_micros(F.col("confidence_micros"), F.col("sample_count")))
        .alias("avg_confidence"),
        "negative_count", "recent_negative", "previous_negative", "anger_fear_count")


@query("top_03", "select * from t_eng_all")
def top_03(run):
    totals = t.topic_totals(run.tables, run.window())
    return totals.filter("latest_interactions > 0").select(
        "topic_id", "earliest_interactions", "latest_interactions", "interaction_delta")


@query("top_04", "select * from t_src_all")
def top_04(run):
    totals = t.topic_totals(run.tables, run.window()).filter("post_count > 0")
    return totals.select("topic_id", *[f"source_{x}" for x in TYPES])


@query("top_05", """select * from t_act_all
  where kol_entry_count + verified_actor_count + high_follower_actor_count > 0""")
def top_05(run):
    totals = t.topic_totals(run.tables, run.window())
    cols = ["kol_entry_count", "verified_actor_count", "high_follower_actor_count"]
    return totals.select("topic_id", *cols).filter(" + ".join(cols) + " > 0")


RAW = ("negative_ratio_raw", "anger_fear_ratio_raw", "negative_growth_raw",
       "interaction_growth_ratio", "source_diversity_raw")


@query("top_06", f"select topic_id, {', '.join(rnd(c, 6) + ' ' + c for c in RAW)}, "
       "interaction_delta, kol_verified_raw from t_raw_all")
def top_06(run):
    from tidemark.functions.numeric import round_to
    raw = t.topic_candidates_with_factors(run.tables, run.window())
    return raw.select("topic_id", *[round_to(F.col(c), 6).alias(c) for c in RAW],
                      "interaction_delta", "kol_verified_raw")


CAPS = ("cap_negative_growth", "cap_interaction_growth", "cap_kol_verified")


@query("top_07", f"select {', '.join(rnd(c, 6) + ' ' + c for c in CAPS)} from t_caps_all")
def top_07(run):
    from tidemark.functions.numeric import round_to
    found = t.topic_candidates_with_factors(run.tables, run.window())
    return t.window_caps(found).select(*[round_to(F.col(c), 6).alias(c) for c in CAPS])


@query("top_08", "select topic_id, risk_score, risk_level, "
       + ", ".join(rnd(f"points_{k}", 4) + f" points_{k}" for k in FACTORS)
       + " from t_score_all")
def top_08(run):
    from tidemark.functions.numeric import round_to
    return scored_topics(run.tables, run.window()).select(
        "topic_id", "risk_score", "risk_level",
        *[round_to(F.col(f"points_{k}"), 4).alias(f"points_{k}") for k in FACTORS])


@query("top_09", f"select topic_id, {label(DOMINANT)} dominant_emotion from t_emo_all")
def top_09(run):
    from tidemark.functions.labels import label_name
    from tidemark.operators.samples import dominant_emotion_id
    found = t.candidate_topics(run.tables, t.topic_totals(run.tables, run.window()))
    return found.select("topic_id", label_name(dominant_emotion_id()).alias("dominant_emotion"))


# the busiest topic, which the searched lists also show
BUSIEST = "(select topic_id from v_post_topic group by 1 order by count(*) desc, topic_id limit 1)"


def busiest(run) -> int:
    counts = run.tables.post_topic.groupBy("topic_id").count()
    return counts.orderBy(F.desc("count"), "topic_id").first()["topic_id"]


VIEWS["one_topic"] = f"select post_id from v_post_topic where topic_id = {BUSIEST}"
VIEWS["one_samples"] = "select * from p_all where post_id in (select post_id from one_topic)"


@query("top_11", f"""select topic_id, title, lead, read_count, discuss_count,
  {iso('first_seen_at')} first_seen_at, {iso('last_seen_at')} last_seen_at,
  (select count(distinct post_id) from one_samples) post_count from v_topic
  where topic_id = {BUSIEST}""")
def top_11(run):
    return t.topic_base(run.tables, run.window(), busiest(run))


DAILY = f"""select {day('source_created_at')} "day", {EMOTIONS} from one_samples group by 1"""


@query("top_12", f"""select "day", {SIX}, sample_count total,
  {rnd(ratio('negative_count', 'sample_count'))} negative_ratio,
  {rnd(ratio('confidence_micros', 'sample_count * 1000000.0'))} avg_confidence from ({DAILY})""")
def top_12(run):
    return t.emotion_by_day(t.topic_samples(run.tables, run.window(), busiest(run)))


@query("top_13", f"""select {SIX}, {', '.join(
    rnd(ratio(f'emotion_{i}', 'sample_count')) + f' ratio_{i}' for i in range(6))},
  sample_count total, negative_count, {rnd(ratio('negative_count', 'sample_count'))}
  negative_ratio, anger_fear_count, {rnd(ratio('anger_fear_count', 'sample_count'))}
  anger_fear_ratio from (select {EMOTIONS} from one_samples)""")
def top_13(run):
    return t.emotion_distribution(t.topic_samples(run.tables, run.window(), busiest(run)))


@query("top_14", f"""select "day", {big('sum(c)')} comments_count, {big('sum(a)')}
  attitudes_count, {big('sum(r)')} reposts_count, {big('sum(c + a + r)')} interaction_count from
  (select {day('captured_at')} "day", post_id, arg_max(comments_count, captured_at) c,
   arg_max(attitudes_count, captured_at) a, arg_max(reposts_count, captured_at) r from eng_all
   where post_id in (select post_id from one_topic) group by 1, 2) group by 1""")
def top_14(run):
    return t.engagement_curve(run.tables, run.window(), busiest(run))


@query("top_15", f"""select {big('coalesce(sum(earliest), 0)')} earliest_interactions,
  {big('coalesce(sum(latest), 0)')} latest_interactions,
  {big('coalesce(sum(greatest(latest - earliest, 0)), 0)')} interaction_delta,
  {rnd(ratio('sum(greatest(latest - earliest, 0))', 'greatest(sum(earliest), 1)'))}
  interaction_growth from t_growth_all where post_id in (select post_id from one_topic)""")
def top_15(run):
    return t.engagement_summary(run.tables, run.window(), busiest(run))


@query("top_16", "select *, " + SHARES + " from (select " + ", ".join(
    f"count(distinct post_id) filter (where source_type = '{x}') source_{x}" for x in TYPES)
    + """ from v_discovery where post_id in (select post_id from one_samples)
      and post_id in (select post_id from one_topic))""")
def top_16(run):
    return t.topic_sources(run.tables, run.window(), busiest(run))


@query("top_17", f"""select verified_actor_count, high_follower_actor_count, kol_entry_count
  from t_act_all where topic_id = {BUSIEST}""")
def top_17(run):
    return t.topic_actor_signals(run.tables, run.window(), busiest(run))


@query("top_18", f"""select topic_id, risk_score, risk_level, {', '.join(
    rnd(f'points_{k}', 1) + f' factor_{k}' for k in FACTORS)}
  from t_score_all where topic_id = {BUSIEST}""")
def top_18(run):
    from tidemark.functions.numeric import round_to
    one = topic_risk(run.tables, run.window(), busiest(run))
    return one.select("topic_id", "risk_score", "risk_level", *[
        round_to(F.col(f"points_{k}"), 1).alias(f"factor_{k}") for k in FACTORS])


@query("top_20", "select topic_id, m['n'] leading_factor, " + rnd("m['p']", 1)
       + " leading_points from (select topic_id, list_max([" + ", ".join(
           f"{{'p': points_{k}, 'n': '{k}'}}" for k in FACTORS) + "]) m from t_score_all)")
def top_20(run):
    return t.leading_factor(scored_topics(run.tables, run.window()))


@query("top_21", "select * from (" + " union all ".join(
    f"select topic_id, {label(str(i))} emotion, {rnd(ratio(f'emotion_{i}', 'sample_count'))} share"
    f" from t_score_all" for i in range(6)) + ") where share > 0")
def top_21(run):
    return t.emotion_stack(scored_topics(run.tables, run.window()))


WEIGHTS = dict(zip(FACTORS, (25, 20, 20, 15, 10, 10)))


@query("top_22", "select topic_id, " + ", ".join(
    rnd(f"least(points_{k} / {w}.0::double * 100, 100.0)", 2) + f" fill_{k}"
    for k, w in WEIGHTS.items()) + " from t_score_all")
def top_22(run):
    return t.factor_fill(scored_topics(run.tables, run.window()))
