"""EV-*, ML-15/16 and DOC-*: evidence, disagreement, documented patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import VIEWS, query
from checks.topics import BUSIEST, busiest
from checks.views import big, iso, label, ratio, rnd
from tidemark.functions.numeric import local_iso, round_to
from tidemark.operators import contract as c
from tidemark.operators import disagreement as d
from tidemark.operators import evidence as e
from tidemark.operators.dedupe import latest_version, latest_with_first_seen

SCORE = rnd("""case when pred_label_id in (1, 3) then 30.0::double when pred_label_id in (1, 2, 3)
  then 20.0::double else 0.0::double end + confidence * 20.0::double
  + case when margin < 0.15::double then 12.0::double else 0.0::double end
  + ln(1 + interaction_count::double) * 3.0::double
  + case when verified then 10.0::double else 0.0::double end""", 6)


def evidence_view(name: str, sfx: str, topic: str = "", text: str = "", who: str = "") -> None:
    pick = f"where topic_id = {topic}" if topic else ""
    VIEWS[name] = f"""select *, {SCORE} evidence_score, case when verified then 'verified_actor'
      when profile_tier >= 1 then 'tier' || profile_tier else 'tier0' end actor_role from (
      select sp.source_type "source", sp.source_id, sp.post_id, l.topic_id, sp.source_created_at,
      s.text_raw "content", sp.pred_label_id, sp.second_label_id, sp.confidence, sp.margin,
      u.verified, u.profile_tier, coalesce(x.interaction_count, 0) interaction_count
      from p_{sfx} sp join (select post_id, min(topic_id) topic_id from v_post_topic {pick}
        group by 1) l on l.post_id = sp.post_id
      join (select 'post' k, post_id source_id, post_id, user_id, text_raw from v_post
        union all select 'comment', comment_id, post_id, user_id, text_raw from v_comment) s
        on s.k = sp.source_type and s.source_id = sp.source_id and s.post_id = sp.post_id
      left join v_user u on u.uid = s.user_id
      left join latest_{sfx} x on x.post_id = sp.post_id where true {text} {who})"""


evidence_view("e_all", "all")
evidence_view("e_year", "all")
evidence_view("e_topic", "all", BUSIEST)
evidence_view("e_text", "all", "", "and contains(lower(s.text_raw), 'urgent')")
evidence_view("e_who", "all", "", "", "and s.user_id = (select min(uid) from v_user)")
TOP = "order by evidence_score desc, \"source\", source_id limit {}"


def rendered(view: str, limit: int) -> str:
    return f"""select 'ev_' || lpad(n::varchar, 6, '0') sample_id, "source",
      source_id::varchar source_id, post_id::varchar post_id, topic_id::varchar topic_id,
      {iso('source_created_at')} created_at, "content", {label('pred_label_id')} pred_label,
      {rnd('confidence')} confidence, {label('second_label_id')} second_label,
      {rnd('margin')} margin, interaction_count, actor_role, evidence_score,
      concat_ws(' + ', {label('pred_label_id')}, case when interaction_count > 0 then '高互动' end,
        case when actor_role = 'verified_actor' then '认证账号' end,
        case when margin < 0.15::double then '低 margin' end) evidence_reason
      from (select *, row_number() over (order by evidence_score desc, "source", source_id) n
        from {view}) where n <= {limit}"""


FEED = ["source", "source_id", "post_id", "topic_id", "interaction_count", "evidence_score"]
FEED_SQL = "select " + ", ".join(f'"{x}"' for x in FEED)


@query("ev_01", "select \"source\", source_id, evidence_score from e_year")
def ev_01(run):
    return e.evidence_feed(run.tables, run.window()).select(
        "source", "source_id", "evidence_score")


@query("ev_02", FEED_SQL + " from e_year where \"source\" = 'post'")
def ev_02(run):
    return e.evidence_feed(run.tables, run.window(), kinds=("post",)).select(*FEED)


@query("ev_03", FEED_SQL + " from e_year where \"source\" = 'comment'")
def ev_03(run):
    return e.evidence_feed(run.tables, run.window(), kinds=("comment",)).select(*FEED)


@query("ev_04", FEED_SQL + " from e_text")
def ev_04(run):
    return e.evidence_feed(run.tables, run.window(), q="Urgent").select(*FEED)


@query("ev_04_topic", FEED_SQL + " from e_topic")
def ev_04_topic(run):
    return e.evidence_feed(run.tables, run.window(), topic_id=busiest(run)).select(*FEED)


@query("ev_04_author", FEED_SQL + " from e_who")
def ev_04_author(run):
    author = run.tables.user.agg(F.min("uid")).first()[0]
    return e.evidence_feed(run.tables, run.window(), author=author).select(*FEED)


@query("ev_05", rendered("e_all", 8))
def ev_05(run):
    return e.render_evidence(e.evidence_page(run.tables, run.window(), 8))


@query("ev_06", """select evidence_score, "source", source_id, n "rank",
  cast(floor((n - 1) / 30) + 1 as bigint) "page" from (select *, row_number() over (
  order by evidence_score desc, "source", source_id) n from e_all)""")
def ev_06(run):
    return e.numbered_pages(e.evidence_feed(run.tables, run.window()), 30)


@query("ev_06_next", """select "source", source_id, evidence_score from (select *,
  row_number() over (order by evidence_score desc, "source", source_id) n from e_all)
  where n > 8 and n <= 16""")
def ev_06_next(run):
    window = run.window()
    run.tables.keep("comment")  # the feed and the texts of both pages read it
    feed = e.stored_feed(run.tables, window)  # both pages read it
    key = e.next_key(e.evidence_page(run.tables, window, 8, feed=feed), 8).first()
    after = (key["evidence_score"], key["source"], key["source_id"])
    return e.evidence_page(run.tables, window, 8, after=after, feed=feed).select(
        "source", "source_id", "evidence_score")


@query("ev_07", "select actor_role, count(*) n from e_all group by 1")
def ev_07(run):
    return e.evidence_feed(run.tables, run.window()).groupBy("actor_role").agg(
        F.count("*").alias("n"))


@query("ev_08", f"""select "source", source_id, concat_ws(' + ', {label('pred_label_id')},
  case when interaction_count > 0 then '高互动' end,
  case when actor_role = 'verified_actor' then '认证账号' end,
  case when margin < 0.15::double then '低 margin' end) evidence_reason from e_year""")
def ev_08(run):
    return e.evidence_feed(run.tables, run.window()).select(
        "source", "source_id", e.evidence_reason().alias("evidence_reason"))


# ------------------------------------------------------------------ disagreement
VIEWS["pairs"] = """select a.source_type, a.source_id, a.post_id, a.source_created_at,
  a.pred_label_id la, b.pred_label_id lb, a.confidence ca, b.confidence cb, a.margin ma,
  b.margin mb from v_prediction a join v_prediction b on a.source_type = b.source_type
  and a.source_id = b.source_id where a.model_version = 'primary'
  and b.model_version = 'secondary'"""


@query("ml_15", """select i::int primary_pred_label_id, j::int secondary_pred_label_id,
  (select count(*) from pairs where la = i and lb = j) n
  from range(6) a(i), range(6) b(j)""")
def ml_15(run):
    return d.agreement_matrix(run.tables.prediction)


@query("ml_15_summary", f"""select count(*) samples_total,
  count(*) filter (where la = lb) agreement_count,
  {rnd(ratio('count(*) filter (where la = lb)', 'count(*)'))} agreement_rate from pairs""")
def ml_15_summary(run):
    return d.agreement_summary(d.agreement_matrix(run.tables.prediction))


@query("ml_16", f"""select source_type "source", source_id::varchar source_id,
  post_id::varchar post_id, {iso('source_created_at')} created_at, text_raw "content",
  {label('la')} primary_label, {rnd('ca')} primary_confidence, {rnd('ma')} primary_margin,
  {label('lb')} secondary_label, {rnd('cb')} secondary_confidence, {rnd('mb')} secondary_margin
  from (select p.*, s.text_raw, {rnd('ca + cb', 6)} total from pairs p join (
    select 'post' k, post_id i, text_raw from v_post union all
    select 'comment', comment_id, text_raw from v_comment) s
    on s.k = p.source_type and s.i = p.source_id where la <> lb
    order by total desc, p.source_type, p.source_id limit 30)""")
def ml_16(run):
    return d.top_disagreements(run.tables, 30)


# --------------------------------------------------------------- documented patterns
TIES = ["l_partkey", "l_suppkey", "like_count", "l_returnflag", "l_linestatus"]


def as_text(df):
    """Nullable profile fields as text, so that both engines show the same nulls."""
    return df.withColumns({x: F.col(x).cast("string") for x in ("verified", "followers_count")})


@query("doc_01", "select comment_id, post_id, user_id, like_count, text_raw from v_comment")
def doc_01(run):
    return run.tables.comment.select("comment_id", "post_id", "user_id", "like_count", "text_raw")


@query("dq_15", f"""select comment_id, {iso('created_at')} created_at, l_partkey, l_suppkey
  from (select *, row_number() over (partition by comment_id order by created_at desc,
  l_partkey desc, l_suppkey desc, like_count desc) rn from v_comment_raw) where rn = 1""")
def dq_15(run):
    newest = latest_version(run.tables.comment_versions, ["comment_id"], "created_at", TIES)
    return newest.select("comment_id", local_iso(F.col("created_at")).alias("created_at"),
                         "l_partkey", "l_suppkey")


@query("doc_02", f"""select post_id, text_raw, {iso('created_at')} created_at from v_post
  where post_id in (select post_id from one_topic)
  and created_at >= (select max(created_at) from v_post) - interval 700 days""")
def doc_02(run):
    return c.recent_topic_posts(run.tables, busiest(run), 700).select(
        "post_id", "text_raw", local_iso(F.col("created_at")).alias("created_at"))


@query("doc_03", f"""select post_id, {iso('captured_at')} captured_at, comments_count
  + attitudes_count + reposts_count interaction_count, cast(comments_count
  + attitudes_count + reposts_count - lag(comments_count + attitudes_count + reposts_count) over (
  partition by post_id order by captured_at) as varchar) gain from v_engagement""")
def doc_03(run):
    grown = c.snapshot_growth(run.tables.engagement)
    return grown.select("post_id", local_iso(F.col("captured_at")).alias("captured_at"),
                        "interaction_count", F.col("gain").cast("string").alias("gain"))


@query("doc_04", f"""select post_id, arg_max(comments_count, captured_at) comments_count,
  arg_max(attitudes_count, captured_at) attitudes_count,
  arg_max(reposts_count, captured_at) reposts_count, {iso('max(captured_at)')} as_of
  from v_engagement group by 1""")
def doc_04(run):
    from tidemark.operators.samples import latest_engagement
    return latest_engagement(run.tables.engagement).select(
        "post_id", "comments_count", "attitudes_count", "reposts_count",
        local_iso(F.col("as_of")).alias("as_of"))


@query("doc_05", """select n.user_id, u.verified::varchar verified,
  u.followers_count::varchar followers_count, n.post_cnt from (
  select user_id, count(*) post_cnt from v_post where created_at >=
  (select max(created_at) from v_post) - interval 30 days group by 1) n
  left join (select * from v_user where profile_tier >= 1) u on u.uid = n.user_id
  order by post_cnt desc, n.user_id limit 50""")
def doc_05(run):
    return as_text(c.top_authors(run.tables, 30, 50))


@query("doc_06", """select s.post_id repost_id, s.user_id repost_user, o.post_id original_id,
  o.user_id original_user, o.text_raw from v_post s join v_post o on o.post_id = s.retweet_of
  where s.retweet_of <> 0""")
def doc_06(run):
    return c.repost_pairs(run.tables.post)


@query("doc_07", f"""select post_id, source_type, source_value, {iso('discovered_at')}
  discovered_at from (select *, row_number() over (partition by post_id order by discovered_at,
  source_type, source_value) rn from v_discovery) where rn = 1""")
def doc_07(run):
    return c.earliest_discovery(run.tables.discovery).withColumn(
        "discovered_at", local_iso(F.col("discovered_at")))


@query("doc_08", f"""select comment_id, text_raw, like_count, {iso('created_at')} created_at,
  verified, followers_count from v_comment left join v_user on uid = user_id
""")
def doc_08(run):
    return c.comment_inputs(run.tables).withColumn(
        "created_at", local_iso(F.col("created_at")))


@query("doc_09", """select 'post' tbl, count(*) n from v_post where created_at >=
  (select max(created_at) from v_post) - interval 365 days
  union all select 'comment', count(*) from v_comment where created_at >=
  (select max(created_at) from v_comment) - interval 180 days
  union all select 'engagement', count(*) from v_engagement where captured_at >=
  (select max(captured_at) from v_engagement) - interval 90 days""")
def doc_09(run):
    t = run.tables
    kept = {"post": c.retained(t.post, "created_at", "365 DAYS"),
            "comment": c.retained(t.comment, "created_at", "180 DAYS"),
            "engagement": c.retained(t.engagement, "captured_at", "90 DAYS")}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("tbl"), "n")
             for k, df in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


HOURS = """greatest((epoch((select max(captured_at) from v_engagement)) - epoch(created_at))
  / 3600.0::double, 0.0)"""


@query("doc_11", f"""select band, count(*) posts, {big('sum(observed)')} observed,
  {big('sum(expected)')} / 1000.0::double expected,
  {rnd(ratio('sum(observed)', big('sum(expected)') + ' / 1000.0::double'))} coverage from (
  select coalesce(o.n, 0) observed, case when h < 1 then '<1h' when h < 6 then '1-6h'
  when h < 24 then '6-24h' when h < 168 then '1-7d' else '>=7d' end band,
  cast(floor((greatest(least(h, 1.0) - 0.0, 0.0) * 12.0 + greatest(least(h, 6.0) - 1.0, 0.0) * 2.0
  + greatest(least(h, 24.0) - 6.0, 0.0) * 0.5 + greatest(least(h, 168.0) - 24.0, 0.0)
  * (1.0::double / 12)) * 1000 + 0.5) as bigint) expected from (
  select post_id, {HOURS} h from v_post) p left join (select post_id, count(*) n
  from v_engagement group by 1) o using (post_id)) group by 1""")
def doc_11(run):
    return c.snapshot_coverage(run.tables)


@query("doc_12", f"""select post_id, case when platform > 500 then 'hot' else 'default' end tier,
  platform, coalesce(n, 0) sampled, {rnd(ratio('coalesce(n, 0)', 'platform'))} coverage from (
  select post_id, arg_max(comments_count, captured_at) platform from v_engagement group by 1)
  left join (select post_id, count(*) n from v_comment group by 1) using (post_id)""")
def doc_12(run):
    return c.comment_coverage(run.tables)


@query("doc_13", f"""select original_id, count(*) posts, {big('coalesce(sum(n), 0)')} spread from (
  select post_id, case when retweet_of <> 0 then retweet_of else post_id end original_id
  from v_post) left join (select post_id, arg_max(comments_count + attitudes_count
  + reposts_count, captured_at) n from v_engagement group by 1) using (post_id) group by 1""")
def doc_13(run):
    return c.total_spread(run.tables)


@query("doc_14", f"""select post_id, source_type, count(*) times, {iso('min(discovered_at)')}
  first_at, {iso('max(discovered_at)')} last_at from v_discovery group by 1, 2""")
def doc_14(run):
    return c.rediscoveries(run.tables.discovery).withColumns({
        x: local_iso(F.col(x)) for x in ("first_at", "last_at")})


@query("doc_14_sequence", """select post_id, string_agg(source_type, '>' order by first_at,
  source_type) entry_sequence from (select post_id, source_type, min(discovered_at) first_at
  from v_discovery group by 1, 2) group by 1""")
def doc_14_sequence(run):
    return c.entry_sequence(run.tables.discovery)


@query("doc_15", """select p.post_id, u.verified::varchar verified,
  u.followers_count::varchar followers_count from v_post p
  left join (select * from v_user where profile_tier >= 1) u on u.uid = p.user_id""")
def doc_15(run):
    trusted = run.tables.user.filter("profile_tier >= 1")
    joined = c.with_profile(run.tables.post.select("post_id", "user_id"), trusted, "post_id")
    return as_text(joined.select("post_id", "verified", "followers_count"))


@query("doc_16", f"""select comment_id, user_id, {iso('first_at')} first_at from (
  select *, min(created_at) over (partition by comment_id) first_at, row_number() over (
  partition by comment_id order by created_at desc, l_partkey desc, l_suppkey desc,
  like_count desc) rn from v_comment_raw) where rn = 1""")
def doc_16(run):
    versions = run.tables.comment_versions.withColumn("first_at", F.col("created_at"))
    newest = latest_with_first_seen(versions, ["comment_id"], "created_at", "first_at", TIES)
    return newest.select("comment_id", "user_id", local_iso(F.col("first_at")).alias("first_at"))
