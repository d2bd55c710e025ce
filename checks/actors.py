"""ACT-*: key actors."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import VIEWS, query
from checks.topics import BUSIEST, busiest
from checks.views import DOMINANT, SIX, big, label, ratio, rnd
from tidemark.operators import actors as a
from tidemark.plans.actors import key_actors

NEG = "count(*) filter (where pred_label_id in (1, 2, 3))"


def actor_views(sfx: str, tag: str, topic: str | None = None) -> None:
    """Views a_*: role branches, candidates, details and rendered actors of one window."""
    post_in = "" if topic is None else (
        f"and {{0}} in (select post_id from v_post_topic where topic_id = {topic})")
    cross = "" if topic is not None else f"""union all select user_id, 0, 0, 0, 0, 0, 1 from
      (select p.user_id, count(distinct pt.topic_id) n from posts_{sfx} p join v_post_topic pt
       on pt.post_id = p.post_id group by 1) where n >= 3"""
    p_in, sp_in, u_in = post_in.format("p.post_id"), post_in.format("sp.post_id"), (
        post_in.format("post_id"))
    VIEWS.update({
        f"a_p95_{tag}": f"""select greatest(1, cast(floor(coalesce(
          quantile_cont(interaction_count, 0.95), 0)) as bigint)) p95 from latest_{sfx}""",
        f"a_said_{tag}": f"""select p.user_id uid, sp.pred_label_id, sp.source_type,
          coalesce(e.interaction_count, 0) interaction_count
          from p_{sfx} sp join v_post p on p.post_id = sp.source_id
          left join latest_{sfx} e on e.post_id = sp.post_id
          where sp.source_type = 'post' {sp_in} union all
          select c.user_id, sp.pred_label_id, sp.source_type, c.like_count
          from p_{sfx} sp join v_comment c on c.post_id = sp.post_id
          and c.comment_id = sp.source_id where sp.source_type = 'comment' {sp_in}""",
        f"a_cand_{tag}": f"""select uid, max(k) is_entry_kol, max(h) is_high_inter,
          max(p) is_polar, max(a) is_active, max(v) is_verified_kol, max(x) is_cross_topic from (
          select p.user_id uid, 1 k, 0 h, 0 p, 0 a, 0 v, 0 x from v_discovery pd
            join posts_{sfx} p on p.post_id = pd.post_id where pd.source_type = 'kol' {p_in}
          union all select p.user_id, 0, 1, 0, 0, 0, 0 from latest_{sfx} e
            join posts_{sfx} p on p.post_id = e.post_id
            where e.interaction_count >= (select p95 from a_p95_{tag}) {p_in}
          union all select uid, 0, 0, (n >= 3 and neg / n >= 0.60)::int, (n >= 10)::int, 0, 0
            from (select uid, count(*) n, {NEG} neg from a_said_{tag} group by 1)
            where n >= 3 and (n >= 10 or neg / n >= 0.60)
          union all select uid, 0, 0, 0, 0, 1, 0 from v_user where (verified or
            (profile_tier >= 1 and followers_count >= 10000)) and uid in (
            select user_id from posts_{sfx} where true {u_in} union
            select user_id from comments_{sfx} where true {u_in})
          {cross}) where uid > 0 group by 1""",
        f"a_mark_{tag}": f"select * from a_cand_{tag}",
        f"a_topics_{tag}": f"""select s.uid, pt.topic_id, any_value(t.title) title,
          count(distinct s.post_id) posts from (
          select user_id uid, post_id from posts_{sfx} union all
          select user_id, post_id from comments_{sfx}) s
          join v_post_topic pt on pt.post_id = s.post_id
          join v_topic t on t.topic_id = pt.topic_id
          where s.uid in (select uid from a_mark_{tag})
          {'' if topic is None else f'and pt.topic_id = {topic}'} group by 1, 2""",
        f"a_foot_{tag}": f"""select uid, count(*) topic_count,
          arg_max(topic_id, (posts, -topic_id)) top_topic_id,
          arg_max(title, (posts, -topic_id)) top_topic_title from a_topics_{tag} group by 1""",
        f"a_fold_{tag}": "select uid, " + ", ".join(
            f"count(*) filter (where pred_label_id = {i}) emotion_{i}" for i in range(6))
        + f""", count(*) sample_count, {NEG} negative_count,
          count(*) filter (where source_type = 'post') post_count,
          count(*) filter (where source_type = 'comment') comment_count,
          {big('sum(interaction_count)')} interaction_count from a_said_{tag} group by 1""",
        f"a_join_{tag}": f"""select f.*, m.* exclude (uid), coalesce(u.verified, false) verified,
          coalesce(u.profile_tier, 0) profile_tier, coalesce(u.followers_count, 0)
          followers_count, coalesce(t.topic_count, 0) topic_count, t.top_topic_id,
          t.top_topic_title, {ratio('f.negative_count', 'f.sample_count')} neg_share
          from a_fold_{tag} f join a_mark_{tag} m using (uid)
          left join v_user u using (uid) left join a_foot_{tag} t using (uid)""",
        f"a_role_{tag}": f"""select *, list_filter([
          case when is_entry_kol = 1 then 'entry_kol' end,
          case when verified then 'verified_actor' end,
          case when not verified and profile_tier >= 1 and followers_count >= 10000
            then 'high_follower_actor' end,
          case when is_high_inter = 1 then 'high_interaction' end,
          case when is_polar = 1 or (sample_count >= 3 and neg_share >= 0.6)
            then 'negative_polarized' end,
          case when is_active = 1 or sample_count >= 10 then 'active_voice' end,
          case when is_cross_topic = 1 or topic_count >= 3 then 'cross_topic' end],
          lambda x: x is not null) found,
          {rnd('''least(60.0::double * case when interaction_count > 0
            and max(interaction_count) over () > 0 then least(ln(1 + interaction_count::double)
            / ln(1 + (max(interaction_count) over ())::double), 1.0) else 0 end
            + case when profile_tier >= 1 then 25.0::double * case when followers_count > 0
            and max(followers_count) over () > 0 then least(ln(1 + followers_count::double)
            / ln(1 + (max(followers_count) over ())::double), 1.0) else 0 end else 0 end
            + case when verified then 10 else 0 end
            + case when profile_tier >= 1 then 5 else 0 end, 100.0)''', 1)}
          actor_influence_score,
          {rnd(ratio('interaction_count', 'sum(interaction_count) over ()'))}
          interaction_contribution from a_join_{tag}""",
        f"a_name_{tag}": f"""select *, cast(len(found) as int) role_count, case
          when list_contains(found, 'verified_actor') then '认证账号'
          when list_contains(found, 'entry_kol') then 'KOL 入口账号'
          when list_contains(found, 'high_follower_actor') then '高粉账号'
          when list_contains(found, 'high_interaction') then '高互动账号'
          when list_contains(found, 'negative_polarized') then '负面极化账号'
          when list_contains(found, 'cross_topic') then '跨话题账号'
          when list_contains(found, 'active_voice') then '活跃账号' else '普通账号' end prefix
          from a_role_{tag}""",
        f"a_all_{tag}": f"""select *, prefix || ' ' || case when n <= 26 then chr(64 + n::int)
          else n::varchar end display_name from (select *, row_number() over (
          partition by prefix order by role_count desc, actor_influence_score desc,
          sample_count desc, uid) n from a_name_{tag})""",
    })


def ranked_sql(tag: str, limit: int | None = 20) -> str:
    return f"""select 'u_' || substr(sha256(cast(uid as varchar)), 1, 10) actor_id,
      display_name, verified, profile_tier, case when profile_tier < 1 or followers_count <= 0
      then '未覆盖' when followers_count < 10000 then '<1w' when followers_count < 100000
      then '1w-10w' when followers_count < 1000000 then '10w-100w' else '100w+' end
      followers_bucket, topic_count, cast(top_topic_id as varchar) top_topic_id,
      top_topic_title, post_count, comment_count, sample_count,
      {label(DOMINANT)} dominant_emotion, {rnd('neg_share')} negative_ratio, interaction_count,
      interaction_contribution, actor_influence_score,
      case when len(found) = 0 then 'ordinary_actor' else array_to_string(found, ',') end roles,
      role_count, {SIX} from a_all_{tag} order by role_count desc,
      actor_influence_score desc, sample_count desc, uid {"" if limit is None else f"limit {limit}"}"""


actor_views("all", "all")
actor_views("7d", "7d")
actor_views("all", "one", BUSIEST)


@query("act_14", ranked_sql("all"))
def act_14(run):
    return key_actors(run.tables, run.window())


@query("act_14_week", ranked_sql("7d"))
def act_14_week(run):
    return key_actors(run.tables, run.window("7d"))


@query("act_14_topic", ranked_sql("one"))
def act_14_topic(run):
    return key_actors(run.tables, run.window(), busiest(run))


@query("act_01", "select * from a_p95_all")
def act_01(run):
    return a.interaction_p95(run.tables, run.window())


def branch(name: str, marker: str, build) -> None:
    sql = f"select uid from a_cand_all where {marker} = 1"
    query(name, sql)(lambda run: build(run).filter(f"{marker} = 1").select("uid").distinct())


def folded(run):
    return a.fold_actors(a.spoken_samples(run.tables, run.window()))


def authored(run):
    return a.posts_in(run.tables, run.window())


branch("act_02", "is_entry_kol", lambda r: a.entry_kols(r.tables, authored(r)))
branch("act_03", "is_high_inter", lambda r: a.high_interaction(
    authored(r), a.interaction_p95(r.tables, r.window("all"))))
branch("act_04", "is_polar", lambda r: a.polar_and_active(folded(r)))
branch("act_04_active", "is_active", lambda r: a.polar_and_active(folded(r)))
branch("act_05", "is_verified_kol", lambda r: a.identity_kols(r.tables, r.window("all")))
branch("act_06", "is_cross_topic", lambda r: a.cross_topic(r.tables, authored(r)))


@query("act_07", "select * from a_mark_all")
def act_07(run):
    return a.role_markers(run.tables, run.window())


@query("act_08", f"""select uid, pred_label_id, count(*) sample_count,
  count(*) filter (where source_type = 'post') post_count,
  count(*) filter (where source_type = 'comment') comment_count,
  {big('sum(interaction_count)')} interaction_count from a_said_all group by 1, 2""")
def act_08(run):
    return a.actor_emotions(a.spoken_samples(run.tables, run.window()))


@query("act_09", "select * from a_foot_all")
def act_09(run):
    window = run.window()
    run.tables.keep("comment")  # the markers and the footprint read them
    return a.topic_footprint(run.tables, window, a.role_markers(run.tables, window))


@query("act_10", "select * from a_fold_all")
def act_10(run):
    return folded(run)


PROFILE_SQL = "select uid, {0} from a_all_all"


def profile_query(name: str, cols: list[str], sql_cols: str, sfx: str = "all", build=None) -> None:
    def fn(run):
        out = a.actor_profiles(run.tables, run.window())
        return build(out) if build else out.select("uid", *cols)
    query(name, f"select uid, {sql_cols} from a_all_{sfx}")(fn)


profile_query("act_11", ["actor_influence_score"], "actor_influence_score", "all")
profile_query("act_12", ["interaction_contribution"], "interaction_contribution")
profile_query(
    "act_13", [], "case when len(found) = 0 then 'ordinary_actor' else "
    "array_to_string(found, ',') end roles, role_count", "all",
    lambda p: p.select("uid", F.array_join("roles", ",").alias("roles"), "role_count"))
profile_query("act_15", [], "display_name", build=lambda p: a.add_display_names(p).select(
    "uid", "display_name"))


@query("act_16", """select uid, 'u_' || substr(sha256(cast(uid as varchar)), 1, 10) actor_id
  from v_user""")
def act_16(run):
    return run.tables.user.select("uid", a.actor_pseudonym(F.col("uid")).alias("actor_id"))


@query("act_17", f"""select actor_id, display_name, actor_influence_score influence_score,
  negative_ratio, interaction_count, dominant_emotion, top_topic_id topic_id
  from ({ranked_sql('all', None)})""")
def act_17(run):
    profiles = a.actor_profiles(run.tables, run.window())
    return a.influence_points(a.add_display_names(profiles))


ROLE_SQL = """select unnest(case when len(found) = 0 then ['ordinary_actor'] else found end) "role"
  from a_all_all"""


@query("act_18", f'select "role", count(*) actors from ({ROLE_SQL}) group by 1')
def act_18(run):
    return a.role_counts(a.actor_profiles(run.tables, run.window()))


@query("act_18_filter", """select uid from a_all_all
  where list_contains(found, 'entry_kol') or list_contains(found, 'high_interaction')""")
def act_18_filter(run):
    profiles = a.actor_profiles(run.tables, run.window())
    return a.with_any_role(profiles, ["entry_kol", "high_interaction"]).select("uid")
