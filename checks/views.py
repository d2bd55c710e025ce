"""SQL views over the star-schema tables that the twins share."""

from __future__ import annotations

from checks.registry import STABLE_DAY, VIEWS

LABEL_LIST = "['积极', '愤怒', '悲伤', '恐惧', '惊讶', '中性']"
SIX = ", ".join(f"emotion_{i}" for i in range(6))


def rnd(expr: str, digits: int = 4) -> str:
    s = f"1e{digits}"
    return f"(floor(cast({expr} as double) * {s} + 0.5) / {s})"


def ratio(a: str, b: str) -> str:
    return f"coalesce(cast({a} as double) / nullif(cast({b} as double), 0), 0.0)"


def micros(expr: str) -> str:
    return f"cast(floor(cast({expr} as double) * 1000000.0 + 0.5) as bigint)"


def day(expr: str) -> str:
    return f"cast(cast({expr} + interval 8 hours as date) as varchar)"


def iso(expr: str) -> str:
    return f"strftime({expr} + interval 8 hours, '%Y-%m-%dT%H:%M:%S') || '+08:00'"


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def label(expr: str) -> str:
    return f"{LABEL_LIST}[cast({expr} as int) + 1]"


def growth(expr: str) -> str:
    return (f"(case when {expr} >= 0 then '+' else '-' end || "
            f"cast(cast(round_even(abs({expr}) * 100.0, 0) as bigint) as varchar) || '%')")


EMOTIONS = ", ".join(
    f"count(*) filter (where pred_label_id = {i}) emotion_{i}" for i in range(6)) + f""",
  count(*) sample_count,
  count(*) filter (where pred_label_id in (1, 2, 3)) negative_count,
  count(*) filter (where pred_label_id in (1, 3)) anger_fear_count,
  {big('sum(' + micros('confidence') + ')')} confidence_micros"""

DOMINANT = ("list_position([" + SIX + "], list_max([" + SIX + "])) - 1")

VIEWS.update({
    "v_user": """select c_custkey + 1 uid, c_mktsegment = 'BUILDING' verified,
      c_nationkey % 3 profile_tier,
      cast(floor(greatest(c_acctbal, 0) * 20) as bigint) followers_count from customer""",
    "v_post": """select o_orderkey + 1 post_id, o_custkey + 1 user_id, o_orderdate created_at,
      o_orderdate first_crawled_at,
      case when o_orderkey % 10 = 9 then o_orderkey - 8 else 0 end retweet_of,
      concat(o_orderpriority, ' ', o_orderstatus) text_raw from orders""",
    "v_comment_raw": """select l_orderkey * 10 + l_linenumber comment_id, l_orderkey + 1 post_id,
      l_partkey % (select count(*) from customer) + 1 user_id,
      cast(l_quantity as bigint) like_count, l_shipdate created_at, l_partkey, l_suppkey,
      l_returnflag, l_linestatus from lineitem""",
    "v_comment": """select comment_id, post_id, user_id, like_count, created_at,
      concat('reply ', l_returnflag, l_linestatus) text_raw from (select *, row_number() over (
      partition by comment_id order by created_at desc, l_partkey desc, l_suppkey desc,
      like_count desc, l_returnflag desc, l_linestatus desc) rn from v_comment_raw) x
      where rn = 1""",
    "v_topic": """select p_partkey + 1 topic_id, p_name title, p_type lead,
      cast(floor(p_retailprice) as bigint) read_count, cast(p_size as bigint) discuss_count,
      timestamp '1992-01-01' + to_days(cast(p_size as int)) first_seen_at,
      timestamp '1998-01-01' + to_days(cast(p_size as int)) last_seen_at from part""",
    "v_post_topic": """select distinct l_orderkey + 1 post_id, l_partkey + 1 topic_id
      from lineitem""",
    "v_discovery": """select l_orderkey + 1 post_id,
      case when l_orderkey % 97 = 0 and l_linenumber % 2 = 0 then 'retweet'
      when l_orderkey % 41 = 0 and l_linenumber % 3 = 0 then 'kol'
      when l_linenumber % 2 = 0 then 'hot' else 'keyword' end source_type,
      cast(l_suppkey as varchar) source_value, l_shipdate discovered_at from lineitem""",
    "v_engagement": """select l_orderkey + 1 post_id, l_shipdate captured_at,
      max(cast(l_quantity as bigint)) comments_count,
      max(cast(floor(l_extendedprice / 100) as bigint)) attitudes_count,
      max(cast(l_linenumber as bigint)) reposts_count from lineitem group by 1, 2""",
    "v_source": """select 'post' source_type, post_id source_id, post_id, created_at from v_post
      union all select 'comment' source_type, comment_id source_id, post_id, created_at
      from v_comment""",
    "v_prediction": """select source_type, source_id, post_id, created_at source_created_at,
      'primary' model_version, h % 6 pred_label_id, (h + 2) % 6 second_label_id,
      cast(0.4 as double) + cast(h % 60 as double) / 100 confidence,
      cast(h % 50 as double) / 100 margin from (select *, (source_id * 7919 +
      case source_type when 'post' then 17 else 91 end) % 1000 h from v_source) a
      union all
      select source_type, source_id, post_id, created_at, 'secondary',
      case when h % 5 = 0 then (h + 1) % 6 else h % 6 end, (h + 3) % 6,
      cast(0.4 as double) + cast((h * 7) % 60 as double) / 100,
      cast((h * 3) % 50 as double) / 100 from (select *, (source_id * 7919 +
      case source_type when 'post' then 17 else 91 end) % 1000 h from v_source) b""",
    "v_text": """select d.doc_id id, d.text content, d.lang, d.source,
      cast(case when l.doc_id is null then 5 when l.toxic = 1 then 1 when l.quality = 0 then 2
      else d.doc_id % 6 end as bigint) label_id, case when d.doc_id % 10 < 7 then 'train'
      when d.doc_id % 10 = 7 then 'eval' else 'test' end split
      from documents d left join labels l on l.doc_id = d.doc_id""",
    "v_text_noisy": """select id, concat('RT ', content, ' http://ex.am/p', cast(id as varchar),
      ' //@user', cast(id as varchar), ': #Topic ', cast(id % 7 as varchar), '# @Name_',
      cast(id as varchar), '  [wow]') content, label_id, split from v_text""",
    "v_annotation_primary": """select id, concat('s-', cast(id as varchar)) sample_id, content,
      label_id primary_label_id,
      cast(0.5 as double) + cast(id % 50 as double) / 100 primary_confidence,
      id % 11 = 0 primary_needs_review from v_text""",
    "v_annotation_review": """select concat('s-', cast(id as varchar)) sample_id,
      case when id % 4 = 0 then (label_id + 1) % 6 else label_id end review_label_id,
      cast(0.6 as double) + cast(id % 40 as double) / 100 review_confidence,
      id % 13 = 0 review_needs_review from v_text where id % 3 <> 0""",
    # data window and its ranges
    "w_base": f"""select coalesce(
      (select min(d) from (select cast(first_crawled_at + interval 8 hours as date) d, count(*) n
        from v_post group by 1) where n >= {STABLE_DAY})::timestamp - interval 8 hours,
      (select min(first_crawled_at) from v_post)) start_ts,
      (select max(created_at) from v_post) end_ts""",
})


def window_view(name: str, seconds: int | None) -> None:
    start = "start_ts" if seconds is None else (
        f"greatest(start_ts, end_ts - interval {seconds} seconds)")
    VIEWS[name] = f"""select start_ts, end_ts, start_ts + to_seconds(cast(floor(
      (epoch(end_ts) - epoch(start_ts)) / 2) as bigint)) mid_ts
      from (select {start} start_ts, end_ts from w_base)"""


window_view("w_all", None)
window_view("w_7d", 7 * 86400)
window_view("w_24h", 86400)
window_view("w_365d", 365 * 86400)

for suffix, w in (("all", "w_all"), ("365d", "w_365d"), ("7d", "w_7d"), ("24h", "w_24h")):
    VIEWS.update({
        f"p_{suffix}": f"""select p.* from v_prediction p, {w} w where model_version = 'primary'
          and source_created_at between w.start_ts and w.end_ts""",
        f"posts_{suffix}": f"""select p.* from v_post p, {w} w
          where created_at between w.start_ts and w.end_ts""",
        f"comments_{suffix}": f"""select p.* from v_comment p, {w} w
          where created_at between w.start_ts and w.end_ts""",
        f"eng_{suffix}": f"""select e.* from v_engagement e, {w} w
          where captured_at between w.start_ts and w.end_ts""",
        f"latest_{suffix}": f"""select post_id, arg_max(comments_count + attitudes_count
          + reposts_count, captured_at) interaction_count from eng_{suffix} group by 1""",
    })
