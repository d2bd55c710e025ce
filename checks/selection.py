"""SEL-* and ML-*: candidate selection, dataset assembly, scoring, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from checks.registry import VIEWS, query
from checks.text import WORDS
from checks.views import LABEL_LIST, big, day, label, ratio, rnd
from tidemark.functions.labels import label_name
from tidemark.functions.numeric import local_day, micros, round_to
from tidemark.functions.text import clean_text
from tidemark.operators import annotation as an
from tidemark.operators import assembly as asm
from tidemark.operators import evaluation as ev
from tidemark.operators import mining as mi
from tidemark.operators import scoring as sc
from tidemark.operators.dedupe import keep_first
from tidemark.operators.quality import dedupe_content

SEED = "md5('42|' || {0}::varchar)"


def named(df):
    return df.withColumn("label", label_name(F.col("label_id")))


@query("sel_01", f"""select printf('smp-usual-%s-conflict-%05d', split, row_number() over (
  partition by split order by content)) sample_id, content, to_json(list_sort(labels))::varchar
  raw_labels, 100::bigint priority from (select split, content, list(distinct
  {label('label_id')}) labels from v_text group by 1, 2) where len(labels) > 1""")
def sel_01(run):
    return asm.conflict_candidates(named(run.tables.text)).select(
        "sample_id", "content", "raw_labels", "priority")


VIEWS["v_labsample"] = f"""select printf('smp-usual-%s-%d-%05d', split, label_id, n) sample_id,
  'smp_processed_label_sample' source, split, content, {label('label_id')} current_label,
  case when label_id in (3, 4) then 'minority_label_sample' else 'boundary_label_sample' end
  candidate_reason, case when label_id in (3, 4) then 80 else 60 end::bigint priority from (
  select *, row_number() over (partition by split, label_id order by {SEED.format('id')}, id) n
  from v_text) where n <= 20"""


@query("sel_02", "select * exclude (content, source) from v_labsample")
def sel_02(run):
    return asm.label_samples(run.tables.text, 20).select(
        "sample_id", "split", "current_label", "candidate_reason", "priority")


VIEWS["v_conflict"] = f"""select printf('smp-usual-%s-conflict-%05d', split, row_number() over (
  partition by split order by content)) sample_id, 'smp_raw_conflict' source, content,
  100::bigint priority from (select split, content, count(distinct label_id) n from v_text
  group by 1, 2) where n > 1"""


@query("sel_03", """select sample_id, source, priority, row_number() over (order by
  priority desc, source, sample_id) candidate_rank from (select *, row_number() over (
  partition by content order by priority desc, source, sample_id) rn from (
  select sample_id, source, content, priority from v_conflict union all
  select sample_id, source, content, priority from v_labsample)) where rn = 1""")
def sel_03(run):
    texts = named(run.tables.text)
    merged = asm.merge_candidates(asm.conflict_candidates(texts), asm.label_samples(texts, 20))
    return merged.select("sample_id", "source", "priority", "candidate_rank")


@query("sel_04", f"select id from v_text order by {SEED.format('id')}, id limit 100")
def sel_04(run):
    from tidemark.operators.ranking import sample_rows
    return sample_rows(run.tables.text, 100, "id").select("id")


BAND = """(select id, "content" from (select *, row_number() over (partition by "content"
  order by id) rn from v_clean where length("content") between 4 and 512) where rn = 1)"""


@query("sel_05", f"""select printf('business_post-%07d', row_number() over (order by id)) sample_id,
  id::varchar source_id, "content", 50::bigint priority from {BAND}""")
def sel_05(run):
    return asm.business_candidates(run.tables.text_noisy, "post").select(
        "sample_id", "source_id", "content", "priority")


@query("sel_05_sample", f"""select printf('business_post-%07d', row_number() over (
  order by {SEED.format('id')}, id)) sample_id, id::varchar source_id from (
  select * from {BAND} order by {SEED.format('id')}, id limit 200)""")
def sel_05_sample(run):
    return asm.business_candidates(run.tables.text_noisy, "post", sample_size=200).select(
        "sample_id", "source_id")


# ------------------------------------------------------------------ adjudication
VIEWS["v_adj0"] = """select p.*, r.review_label_id, r.review_confidence, r.review_needs_review,
  case when not coalesce(primary_needs_review, false) and primary_confidence >= 0.75
    then 'auto_accept_primary_high_conf'
  when review_label_id is null then 'human_required_no_review'
  when primary_label_id = review_label_id and review_confidence >= 0.70
    then 'auto_accept_two_model_agree'
  when review_confidence >= 0.85 and not coalesce(review_needs_review, false)
    then 'auto_accept_review_high_conf'
  else 'human_required_disagree_or_low_conf' end adjudication_status
  from v_annotation_primary p left join v_annotation_review r using (sample_id)"""
VIEWS["v_adj"] = """select *, case when adjudication_status in ('auto_accept_primary_high_conf',
  'human_required_no_review') then primary_label_id else review_label_id end
  adjudicated_label_id, coalesce(primary_label_id = review_label_id, false)
  primary_review_agree, case when id % 10 < 7 then 'train' when id % 10 = 7 then 'eval'
  else 'test' end split from v_adj0"""
VIEWS["v_acc"] = """select * exclude (rn) from (select id, content, split, adjudicated_label_id,
  adjudication_status, row_number() over (partition by content order by id) rn from v_adj
  where starts_with(adjudication_status, 'auto_accept')) where rn = 1"""


def adjudicated(run):
    t = run.tables
    merged = an.adjudicate(t.annotation_primary, t.annotation_review)
    return merged.join(t.text.select("id", "split"), "id")


def accepted(run):
    return keep_first(an.accepted(adjudicated(run)), ["content"], ["id"])


@query("sel_06", f"""with f as (select *, row_number() over (partition by adjudicated_label_id
  order by {SEED.format('id')}, id) r from v_acc), a as (select id from (select id, row_number()
  over (order by adjudicated_label_id, r) n from f where r <= 20) where n <= 200),
  b as (select id from v_acc where id not in (select id from a)
  order by {SEED.format('id')}, id limit (select 200 - count(*) from a))
  select id from a union all select id from b""")
def sel_06(run):
    return asm.eval_sample(accepted(run), 200, 20, label="adjudicated_label_id").select("id")


@query("sel_07", "select id, adjudicated_label_id from v_acc")
def sel_07(run):
    return accepted(run).select("id", "adjudicated_label_id")


VIEWS["v_evalids"] = f"""select id, content from v_acc order by {SEED.format('id')}, id limit 150"""


@query("sel_08", "select id from v_acc where content not in (select content from v_evalids)")
def sel_08(run):
    from tidemark.operators.ranking import sample_rows
    rows = accepted(run)
    return asm.train_pool(rows, sample_rows(rows, 150, "id")).select("id")


@query("sel_09", f"""select id from (select *, row_number() over (partition by label_id
  order by {SEED.format('id')}, id) r from v_text) where r <= 60
  order by {SEED.format('id')}, id limit 250""")
def sel_09(run):
    return asm.cap_labels(run.tables.text, 60, 250).select("id")


@query("sel_10", """with t as (select source, count(*) target from documents group by 1),
  f as (select *, greatest(1, floor(target * 2200 / 7500)) a, greatest(1, floor(target * 1800
  / 7500)) b, greatest(1, floor(target * 2500 / 7500)) c, greatest(1, floor(target * 1000
  / 7500)) d from t), g as (select *, greatest(0, target - (a + b + c + d)) r from f)
  select source, target, bucket, cast(quota as bigint) quota from (
  select source, target, 'fear' bucket, a + floor(r / 4) + (r % 4 > 0)::int quota from g
  union all select source, target, 'surprise', b + floor(r / 4) + (r % 4 > 1)::int from g
  union all select source, target, 'anger_sad_boundary', c + floor(r / 4) + (r % 4 > 2)::int from g
  union all select source, target, 'hard_negative', d + floor(r / 4) + (r % 4 > 3)::int from g)""")
def sel_10(run):
    targets = run.tables.documents.groupBy("source").agg(F.count("*").alias("target"))
    return mi.allocate_quotas(targets)


BASE_H = "case target_bucket " + " ".join(
    f"when '{b}' then {v}" for b, v in mi.HEURISTIC_BASE.items()) + " end"
VIEWS["v_heur"] = f"""select *, case when id % 3 = 0 then 'comment' else 'post' end source,
  cast({BASE_H} + case when length(content) between 12 and 180 then 16
  when length(content) between 6 and 260 then 8 else 0 end + case when id % 3 = 0 then 4 else 0 end
  + least(keyword_count, 6) * 4 as bigint) heuristic_score from v_bucket"""


def heuristic(run):
    found = mi.add_buckets(run.tables.text, WORDS).withColumn(
        "source", F.when(F.col("id") % 3 == 0, "comment").otherwise("post"))
    return found.withColumn("heuristic_score", mi.heuristic_score())


@query("sel_11", "select id, heuristic_score from v_heur")
def sel_11(run):
    return heuristic(run).select("id", "heuristic_score")


def quota_case(target: int) -> str:
    return "case target_bucket " + " ".join(
        f"when '{b}' then {n}" for b, n in mi.quotas_for(target).items()) + " end"


def quota_sql(view: str, target: int, order: str) -> str:
    return f"""(with q as (select *, row_number() over (partition by target_bucket order by {order})
      r from {view}), a as (select * exclude (r) from q where r <= {quota_case(target)}),
      b as (select * from {view} where id not in (select id from a) order by {order}
      limit (select {target} - count(*) from a)) select * from a union all select * from b)"""


@query("sel_12", f"""select id, target_bucket from
  {quota_sql('v_heur', 300, 'heuristic_score desc, id')}""")
def sel_12(run):
    return mi.cap_before_scoring(heuristic(run), 300, "id").select("id", "target_bucket")


LETTERS = "aeionr"


def letter_scorer(texts: list[str]) -> np.ndarray:
    """Ten times the share of six letters: a stand-in model with a SQL twin."""
    return np.array([[10.0 * t.count(c) / max(len(t), 1) for c in LETTERS] for t in texts])


def logit(i: int, text: str = "content") -> str:
    c = LETTERS[i]
    return (f"10.0::double * (length({text}) - length(replace({text}, '{c}', '')))"
            f" / greatest(length({text}), 1)")


LOGITS = "[" + ", ".join(logit(i) for i in range(6)) + "]"


def probs_sql(source: str, logits: str = LOGITS) -> str:
    """Relation ``source`` with probs, top ids and margin."""
    return f"""(select *, probs[top + 1] confidence, probs[sec + 1] second_prob,
      probs[top + 1] - probs[sec + 1] margin from (select *, list_position(probs, list_reverse_sort(
      probs)[1]) - 1 top, list_position(list_transform(range(len(probs)), lambda k:
      case when k = list_position(probs, list_reverse_sort(probs)[1]) - 1 then -1.0::double
      else probs[k + 1] end), list_reverse_sort(list_transform(range(len(probs)), lambda k:
      case when k = list_position(probs, list_reverse_sort(probs)[1]) - 1 then -1.0::double
      else probs[k + 1] end))[1]) - 1 sec from (select *, list_transform(e, lambda x:
      x / list_sum(e)) probs from (select *, list_transform(l, lambda x: exp((x - list_max(l))
      ::double)) e from (select *, {logits} l from {source})))))"""


VIEWS["v_scored"] = f"select * from {probs_sql('v_heur')}"


def scored(run):
    found = sc.score_texts(heuristic(run), letter_scorer)
    return mi.add_model_scores(found.withColumn("probs", sc.softmax(F.col("logits"))))


MATCH = ("case target_bucket " + " ".join(
    f"when '{b}' then top in ({', '.join(map(str, i))})" for b, i in mi.BUCKET_LABEL_IDS.items())
    + " end")
TARGET = ("case target_bucket " + " ".join(
    f"when '{b}' then greatest({', '.join(f'probs[{k + 1}]' for k in i)})"
    for b, i in mi.BUCKET_LABEL_IDS.items()) + " end")
BASE_S = "case target_bucket " + " ".join(
    f"when '{b}' then {v}.0::double" for b, v in mi.SELECTION_BASE.items()) + " end"
RARE = "(top in (3, 4) and confidence < 0.85)"


def gap(x: str) -> str:
    return f"(1.0::double - least(greatest({x}, 0.0::double), 1.0::double))"


VIEWS["v_sel0"] = f"""select *, {MATCH} hit, {TARGET} target_max from v_scored"""
VIEWS["v_sel"] = f"""select *, {rnd(f'''{BASE_S} + {gap('margin')} * 45.0 + {gap('confidence')}
  * 25.0 + {gap('target_max')} * 18.0 + case when not hit then 22.0 else 0.0 end
  + case when {RARE} then 20.0 else 0.0 end + least(keyword_count, 8) * 3.0''', 6)}
  selection_score, coalesce(nullif(concat_ws(',', case when margin <= 0.20 then 'low_margin' end,
  case when confidence <= 0.70 then 'low_conf' end, case when not hit then
  'keyword_model_mismatch' end, case when {RARE} then 'rare_pred_uncertain' end), ''),
  'keyword_targeted') selection_flags from v_sel0"""


@query("sel_13", """select id, selection_score, cast(round_even(selection_score, 0) as bigint)
  priority from v_sel""")
def sel_13(run):
    return mi.add_selection_scores(scored(run)).select("id", "selection_score", "priority")


@query("sel_14", "select id, selection_flags from v_sel")
def sel_14(run):
    return mi.add_selection_scores(scored(run)).select("id", "selection_flags")


@query("sel_15", f"""select id, {rnd(f'''{BASE_S} + 0.0 * 45.0 + 1.0 * 25.0 + 1.0 * 18.0 + 22.0
  + least(keyword_count, 8) * 3.0''', 6)} selection_score,
  'low_conf,keyword_model_mismatch' selection_flags from v_heur""")
def sel_15(run):
    plain = mi.add_selection_scores(mi.fallback_scores(heuristic(run)))
    return plain.select("id", "selection_score", "selection_flags")


@query("sel_16", f"select id, {rnd('target_max', 6)} target_max_prob, hit model_target_match "
       "from v_sel")
def sel_16(run):
    return scored(run).select("id", round_to(F.col("target_max_prob"), 6)
                              .alias("target_max_prob"), "model_target_match")


# the operator fails when there are fewer candidates, and the smallest tables hold 200 texts
FINAL = 100


@query("sel_17", f"""select id, row_number() over (order by selection_score desc, margin, id)
  candidate_rank, printf('business-targeted-%07d', row_number() over (order by selection_score
  desc, margin, id)) sample_id, 'business_targeted_' || source source, target_bucket from
  {quota_sql('v_sel', FINAL, 'selection_score desc, margin, id')}""")
def sel_17(run):
    final = mi.select_final(mi.add_selection_scores(scored(run)), FINAL, "id")
    return final.select("id", F.col("candidate_rank").cast("bigint").alias("candidate_rank"),
                        "sample_id", "source", "target_bucket")


@query("sel_18", """select id from v_annotation_primary where coalesce(primary_needs_review,
  false) or primary_confidence < 0.75""")
def sel_18(run):
    return an.review_queue(run.tables.annotation_primary).select("id")


VIEWS["v_reviews2"] = """select sample_id, review_label_id, 1 seq from v_annotation_review
  union all select sample_id, (review_label_id + 1) % 6, 2 from v_annotation_review
  where review_label_id > 2"""


@query("sel_19", """select sample_id, review_label_id, seq from (select *, row_number() over (
  partition by sample_id order by seq desc) rn from v_reviews2) where rn = 1""")
def sel_19(run):
    once = run.tables.annotation_review.select("sample_id", "review_label_id")
    again = once.filter("review_label_id > 2").selectExpr(
        "sample_id", "(review_label_id + 1) % 6 review_label_id", "2 seq")
    log = once.withColumn("seq", F.lit(1)).unionByName(again)
    return an.latest_reviews(log, "seq")


@query("sel_20", """select id, adjudicated_label_id, adjudication_status, primary_review_agree
  from v_adj""")
def sel_20(run):
    return adjudicated(run).select("id", "adjudicated_label_id", "adjudication_status",
                                   "primary_review_agree")


@query("sel_21", "select adjudication_status, count(*) n from v_adj group by 1")
def sel_21(run):
    return an.status_counts(adjudicated(run))


# contents that got exactly one label, as the relabel map requires
VIEWS["v_sound"] = """select a.* from v_adj a where content in (select content from v_adj
  where split = 'train' and starts_with(adjudication_status, 'auto_accept') group by 1
  having count(distinct adjudicated_label_id) = 1)"""
VIEWS["v_relabel"] = """select content, min(adjudicated_label_id) new_label_id from v_sound
  where split = 'train' and starts_with(adjudication_status, 'auto_accept') group by 1"""


def relabels(run):
    adj = adjudicated(run)
    good = an.accepted(adj.filter("split = 'train'")).groupBy("content").agg(
        F.min("adjudicated_label_id").alias("lo"), F.max("adjudicated_label_id").alias("hi"))
    sound = adj.join(good.filter("lo = hi").select("content"), "content", "left_semi")
    return an.relabel_map(sound, "train")


@query("sel_22", "select content, new_label_id from v_relabel")
def sel_22(run):
    return relabels(run)


VIEWS["v_relabelled"] = """select t.id, t.split, t.label_id old_label_id, case when
  t.split = 'train' then coalesce(m.new_label_id, t.label_id) else t.label_id end label_id
  from v_text t left join v_relabel m using (content)"""


def relabelled(run):
    train = run.tables.text.filter("split = 'train'")
    return an.apply_relabels(train, relabels(run))


@query("sel_23", """select id, split, old_label_id, label_id from v_relabelled
  where split = 'train' and old_label_id <> label_id""")
def sel_23(run):
    return an.label_changes(relabelled(run)).select("id", "split", "old_label_id", "label_id")


@query("sel_24", """select split, old_label_id, label_id, count(*) n from v_relabelled
  where split = 'train' and old_label_id <> label_id group by 1, 2, 3""")
def sel_24(run):
    return an.change_matrix(an.label_changes(relabelled(run)))


VIEWS["v_blocked"] = "select content from v_text where split in ('eval', 'test')"
VIEWS["v_pool"] = "select id, content, label_id from v_split_first where split = 'train'"
VIEWS["v_fresh"] = """select id, content, adjudicated_label_id label_id from v_acc
  where content not in (select content from v_blocked)"""


@query("sel_25", """select id, label_id from (select *, row_number() over (partition by content
  order by s, id) rn from (select *, 0 s from v_pool union all select *, 1 from v_fresh))
  where rn = 1""")
def sel_25(run):
    text = run.tables.text
    existing = dedupe_content(text, "id", ("split",)).filter(
        "split = 'train'").select("id", "content", "label_id")
    fresh = accepted(run).select("id", "content", F.col("adjudicated_label_id").alias("label_id"))
    blocked = text.filter("split in ('eval', 'test')")
    return asm.second_round_pool(existing, fresh, blocked).select("id", "label_id")


VIEWS["v_capped"] = f"""select id, content, label_id from (select *, row_number() over (
  partition by label_id order by {SEED.format('id')}, id) r from v_fresh) where r <= 40"""


@query("sel_26", f"""select id, {label('label_id')} "label", label_id from (select *, row_number()
  over (partition by content order by s, id) rn from (select *, 0 s from v_pool union all
  select *, 1 from v_capped)) where rn = 1""")
def sel_26(run):
    text = run.tables.text
    base = dedupe_content(text, "id", ("split",)).filter(
        "split = 'train'").select("id", "content", "label_id")
    business = accepted(run).select(
        "id", "content", F.col("adjudicated_label_id").alias("label_id"))
    mixed = asm.mixed_training(base, business, text.filter("split = 'eval'"),
                               text.filter("split = 'test'"), per_label=40)
    return asm.with_label_names(mixed).select("id", "label", "label_id")


@query("sel_27", f"""select content, {label('label_id')} "label", label_id from v_text""")
def sel_27(run):
    return an.to_training_rows(named(run.tables.text))


@query("sel_28", "select id from v_annotation_primary where id % 3 = 0 or id % 13 = 0")
def sel_28(run):
    log = run.tables.annotation_review.withColumn("status", F.when(
        F.col("review_needs_review"), "error").otherwise("ok"))
    return an.pending(run.tables.annotation_primary, log).select("id")


@query("sel_29", """select id, case when primary_confidence between 0.55 and 0.9 then 'ok'
  else 'error' end status from v_annotation_primary""")
def sel_29(run):
    inside = F.col("primary_confidence").between(0.55, 0.9)
    marked = run.tables.annotation_primary.withColumn(
        "error", F.when(~inside, "confidence"))
    good, bad = an.route(marked)
    return good.select("id", "status").unionByName(bad.select("id", "status"))


@query("sel_30", """select id, '样本上下文：{"id":' || id || ',"split":"' || split ||
  '","label_id":' || label_id || '}' || chr(10) || '文本：' || content prompt from v_text""")
def sel_30(run):
    prompt = an.prompt_context(run.tables.text, ["id", "split", "label_id", "track"])
    return run.tables.text.select("id", prompt.alias("prompt"))


# --------------------------------------------------------------------- evaluation
@query("ml_01", f"""select source_type, source_id, pred_label, second_label,
  {rnd('confidence', 6)} confidence, {rnd('margin', 6)} margin, content_hash from (
  select *, {LABEL_LIST}[top + 1] pred_label, {LABEL_LIST}[sec + 1] second_label,
  substr(sha256("content"), 1, 16) content_hash from {probs_sql('''(select 'post' source_type,
  id source_id, "content" from v_clean where id % 5 <> 0 and length("content") > 0)''')})""")
def ml_01(run):
    sources = run.tables.text_noisy.selectExpr(
        "'post' source_type", "id source_id", "id post_id",
        "timestamp_ntz '2024-01-01 00:00:00' source_created_at", "content text_raw")
    done = run.tables.text.filter("id % 5 = 0").selectExpr(
        "'post' source_type", "id source_id", "'letters' model_version")
    out = sc.score_sources(sources, done, letter_scorer, "letters", "letters", "memory")
    return out.select("source_type", "source_id", "pred_label", "second_label",
                      round_to(F.col("confidence"), 6).alias("confidence"),
                      round_to(F.col("margin"), 6).alias("margin"), "content_hash")


@query("ml_02", f"""select vec_id, cast(top as int) pred_label_id, cast(sec as int)
  second_label_id, {rnd('confidence', 6)} confidence, {rnd('second_prob', 6)} second_prob,
  {rnd('margin', 6)} margin from {probs_sql('embeddings', 'embedding')}""")
def ml_02(run):
    vectors = run.tables.embeddings.withColumn("probs", sc.softmax(F.col("embedding")))
    top = sc.add_top_two(vectors)
    return top.select("vec_id", "pred_label_id", "second_label_id", *[
        round_to(F.col(c), 6).alias(c) for c in ("confidence", "second_prob", "margin")])


PROBS = sc.PROB_COLUMNS


@query("ml_03", "select id source_id, " + ", ".join(
    rnd(f"probs[{i + 1}]", 6) + f" {c}" for i, c in enumerate(PROBS))
    + f""" from {probs_sql("(select id, content from v_text)")}""")
def ml_03(run):
    texts = run.tables.text.selectExpr(
        "'post' source_type", "id source_id", "id post_id",
        "timestamp_ntz '2024-01-01 00:00:00' source_created_at", "content")
    rows = sc.prediction_rows(sc.score_texts(texts, letter_scorer), "letters", "v1", "memory")
    return rows.select("source_id", *[round_to(F.col(c), 6).alias(c) for c in PROBS])


@query("ml_04", f"""select label_id, count(*) n, {rnd('(select count(*) from v_text)::double '
  '/ (6.0::double * count(*))', 6)} weight from v_text group by 1""")
def ml_04(run):
    return sc.class_weights(run.tables.text).withColumn("weight", round_to(F.col("weight"), 6))


@query("ml_05")
def ml_05(run):
    """Train on the train split, predict every text; no SQL twin."""
    text = run.tables.text.select("id", "content", "label_id", "split")
    model = sc.train_classifier(text.filter("split = 'train'"))
    scored = sc.classify(model, text)
    return scored.groupBy("split").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("label_id") == F.col("pred_label_id")).alias("hits"))


VIEWS["v_pred"] = """select id, label_id, case when id % 4 = 0 then (label_id + 1) % 6
  else label_id end pred_label_id, case when id % 3 = 0 then (label_id + 2) % 6 when id % 4 = 0
  then (label_id + 1) % 6 else label_id end b_pred_id from v_text"""


def predicted(run):
    return run.tables.text.selectExpr(
        "id", "content", "label_id",
        "case when id % 4 = 0 then (label_id + 1) % 6 else label_id end pred_label_id",
        """case when id % 3 = 0 then (label_id + 2) % 6 when id % 4 = 0 then (label_id + 1) % 6
           else label_id end b_pred_id""")


MATRIX = """select i::int true_id, j::int pred_id, (select count(*) from v_pred
  where label_id = i and pred_label_id = j) n from range(6) a(i), range(6) b(j)"""
VIEWS["v_matrix"] = MATRIX
VIEWS["v_classes"] = f"""select i::int label_id, hits, support, predicted,
  {ratio('hits', 'predicted')} "precision", {ratio('hits', 'support')} recall,
  {ratio('hits * 2', '(support + predicted)')} f1 from (select i,
  (select count(*) from v_pred where label_id = i and pred_label_id = i) hits,
  (select count(*) from v_pred where label_id = i) support,
  (select count(*) from v_pred where pred_label_id = i) predicted from range(6) t(i))"""


@query("ml_06", "select * from v_matrix")
def ml_06(run):
    return ev.confusion_matrix(predicted(run))


@query("ml_07", f"""select count(*) samples, {rnd(ratio('count(*) filter (where label_id = '
  'pred_label_id)', 'count(*)'), 6)} accuracy from v_pred""")
def ml_07(run):
    return ev.accuracy(predicted(run))


@query("ml_08", f"""select label_id, support, {rnd('"precision"', 6)} "precision",
  {rnd('recall', 6)} recall, {rnd('f1', 6)} f1 from v_classes""")
def ml_08(run):
    classes = ev.per_class(ev.confusion_matrix(predicted(run)))
    return classes.select("label_id", "support", *[
        round_to(F.col(c), 6).alias(c) for c in ("precision", "recall", "f1")])


@query("ml_09", f"""select {rnd('avg(f1) filter (where support > 0 or predicted > 0)', 6)} macro_f1
  from v_classes""")
def ml_09(run):
    return ev.macro_f1(ev.per_class(ev.confusion_matrix(predicted(run))))


@query("ml_10", f"""select {rnd(ratio(big('sum(cast(floor(-ln(probs[cast(label_id as int) + 1]) '
  '* 1000000.0 + 0.5) as bigint))'), 'count(*) * 1000000.0'), 4)} loss
  from {probs_sql('v_text')}""")
def ml_10(run):
    texts = sc.score_texts(run.tables.text.select("id", "content", "label_id"), letter_scorer)
    return ev.mean_cross_entropy(texts.withColumn("probs", sc.softmax(F.col("logits"))))


@query("ml_11", """select * from v_matrix where true_id <> pred_id and n > 0
  order by n desc, true_id, pred_id limit 3""")
def ml_11(run):
    return ev.top_confusions(ev.confusion_matrix(predicted(run)))


def compared(run):
    return ev.compare_models(predicted(run), "pred_label_id", "b_pred_id")


VIEWS["v_cases"] = """select *, pred_label_id = label_id a_ok, b_pred_id = label_id b_ok,
  pred_label_id = b_pred_id same, case when pred_label_id = label_id and b_pred_id = label_id
  then 'both_correct' when pred_label_id = label_id then 'a_only_correct'
  when b_pred_id = label_id then 'b_only_correct' else 'both_wrong' end case_type from v_pred"""


@query("ml_12", "select id, case_type, same agree from v_cases")
def ml_12(run):
    return compared(run).select("id", "case_type", "agree")


def share(test: str, base: str = "count(*)") -> str:
    return rnd(ratio(f"count(*) filter (where {test})", base), 6)


DIFFER = "count(*) filter (where not same)"


@query("ml_13", f"""select count(*) samples, {share('a_ok')} a_accuracy, {share('b_ok')}
  b_accuracy, count(*) filter (where same) agreement_count, {share('same')} agreement_rate,
  {DIFFER} disagreement_count, {share('not same')} disagreement_rate, """ + ", ".join(
    f"count(*) filter (where case_type = '{c}') {c}" for c in ev.CASES)
    + f""", {share('a_ok or b_ok')} oracle_accuracy,
  {share('not same and a_ok', DIFFER)} disagreement_a_accuracy,
  {share('not same and b_ok', DIFFER)} disagreement_b_accuracy from v_cases""")
def ml_13(run):
    return ev.disagreement_summary(compared(run))


@query("ml_14", """select i::int label_id, (select count(*) from v_cases where label_id = i
  and case_type = 'b_only_correct') n from range(6) t(i)""")
def ml_14(run):
    return ev.second_only_by_label(compared(run))


# a run log derived from events: type -> model, user parity -> track, day -> time stamp
VIEWS["v_runs"] = f"""select event_type || '-' || case when user_id % 2 = 0 then 'usual' else 'virus'
  end || '-' || strftime(ts, '%Y%m%d') name, event_type model, case when user_id % 2 = 0
  then 'usual' else 'virus' end track, strftime(ts, '%Y%m%d') "timestamp", {rnd(
    ratio("sum(cast(floor(value * 1000000.0 + 0.5) as bigint))", "count(*) * 1000000.0"), 4)}
  test_macro_f1 from events group by 1, 2, 3, 4"""
VIEWS["v_epochs"] = f"""select event_type name, cast(date_diff('day', timestamp '2024-01-01',
  ts) + 1 as int) epoch, {rnd(ratio("sum(cast(floor(value * 1000000.0 + 0.5) as bigint))",
    "count(*) * 1000000.0"), 4)} macro_f1, count(*) train_time_s,
  count(distinct user_id) eval_time_s from events group by 1, 2"""


def mean_value():
    return round_to(F.sum(micros(F.col("value"))) / (F.count("*") * F.lit(1000000.0)), 4)


def runs(run):
    track = F.when(F.col("user_id") % 2 == 0, "usual").otherwise("virus")
    return run.tables.events.groupBy(
        F.col("event_type").alias("model"), track.alias("track"),
        F.date_format("ts", "yyyyMMdd").alias("timestamp"),
    ).agg(mean_value().alias("test_macro_f1")).withColumn(
        "name", F.concat_ws("-", "model", "track", "timestamp"))


def epochs(run):
    at = (F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) + 1).alias("epoch")
    users = run.tables.events.groupBy(F.col("event_type").alias("name"), at, "user_id").agg(
        F.count("*").alias("n"), F.sum(micros(F.col("value"))).alias("v"))
    return users.groupBy("name", "epoch").agg(
        round_to(F.sum("v") / (F.sum("n") * F.lit(1000000.0)), 4).alias("macro_f1"),
        F.sum("n").alias("train_time_s"), F.count("*").alias("eval_time_s"))


@query("ml_17", """select name, model, track, "timestamp", test_macro_f1, row_number() over (
  partition by model, track order by test_macro_f1 desc, name) = 1 picked from v_runs""")
def ml_17(run):
    return ev.pick_runs(runs(run))


@query("ml_17_latest", """select name from (select *, row_number() over (partition by model,
  track order by "timestamp" desc, name) rn from v_runs) where rn = 1""")
def ml_17_latest(run):
    return ev.pick_runs(runs(run), "latest").filter("picked").select("name")


VIEWS["v_epoch_sum"] = f"""select name, {big('sum(train_time_s + eval_time_s)')} total_time_s,
  count(*) epochs_run, arg_max(epoch, (macro_f1, -epoch)) best_epoch,
  max(macro_f1) best_macro_f1 from v_epochs group by 1"""


@query("ml_18", "select * from v_epoch_sum")
def ml_18(run):
    return ev.epoch_summary(epochs(run))


@query("ml_19", """select model, track, r.name, test_macro_f1, e.epochs_run, e.best_epoch from (
  select *, row_number() over (partition by model, track order by test_macro_f1 desc, name) rn
  from v_runs) r join v_epoch_sum e on e.name = r.model where rn = 1""")
def ml_19(run):
    history = ev.epoch_summary(epochs(run)).withColumnRenamed("name", "model")
    picked = ev.pick_runs(runs(run)).filter("picked")
    return picked.join(history, "model").select(
        "model", "track", "name", "test_macro_f1", "epochs_run", "best_epoch")


# per language: one report of the stand-in prediction
VIEWS["v_report"] = """select lang name, count(*) samples, """ + ", ".join(
    f"""coalesce(2.0::double * count(*) filter (where p.label_id = {i} and p.pred_label_id = {i})
    / nullif(count(*) filter (where p.label_id = {i}) + count(*) filter (where
    p.pred_label_id = {i}), 0), 0.0) f{i}""" for i in range(6)) + """,
  count(*) filter (where p.label_id = p.pred_label_id) hits from v_pred p
  join v_text t on t.id = p.id group by 1"""


def reports(run):
    both = predicted(run).join(run.tables.text.select("id", "lang"), "id")
    def f1(i):
        t, p = F.col("label_id") == i, F.col("pred_label_id") == i
        from tidemark.functions.numeric import ratio as safe
        return safe(F.count_if(t & p) * 2, F.count_if(t) + F.count_if(p))
    scores = [f1(i).alias(f"f{i}") for i in range(6)]
    folded = both.groupBy(F.col("lang").alias("name")).agg(
        F.count("*").alias("samples"), *scores,
        F.count_if(F.col("label_id") == F.col("pred_label_id")).alias("hits"))
    array = F.array(*[F.col(f"f{i}") for i in range(6)])
    return folded.select("name", "samples", (F.col("hits") / F.col("samples")).alias("accuracy"),
                         (sum((F.col(f"f{i}") for i in range(1, 6)), F.col("f0")) / 6.0)
                         .alias("macro_f1"), array.alias("per_class_f1"))


@query("ml_20", f"""select name, samples, {rnd('hits::double / samples')} accuracy,
  {rnd('(f0 + f1 + f2 + f3 + f4 + f5) / 6.0::double')} macro_f1, """ + " || ',' || ".join(
    f"printf('%.4f', {rnd(f'f{i}')})" for i in range(6)) + """ per_class,
  case when samples > 200 then samples end::varchar compared from v_report""")
def ml_20(run):
    rows = reports(run)
    comparisons = rows.filter("samples > 200").select(
        "name", F.col("samples").cast("string").alias("compared"))
    payload = ev.quality_payload(rows, comparisons)
    values = F.transform(F.map_values("per_class_f1"), lambda x: F.format_string("%.4f", x))
    return payload.select("name", "samples", "accuracy", "macro_f1",
                          F.array_join(values, ",").alias("per_class"), "compared")


@query("ml_19_classes", " union all ".join(
    f"select name, {label(str(i))} \"label\", {rnd(f'f{i}')} f1 from v_report" for i in range(6)))
def ml_19_classes(run):
    return ev.class_table(reports(run))


VIEWS["v_cells"] = """select name, i::bigint true_id, j::bigint pred_id, (select count(*) from v_pred p
  join v_text t on t.id = p.id where t.lang = r.name and p.label_id = i and p.pred_label_id = j) n
  from (select distinct lang name from v_text) r, range(6) a(i), range(6) b(j)"""


def with_matrix(run):
    """The reports with their confusion matrix."""
    both = predicted(run).join(run.tables.text.select("id", "lang"), "id")
    counts = both.groupBy(F.col("lang").alias("name")).agg(*[
        F.count_if((F.col("label_id") == i) & (F.col("pred_label_id") == j)).alias(f"c{i}{j}")
        for i in range(6) for j in range(6)])
    matrix = F.array(*[F.array(*[F.col(f"c{i}{j}") for j in range(6)]) for i in range(6)])
    return reports(run).join(counts.select("name", matrix.alias("confusion_matrix")), "name")


@query("ml_20_confusions", f"""select name, printf('%d:', rank) || {label('true_id')} || '>' ||
  {label('pred_id')} || '=' || n worst, m matrix from (select *, row_number() over (partition by name
  order by n desc, true_id, pred_id) rank, sum(case when true_id = pred_id then n else 0 end)
  over (partition by name)::bigint m from v_cells) where rank <= 99 and true_id <> pred_id and n > 0
  qualify row_number() over (partition by name order by rank) <= 3""".replace(
      "printf('%d:', rank)", "printf('%d:', row_number() over (partition by name order by rank))"))
def ml_20_confusions(run):
    """The three worst confusions of each run, and the diagonal total of its matrix."""
    rows = with_matrix(run)
    payload = ev.quality_payload(rows, rows.select("name", F.lit("x").alias("compared")))
    diagonal = sum((F.col("confusion_matrix")[i][i] for i in range(1, 6)), F.col("confusion_matrix")[0][0])
    return payload.select("name", diagonal.alias("matrix"), F.posexplode("top_confusions").alias(
        "k", "c")).select("name", "matrix", F.concat(
            F.col("k") + 1, F.lit(":"), "c.true_label", F.lit(">"), "c.pred_label", F.lit("="),
            F.col("c.n").cast("string")).alias("worst"))


@query("ml_19_confusion", f"""select name, {label('true_id')} true_label, {label('pred_id')} pred_label, n,
  {rnd(ratio('n', 't'))} share from (select *, sum(n) over (partition by name, true_id)::bigint t
  from v_cells)""")
def ml_19_confusion(run):
    return ev.confusion_table(with_matrix(run))


VIEWS["v_prog"] = """select *, macro_f1 > coalesce(max(macro_f1) over (partition by name
  order by epoch rows between unbounded preceding and 1 preceding), -1) new_best,
  row_number() over (partition by name order by epoch) n from v_epochs"""


@query("ml_21", """select name, epoch, new_best, cast(max(case when new_best then epoch end) over w
  as int) best_epoch, cast(n - max(case when new_best then n end) over w as int)
  epochs_since_improve, n - max(case when new_best then n end) over w >= 2 would_stop from v_prog
  window w as (partition by name order by epoch)""")
def ml_21(run):
    return ev.epoch_progress(epochs(run)).select(
        "name", "epoch", "new_best", "best_epoch", "epochs_since_improve", "would_stop")


