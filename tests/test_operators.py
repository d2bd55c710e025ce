"""Invariants, skew handling and fixtures with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.registry import SETTINGS
from checks.selection import letter_scorer
from tidemark.operators import annotation as an
from tidemark.operators import evaluation as ev
from tidemark.operators import evidence as e
from tidemark.operators import topics as t
from tidemark.operators.assembly import eval_sample
from tidemark.operators.dedupe import exclude_contents, latest_version
from tidemark.operators.joins import hot_keys, join_unique
from tidemark.operators.quality import clean_frame, clean_splits, dedupe_content, remove_leakage
from tidemark.operators.ranking import number_rows, number_within
from tidemark.operators.window import range_length, resolve_window
from tidemark.plans.risk import risk_topics, scored_topics, topic_risk


def test_list_score_equals_detail_score(run):
    ranked = risk_topics(run.tables, run.window(), limit=3, s=SETTINGS).collect()
    for row in ranked:
        one = topic_risk(run.tables, run.window(), int(row["topic_id"]), SETTINGS).first()
        assert one["risk_score"] == row["risk_score"]
        assert one["sample_count"] == row["sample_count"]


def test_topic_counts_add_up(run):
    rows = t.topic_totals(run.tables, run.window("365d")).collect()
    assert rows
    for r in rows:
        assert sum(r[f"emotion_{i}"] for i in range(6)) == r["sample_count"]
        assert r["recent_negative"] + r["previous_negative"] == r["negative_count"]
        assert r["post_samples"] + r["comment_samples"] == r["sample_count"]


def test_source_shares_sum_to_one_or_zero(run):
    for r in risk_topics(run.tables, run.window(), s=SETTINGS).collect():
        total = sum(r[f"share_{x}"] for x in ("hot", "keyword", "kol", "retweet"))
        assert total == 0 or abs(total - 1) < 3e-4


def test_search_scope_changes_caps_only(run):
    window = run.window()
    whole = scored_topics(run.tables, window, "ring", SETTINGS).collect()
    own = scored_topics(run.tables, window, "ring", SETTINGS, "search").collect()
    assert {r["topic_id"] for r in whole} == {r["topic_id"] for r in own}
    listed = {r["topic_id"]: r["risk_score"] for r in scored_topics(
        run.tables, window, "", SETTINGS).collect()}
    for r in whole:
        if r["topic_id"] in listed:
            assert r["risk_score"] == listed[r["topic_id"]]


def test_pages_concatenate(run):
    feed = e.evidence_feed(run.tables, run.window("365d")).cache()
    want = [(r["source"], r["source_id"]) for r in e.page(feed, 50).collect()]
    got, after = [], None
    for _ in range(5):
        shown = e.page(feed, 10, after)
        got += [(r["source"], r["source_id"]) for r in shown.collect()]
        key = e.next_key(shown, 10).first()
        after = (key["evidence_score"], key["source"], key["source_id"])
    assert got == want
    assert e.next_key(e.page(feed, 5), 10).first() is None


def test_join_unique_spreads_a_hot_key(spark):
    many = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 100).alias("k"))
    unique = spark.range(2000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    assert 7 in [r["k"] for r in hot_keys(many, "k").collect()]
    for how in ("left", "inner", "left_semi"):
        got = join_unique(many, unique, "k", "id", how)
        want = many.join(unique, "k", how)
        assert got.count() == want.count()
        assert got.select(*want.columns).exceptAll(want).count() == 0


def test_many_hot_keys_fill_no_task(spark):
    """One key with a third of the rows and 40 with a hundredth each."""
    many = spark.range(60000).select("id", F.when(F.col("id") % 3 == 0, 7).when(
        F.col("id") % 3 == 1, 100 + F.floor(F.col("id") / 3) % 50).otherwise(
        1000 + F.col("id")).alias("k"))
    hot = {r["k"]: r["salts"] for r in hot_keys(many, "k").collect()}
    assert hot[7] >= 85 and all(100 + i in hot for i in range(50))
    salted = many.join(hot_keys(many, "k"), "k", "left").withColumn(
        "s", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))))
    assert salted.groupBy("k", "s").count().agg(F.max("count")).first()[0] < 60000 / 100
    unique = many.select("k").distinct()
    assert join_unique(many, unique, "k", "id", "inner").count() == 60000


def test_join_unique_keeps_null_and_unmatched_keys(spark):
    many = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, k int")
    unique = spark.createDataFrame([(5, "x")], "k int, v string")
    got = {(r["id"], r["v"]) for r in join_unique(many, unique, "k", "id").collect()}
    assert got == {(1, None), (2, "x"), (3, None)}


def test_number_rows_is_a_global_sort(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(
        F.col("id") % 17).alias("g"))
    got = number_rows(df, [F.asc("g"), F.desc("id")], "n").collect()
    want = sorted(((r["g"], -r["id"]) for r in df.collect()))
    assert [(r["g"], -r["id"]) for r in sorted(got, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in got) == list(range(1, 5001))


def test_number_within_restarts_per_group(spark):
    df = spark.range(999).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 2).cast("string")).alias("g"))
    got = number_within(df, ["g"], [F.asc("id")], "n").collect()
    for g in ("hot", "0", "1"):
        ns = [r["n"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["id"])]
        assert ns == list(range(1, len(ns) + 1))


def test_latest_version_is_idempotent(run):
    raw = run.tables.comment_versions
    ties = ["l_partkey", "l_suppkey", "like_count", "l_returnflag", "l_linestatus"]
    once = latest_version(raw, ["comment_id"], "created_at", ties)
    assert once.count() == latest_version(once, ["comment_id"], "created_at", ties).count() == \
        raw.select("comment_id").distinct().count()


def raw_rows(spark):
    rows = [(1, "same", "happy", "train"), (2, "same", "sad", "train"), (3, "Leak  #x#", "fear",
            "train"), (4, "leak x", "fear", "eval"), (5, "http://a.b", "sad", "train"),
            (6, None, "sad", "train"), (7, "ok", None, "test"), (8, "only", "angry", "train")]
    return spark.createDataFrame(rows, "id int, content string, label string, split string")


def test_clean_splits_equals_the_stepwise_way(spark):
    cleaned = clean_frame(raw_rows(spark))
    steps = remove_leakage(dedupe_content(cleaned, "id", ("split",)))
    got = clean_splits(cleaned).select(*steps.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, steps.collect()))
    assert {r["id"] for r in got.collect()} == {1, 4, 8}


def test_unknown_label_fails(spark):
    bad = spark.createDataFrame([(1, "x", "joy", "train")],
                                "id int, content string, label string, split string")
    with pytest.raises(Exception, match="unknown label"):
        clean_frame(bad).collect()


def test_exclusion_is_disjoint(run):
    text = run.tables.text
    kept = exclude_contents(dedupe_content(text), text.filter("split = 'test'"))
    assert kept.join(text.filter("split = 'test'"), "content", "left_semi").count() == 0


def test_adjudication_ladder(spark):
    primary = spark.createDataFrame(
        [("a", 1, 0.9, False), ("b", 1, 0.5, False), ("c", 1, 0.5, True), ("d", 1, 0.9, True),
         ("e", 1, 0.5, None)],
        "sample_id string, primary_label_id int, primary_confidence double,"
        "primary_needs_review boolean")
    review = spark.createDataFrame(
        [("c", 1, 0.7, True), ("d", 2, 0.85, False), ("e", 2, 0.85, True)],
        "sample_id string, review_label_id int, review_confidence double,"
        "review_needs_review boolean")
    out = {r["sample_id"]: (r["adjudication_status"], r["adjudicated_label_id"])
           for r in an.adjudicate(primary, review).collect()}
    assert out == {
        "a": ("auto_accept_primary_high_conf", 1), "b": ("human_required_no_review", 1),
        "c": ("auto_accept_two_model_agree", 1), "d": ("auto_accept_review_high_conf", 2),
        "e": ("human_required_disagree_or_low_conf", 2)}


def test_conflicting_relabels_fail(spark):
    df = spark.createDataFrame(
        [("t", "train", 1, "auto_accept_x"), ("t", "train", 2, "auto_accept_x")],
        "content string, split string, adjudicated_label_id int, adjudication_status string")
    with pytest.raises(Exception, match="conflicting"):
        an.relabel_map(df, "train").collect()


def test_published_disagreement_counts(spark):
    """1083 / 156 / 75 / 186 of 1500 samples give the published rates."""
    parts = [(1083, 0, 0, 0), (156, 0, 0, 1), (75, 0, 1, 0)]
    rows = [(y, a, b) for n, y, a, b in parts for _ in range(n)]
    rows += [(0, 1, 1)] * 140 + [(0, 1, 2)] * 46
    df = spark.createDataFrame(rows, "label_id int, a_pred_id int, b_pred_id int")
    r = ev.disagreement_summary(ev.compare_models(df)).first()
    assert (r["both_correct"], r["a_only_correct"], r["b_only_correct"], r["both_wrong"]) == (
        1083, 156, 75, 186)
    assert (r["agreement_count"], r["disagreement_count"]) == (1223, 277)
    assert (r["a_accuracy"], r["oracle_accuracy"]) == (0.826, 0.876)
    assert round(r["agreement_rate"], 4) == 0.8153
    assert round(r["disagreement_a_accuracy"], 4) == 0.5632
    assert round(r["disagreement_b_accuracy"], 4) == 0.2708


def test_macro_f1_counts_present_classes_only(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label_id int, pred_label_id int")
    assert ev.macro_f1(ev.per_class(ev.confusion_matrix(df))).first()[0] == 0.666667


def test_eval_sample_runs_out_of_room(spark):
    df = spark.range(600).select("id", (F.col("id") % 6).alias("label_id"))
    small = eval_sample(df, 50, 20).groupBy("label_id").count().collect()
    assert {r["label_id"]: r["count"] for r in small} == {0: 20, 1: 20, 2: 10}
    assert eval_sample(df, 200, 20).count() == 200
    assert eval_sample(df, 5000, 20).count() == 600


def test_ranges(run):
    assert range_length("all_available") is None and range_length("7d").days == 7
    week, year = run.window("7d"), run.window("365d")
    assert (week.end - week.start).days == 7 and year.start < week.start
    fallback = resolve_window(run.tables.post, "all_available", 10**12)
    assert fallback.start == run.tables.post.agg(F.min("first_crawled_at")).first()[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_plan(run):
    window = run.window("365d")
    text = plan(t.topic_candidates_with_factors(run.tables, window)) + plan(
        risk_topics(run.tables, window, s=SETTINGS))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "GreaterThanOrEqual(o_orderdate" in text and "GreaterThanOrEqual(l_shipdate" in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_scorer_shape():
    assert letter_scorer(["aab", ""]).shape == (2, 6)
    assert np.isfinite(letter_scorer([""])).all()




def test_large_top_n_is_pruned_exactly(spark):
    from tidemark.operators.ranking import sample_rows, seeded_key, top_per_group
    df = spark.range(20000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(
        "cold").alias("g"), (F.col("id") % 50).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    got = top_per_group(df, ["g"], order, 1500, "n", -F.col("score"))
    want = top_per_group(df, ["g"], order, 1500, "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    sampled = {r["id"] for r in sample_rows(df, 1200, "id").collect()}
    plain = df.orderBy(seeded_key(42, F.col("id")), "id").limit(1200).collect()
    assert sampled == {r["id"] for r in plain}


@pytest.mark.parametrize("values", [[3], [0, 0, 0, 9], list(range(1, 400)), [5] * 50 + [10**9]])
def test_exact_percentile(spark, values):
    from tidemark.operators.quantiles import exact_percentile
    counted = spark.createDataFrame([(v,) for v in values], "v long").groupBy("v").count()
    for q in (0.0, 0.5, 0.95, 1.0):
        got = exact_percentile(counted, "v", "count", q, "p").first()["p"]
        assert got == pytest.approx(float(np.quantile(values, q)))


def test_gain_crosses_days(spark):
    from tidemark.operators.contract import snapshot_growth
    rows = [(1, "2024-01-01 10:00:00", 1), (1, "2024-01-01 11:00:00", 4),
            (1, "2024-01-03 09:00:00", 10), (1, "2024-01-03 09:00:01", 11)]
    df = spark.createDataFrame(rows, "post_id int, at string, comments_count int").selectExpr(
        "post_id", "cast(at as timestamp_ntz) captured_at", "comments_count",
        "0 attitudes_count", "0 reposts_count")
    gains = [r["gain"] for r in snapshot_growth(df).orderBy("captured_at").collect()]
    assert gains == [None, 3, 6, 1]


def test_final_selection_needs_enough_candidates(run):
    from checks.selection import scored
    from tidemark.operators.mining import add_selection_scores, select_final
    ready = add_selection_scores(scored(run))
    with pytest.raises(Exception, match="candidates for a target"):
        select_final(ready, 100000, "id").collect()


@pytest.mark.parametrize("n", [10, 1000, 1001])
def test_samples_keep_null_groups(spark, n):
    from tidemark.operators.ranking import sample_per_group, sample_rows
    df = spark.range(5000).selectExpr("id", "case when id % 2 = 0 then 'a' end g")
    got = sample_per_group(df, ["g"], n, "id").groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"a": n, None: n}
    assert sample_rows(df, n, "id").count() == n


def test_final_selection_of_nothing_fails(run):
    from tidemark.operators.mining import select_final
    frame = run.spark.createDataFrame([], (
        "source_id long, target_bucket string, selection_score double, selection_flags string, "
        "matched_keywords string, model_pred string, model_top1_prob double, model_top2_label string, "
        "model_top2_prob double, model_margin double, source string"))
    with pytest.raises(ValueError, match="candidates"):
        select_final(frame, 100)


def test_nearest_rank_is_exact(spark):
    from tidemark.operators.quantiles import nearest_rank
    dice = np.random.default_rng(2)
    for size in (1, 2, 19, 20, 21, 400):
        values = np.round(dice.lognormal(0, 3, size), 3) + 0.001
        frame = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
        got = nearest_rank(frame, ["g"], "v", 0.95).first()["v"]
        assert got == np.sort(values)[int(np.ceil(size * 0.95)) - 1]


def test_scorers_get_slices_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    from tidemark.operators import scoring as sc
    batch = pa.RecordBatch.from_pydict({"content": ["a" * 6, None, "b" * 6, "c", "d" * 30, ""]})
    parts = [p.column("content").to_pylist() for p in sc.text_slices(batch.slice(1), "content", 7)]
    assert parts == [[None, "b" * 6, "c"], ["d" * 30], [""]]
    monkeypatch.setattr(sc, "SLICE_BYTES", 40)
    rows = [(k, "abcdef"[k % 6] * (k % 30 + 1)) for k in range(200)]
    got = sc.score_texts(spark.createDataFrame(rows, "id long, content string"), letter_scorer).collect()
    assert {(r["id"], r["content"]): r["logits"] for r in got} == {
        row: list(letter_scorer([row[1]])[0]) for row in rows}
