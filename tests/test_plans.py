"""How often plans read the largest table, stored parts included."""

import re
import time
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from checks.registry import Run
from tidemark import session
from tests.conftest import ROOT
from tidemark.operators import actors, evidence, kpi, samples, topics
from tidemark.operators.window import TimeWindow
from tidemark.schema import DEFAULTS
from tidemark.session import stored
from tidemark.sources.tables import Tables


def scans(df) -> int:
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"Relation \[l_orderkey", plan))


@pytest.fixture
def written(monkeypatch):
    """Scans of every frame that a plan stores while it is built."""
    counts = []

    def counted(df, name):
        counts.append(scans(df))
        return stored(df, name)

    for module in (actors, evidence, topics):
        monkeypatch.setattr(module, "stored", counted)
    return counts


def test_candidates_scan_few_times(run, written):
    found = actors.actor_candidates(run.tables, run.window())
    assert sum(written) + scans(found) <= 7


def test_evidence_page_plans_its_feed_once(run, written):
    shown = evidence.evidence_page(run.tables, run.window(), 8)
    alone = scans(evidence.evidence_feed(run.tables, run.window()).drop("content"))
    assert sum(written) <= alone
    assert scans(shown) == 1


def test_topic_totals_read_links_once(run, written):
    totals = topics.topic_totals(run.tables, run.window())
    assert written == [1]
    assert sum(written) + scans(totals) <= 4


def test_overview_folds_scan_once_each(run):
    """The figures of one fold are fields of one scalar subquery, which runs once."""
    w = run.window()
    assert scans(kpi.post_figures(run.tables, w)) == 2
    assert scans(kpi.user_figures(run.tables, w)) == 1


def test_candidates_of_odd_rows(spark):
    """Posts without author, snapshot or link, comments without time, a prediction of no comment."""
    at = datetime(2024, 5, 1)
    rows = {
        "post": [(1, 10, at), (2, None, at), (3, 30, None)],
        "engagement": [(1, at, 5, 5, 5), (9, at, None, None, None)],
        "comment": [(7, 1, 40, 2, None), (8, 1, 50, None, at)],
        "prediction": [("primary", "post", 1, 1, at, 1), ("primary", "post", 3, 3, at, 2),
                       ("primary", "comment", 7, 1, at, None), ("primary", "comment", 99, 1, at, 1)],
        "post_topic": [(1, 100)], "discovery": [(1, "kol"), (3, "kol")],
        "user": [(10, True, 0, 0), (30, True, 0, 0), (40, True, 0, 0), (50, True, 0, 0)]}
    schemas = {
        "post": "post_id long, user_id long, created_at timestamp_ntz",
        "engagement": "post_id long, captured_at timestamp_ntz, comments_count long, "
                      "attitudes_count long, reposts_count long",
        "comment": "comment_id long, post_id long, user_id long, like_count long, "
                   "created_at timestamp_ntz",
        "prediction": "model_version string, source_type string, source_id long, post_id long, "
                      "source_created_at timestamp_ntz, pred_label_id int",
        "post_topic": "post_id long, topic_id long", "discovery": "post_id long, source_type string",
        "user": "uid long, verified boolean, profile_tier int, followers_count long"}
    tables = Tables(spark, {n: (lambda n=n: spark.createDataFrame(rows[n], schemas[n]))
                            for n in rows} | {"comment_versions": lambda: tables.comment})
    window = TimeWindow(at, at, at)
    settings = replace(DEFAULTS, primary_model="primary")
    found = {r["uid"]: r for r in actors.actor_candidates(tables, window, s=settings).collect()}
    # 30 and 40 spoke at no known time: samples, but no marker of identity, discovery or interactions
    assert set(found) == {10, 50}
    assert (found[10]["sample_count"], found[10]["interaction_count"]) == (1, 15)
    assert (found[10]["is_entry_kol"], found[10]["is_high_inter"]) == (1, 1)
    assert (found[50]["sample_count"], found[50]["is_verified_kol"]) == (0, 1)
    of_topic = actors.actor_candidates(tables, window, 100, settings)
    assert {r["uid"] for r in of_topic.collect()} == {10, 50}
    assert actors.actor_candidates(tables, window, 101, settings).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_kept_tables_are_resolved_once_for_all_readers(spark):
    tables = Run(spark, ROOT).tables
    want = sorted(tables.prediction.collect())
    assert "Window" in plan_of(tables.prediction)
    tables.keep("comment", "post_topic")
    assert "Window" not in plan_of(tables.prediction) and "Exchange" not in plan_of(tables.post_topic)
    assert sorted(tables.prediction.collect()) == want


def test_rows_of_a_topic_stay_where_they_are(spark, monkeypatch):
    tables = Run(spark, ROOT).tables
    topic = tables.post_topic.groupBy("topic_id").count().orderBy(
        F.desc("count"), "topic_id").first()["topic_id"]
    few = samples.of_topic(tables.discovery, tables, topic, "discovered_at")
    assert "hashpartitioning" not in plan_of(few)
    monkeypatch.setattr(samples, "FEW_POSTS", 0)
    many = samples.of_topic(tables.discovery, tables, topic, "discovered_at")
    assert few.count() > 0 and sorted(few.collect()) == sorted(many.collect())


def test_accounts_meet_topics_after_one_move(spark):
    """Rows per account and topic are not dealt a second time, nor joined to the topic table."""
    tables, at = Run(spark, ROOT).tables, datetime(2024, 5, 1)
    window = TimeWindow(datetime(1970, 1, 1), at, at)
    posts = actors.posts_in(tables, window)
    keyed = re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(
        actors.walked_topics(tables, window, posts)))
    assert not [k for k in keyed if "uid" in k and "topic_id" in k]
    assert not [k for k in keyed if "uid" in k and "post_id" in k]


def test_walked_topics_equal_both_parts(spark):
    """The footprint and the cross-topic accounts of one pass, with unknown, null and repeated topics."""
    at = datetime(2024, 5, 1)
    tables = Tables(spark, {
        "post": lambda: spark.createDataFrame([(1, 10, at), (2, 10, at), (3, 20, at)],
                                              "post_id long, user_id long, created_at timestamp_ntz"),
        "comment": lambda: spark.createDataFrame(
            [(1, 30, at), (1, 30, at), (2, 30, at), (3, 10, at)],
            "post_id long, user_id long, created_at timestamp_ntz"),
        "comment_versions": lambda: tables.comment, "topic": lambda: spark.createDataFrame(
            [(100, "a"), (101, "b"), (101, "b")], "topic_id long, title string"),
        "post_topic": lambda: spark.createDataFrame(
            [(1, 100), (1, 999), (2, 101), (2, 100), (3, None), (3, 101)], "post_id long, topic_id long")})
    window = TimeWindow(at, at, at)
    posts = tables.post.select("post_id", F.col("user_id").alias("uid"))
    got = {r["uid"]: tuple(r)[1:] for r in actors.walked_topics(tables, window, posts).collect()}
    # 10 wrote on 100, 101 and the unknown 999, and spoke twice on 100 and 101; 101 is there twice
    assert got == {10: (3, 100, 1), 20: (2, 101, 0), 30: (3, 100, 0)}
    few = spark.createDataFrame([(10,), (30,)], "uid long")
    found = actors.topic_footprint(tables, window, few).collect()
    assert sorted(map(tuple, found)) == [(10, 3, 100, "a"), (30, 3, 100, "a")]


def test_topic_totals_move_authors_once(run):
    keyed = re.findall(r"hashpartitioning\((.*?), \d+\)", plan_of(topics.topic_totals(
        run.tables, run.window())))
    assert not [k for k in keyed if "author" in k]


def test_kept_tables_end_with_their_plan(spark):
    tables = Run(spark, ROOT).tables
    with tables.keeping("comment"):
        assert tables.is_kept("comment") and "Window" not in plan_of(tables.comment)
    assert not tables.is_kept("comment") and "Window" in plan_of(tables.comment)


def test_tasks_grow_in_number_with_the_facts(spark, monkeypatch):
    names = ("spark.sql.adaptive.coalescePartitions.initialPartitionNum",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        run = Run(spark, ROOT)
        assert run.tables.lineitem is not None
        small = int(spark.conf.get(names[0]))
        monkeypatch.setattr(session, "SHUFFLE_BYTES", 1000)
        Run(spark, ROOT).tables.post_topic  # noqa: B018
        assert int(spark.conf.get(names[0])) > 10 * small
        assert spark.conf.get(names[2]) == str(session.SPLIT_BYTES)
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_shuffle_files_go_with_the_action(spark):
    """Disk holds the shuffles of one action, not of all that the driver's garbage still names."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    tables = Run(spark, ROOT).tables
    tables.lineitem  # sets the session for its size
    before = shuffles()
    tables.keep("post_topic")
    assert tables.post_topic.count() > 0
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before


def written_by(monkeypatch, module):
    """The names that a module writes tables under."""
    names, plain = [], module.stored
    monkeypatch.setattr(module, "stored", lambda df, name: (names.append(name), plain(df, name))[1])
    return names


def test_pages_of_one_feed_share_what_they_read(spark, monkeypatch):
    """The feed is made once, and each side of its join ends before the join begins."""
    names = written_by(monkeypatch, evidence)
    got = [tuple(r) for r in QUERIES["ev_06_next"](spark, ROOT).collect()]
    assert names == ["spoken", "context", "feed", "page", "page"]
    run = Run(spark, ROOT)
    pages = evidence.evidence_page(run.tables, run.window(), 16).select(
        "source", "source_id", "evidence_score").collect()
    rest = sorted((tuple(r) for r in pages), key=lambda r: (-r[2], r[0], r[1]))[8:]
    assert sorted(got) == sorted(rest)


def test_steps_of_a_pack_end_one_by_one(spark, monkeypatch):
    """Rows per post and the walk over the topics are written before the steps that move them again."""
    run = Run(spark, ROOT)
    topic_names, actor_names = written_by(monkeypatch, topics), written_by(monkeypatch, actors)
    run.tables.keep("post_topic")
    topics.topic_totals(run.tables, run.window())
    actors.actor_candidates(run.tables, run.window(), walked=True)
    assert "features" in topic_names and "walked" in actor_names
