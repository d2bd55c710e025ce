"""Streams over several batches: keyed state, late rows, replays and closing steps."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tidemark.operators import kpi
from tidemark.operators.window import TimeWindow
from tidemark.sources import io
from tidemark.sources.keyindex import KeyIndex
from tidemark.streaming import state as ss
from tidemark.streaming import streams as st

START = dt.datetime(2024, 5, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State costs a worker and a store per partition and batch; one tells the same."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def source(spark, path, batches, schema):
    """One file per batch; a stream reads them in the order of their times."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.01)
    return st.read_stream(spark, path, 1)


# ------------------------------------------------------------------------- sessions
def plain_sessions(rows, gap=30):
    out = {}
    for user, minute in sorted(r for r in rows if r[0] is not None and r[1] is not None):
        held = out.setdefault(user, [])
        if held and minute - held[-1][1] < gap:
            held[-1][1:] = [minute, held[-1][2] + 1]
        else:
            held.append([minute, minute, 1])
    return sorted((u, at(a), at(b + gap), n) for u, x in out.items() for a, b, n in x)


def taken(df):
    return sorted((r["user_id"], r["start"], r["end"], r["events"]) for r in df.collect())


def test_sessions_close_by_timers_and_open_ones_are_read_from_state(spark, tmp_path):
    batches = [[(1, 0), (1, 10), (2, 5), (1, 60), (None, 3), (2, None)],
               [(1, 85), (2, 20), (2, 50), (1, 29)],  # late rows within the bound join what is open
               [(3, 400), (1, 401)],
               [(3, 405), (2, 900)]]
    rows = [[(u, None if m is None else at(m)) for u, m in b] for b in batches]
    events = source(spark, str(tmp_path / "in"), rows, "user_id long, ts timestamp")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with ss.disk_state(spark):
        query = st.run_available(ss.user_sessions(events, lateness="2 hours"), "append", state,
                                 st.change_sink(out))
    assert query.lastProgress["batchId"] >= 3
    closed = spark.read.parquet(out).drop("batch_id")
    still = ss.open_sessions(spark, state)
    # user 1's first sessions ended long before the watermark, 2's last one did not
    assert len(taken(closed)) >= 4 and (2, at(900), at(930), 1) in taken(still)
    assert taken(closed.unionByName(still)) == plain_sessions([r for b in batches for r in b])
    with ss.disk_state(spark):  # a restart repeats nothing
        st.run_available(ss.user_sessions(events, lateness="2 hours"), "append", state,
                         st.change_sink(out))
    again = spark.read.parquet(out).drop("batch_id").unionByName(ss.open_sessions(spark, state))
    assert taken(again) == plain_sessions([r for b in batches for r in b])


def test_session_parts_are_folded_in_the_map_tasks(spark):
    rows = [(7, at(k)) for k in range(0, 2000, 2)] + [(8, at(0)), (8, at(30)), (8, at(59))]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp").coalesce(1)
    parts = ss.session_parts(df, ss.interval_micros("30 minutes"), "user_id", "ts").collect()
    assert sorted((p.user_id, p.events) for p in parts) == [(7, 1000), (8, 1), (8, 2)]


def state_operators(query):
    return {o["operatorName"] for p in query.recentProgress for o in p["stateOperators"]}


def test_sessions_need_no_python_call_per_user(spark, tmp_path):
    """Gaps of just 30 minutes split, also between batches; late parts bridge two sessions."""
    half = dt.timedelta(microseconds=1)
    rows = [[(1, at(0)), (1, at(60)), (2, at(0)), (3, at(0))],
            [(1, at(30)), (2, at(30) - half), (3, at(29)), (3, at(58))]]
    events = source(spark, str(tmp_path / "in"), rows, "user_id long, ts timestamp")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with ss.disk_state(spark):
        query = st.run_available(ss.user_sessions(events, lateness="1 day"), "append", state,
                                 st.change_sink(out))
    assert state_operators(query) == {"sessionWindowStateStoreSaveExec"}
    assert taken(ss.open_sessions(spark, state)) == [
        (1, at(0), at(30), 1), (1, at(30), at(60), 1), (1, at(60), at(90), 1),
        (2, at(0), at(60) - half, 2), (3, at(0), at(88), 3)]


# ------------------------------------------------------------------------ snapshots
SNAPSHOT = ("post_id long, captured_at timestamp, comments_count long, attitudes_count long, "
            "reposts_count long")


def test_snapshots_need_no_python_call_per_post(spark, tmp_path):
    """A repeat and an older snapshot of a post in the state are no news."""
    batches = [[(1, at(5), 1, 1, 1), (2, at(5), 1, 1, 1)],
               [(1, at(5), 1, 1, 1), (2, at(4), 9, 9, 9), (3, at(1), 0, 0, 1)],
               [(1, at(5), 1, 1, 2)]]
    snapshots = source(spark, str(tmp_path / "in"), batches, SNAPSHOT)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with ss.disk_state(spark, empty_batches=False):
        query = st.run_available(ss.newest_snapshots(snapshots), "update", state, ss.newest_sink(out))
    assert not any("transformWithState" in o for o in state_operators(query))
    written = {(r["batch_id"], r["post_id"], r["interaction_count"]) for r in spark.read.parquet(out).collect()}
    assert written == {(0, 1, 3), (0, 2, 3), (1, 3, 1), (2, 1, 4)}


def test_snapshot_state_is_bounded_and_cold_posts_are_looked_up(spark, tmp_path):
    batches = [[(p, at(p + 100 * b), p, b, 0) for p in range(b, b + 5)] for b in range(9)]
    # posts long out of the state: one newer, one older than the table, one null
    batches.append([(0, at(5000), 9, 9, 9), (1, at(-50), 7, 7, 7), (2, None, 1, 1, 1)])
    snapshots = source(spark, str(tmp_path / "in"), batches, SNAPSHOT)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with ss.disk_state(spark, empty_batches=False):
        query = st.run_available(ss.newest_snapshots(snapshots, ttl="1 millisecond"), "update", state,
                                 ss.newest_sink(out))
    assert query.lastProgress["batchId"] >= 9
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert len(kept) >= 10 and max(kept) <= 2 * 5  # of 14 posts, those of a batch and the one before
    want = {}
    for p, when, a, b, c in (r for x in batches for r in x):
        if when is not None:
            want[p] = max(want.get(p, (when, 0)), (when, a + b + c))
    got = {r["post_id"]: (r["as_of"], r["interaction_count"]) for r in ss.read_newest(spark, out).collect()}
    assert got == want


def test_snapshot_sink_replays_replace_their_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "post_id long, captured long, interaction_count long, cold boolean"
    write = ss.newest_sink(out)
    write(spark.createDataFrame([(1, 10, 5, True), (2, 10, 6, True)], schema), 0)
    second = spark.createDataFrame([(1, 9, 50, True), (2, 11, 1, True), (3, 1, 1, True)], schema)
    for _ in range(2):
        write(second, 1)
    rows = {(r["post_id"], r["captured"], r["batch_id"]) for r in spark.read.parquet(out).collect()}
    assert rows == {(1, 10, 0), (2, 10, 0), (2, 11, 1), (3, 1, 1)}


# --------------------------------------------------------------------- half windows
def test_half_windows_with_late_and_replayed_rows_equal_the_batch_result(spark, tmp_path):
    day = 24 * 60
    batches = [[(0, "error"), (day, "error"), (8 * day, "view")],
               [(15 * day, "error"), (3 * day, "error"), (9 * day, "error")],  # late
               [(16 * day, "error"), (10 * day, "view"), (37 * day, "error")]]
    rows = [[(at(m), kind) for m, kind in b] for b in batches]
    events = source(spark, str(tmp_path / "in"), rows, "ts timestamp, kind string")
    negative = F.col("kind") == "error"
    counts = st.half_window_counts(events, "ts", negative, "7 days", "60 days")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = st.run_available(counts, "update", state, st.change_sink(out))
    assert query.lastProgress["batchId"] >= 2

    def alerts(df):
        return sorted(tuple(r) for r in st.half_window_alerts(df).select(
            "start", "negative", "previous", "growth").collect())
    found = alerts(st.read_changes(spark, out, ["start"]))
    whole = spark.createDataFrame([r for b in rows for r in b], "ts timestamp, kind string")
    assert found == alerts(st.half_window_counts(whole, "ts", negative, "7 days", "60 days"))
    week = {}
    for when, kind in (r for b in rows for r in b):
        n = int((when - dt.datetime(1970, 1, 1)).days // 7)
        week[n] = week.get(n, 0) + (kind == "error")
    assert [(r[1], r[2]) for r in found] == [(week[n], week.get(n - 1, 0)) for n in sorted(week)]
    # the last batch again, as after a crash between sink and commit
    last = spark.read.parquet(f"{out}/batch_id=2")
    st.change_sink(out)(spark.createDataFrame(last.collect(), last.schema), 2)
    assert alerts(st.read_changes(spark, out, ["start"])) == found


# ---------------------------------------------------------------------- daily series
def test_maintained_daily_series_equals_the_series_of_all_predictions(run, spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "daily")
    predictions = run.tables.prediction
    for k in range(3):
        predictions.filter(f"source_id % 3 = {k}").coalesce(1).write.mode("append").parquet(path)
    query = st.run_available(st.read_stream(spark, path, 1), "append", str(tmp_path / "state"),
                             st.daily_sink(out))
    assert query.lastProgress["batchId"] >= 2

    def rows(df):
        return sorted(tuple(r) for r in df.collect())
    held = spark.read.parquet(path)
    st.daily_sink(out)(held.filter("source_id % 3 = 2"), 2)  # a replay replaces its batch
    whole = run.window()
    cuts = [whole, TimeWindow(at(0), at(1), at(2)), TimeWindow(
        whole.start + dt.timedelta(days=9, hours=5), whole.mid, whole.end - dt.timedelta(days=3, hours=2)),
        TimeWindow(whole.start + dt.timedelta(hours=1), whole.mid, whole.start + dt.timedelta(hours=9))]
    for window in cuts:
        assert rows(kpi.maintained_series(st.read_daily(spark, out), held, window)) == rows(
            kpi.emotion_series(run.tables, window))


# ------------------------------------------------------------------------ key index
KEY = "k long, month string"


@pytest.fixture
def index(spark, tmp_path):
    return KeyIndex(spark, str(tmp_path / "index"), ["k"])


def test_index_tells_the_months_that_hold_a_key(spark, index):
    rows = [(k, f"2024{k % 12 + 1:02d}") for k in range(6000)]
    index.add(spark.createDataFrame(rows, KEY))
    assert index.months() == {f"2024{m:02d}" for m in range(1, 13)}
    for keys, months in (([5], ["202406"]), ([0, 12, 13], ["202401", "202402"]), ([], []),
                         (list(range(100_000, 104_000)), [])):
        assert index.months_with(spark.createDataFrame([(k,) for k in keys], "k long")) == months


def test_index_months_are_replaced_and_forgotten(spark, index):
    index.add(spark.createDataFrame([(1, "a"), (2, "b")], KEY))
    index.add(spark.createDataFrame([(3, "a")], KEY))
    keys = spark.createDataFrame([(1,), (3,)], "k long")
    assert index.months_with(keys) == ["a"]
    index.replace(spark.createDataFrame([(3, "a"), (1, "c")], KEY), ["a", "c"])
    assert index.months_with(keys) == ["a", "c"]
    assert index.months_with(spark.createDataFrame([(2,)], "k long")) == ["b"]
    index.forget(["b"])
    assert index.months() == {"a", "c"}


def predictions(spark, rows):
    return spark.createDataFrame(rows, "source_id long, at string, pred_label_id int, predicted_at int"
                                 ).selectExpr("'m' model_version", "'post' source_type", "source_id",
                                              "cast(at as timestamp_ntz) source_created_at",
                                              "pred_label_id", "predicted_at")


def test_upserts_read_keys_of_no_other_month(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    first = [(k, f"2024-{k % 9 + 1:02d}-03", 0, 1) for k in range(90)]
    io.upsert_predictions(spark, path, predictions(spark, first))
    read = []
    plain = io.keys_of
    monkeypatch.setattr(io, "keys_of", lambda s, p, months: read.append(months) or plain(s, p, months))
    # 9 is in January, 10 moves from February to December, 900 is new
    io.upsert_predictions(spark, path, predictions(spark, [
        (9, "2024-01-20", 1, 2), (10, "2024-12-01", 2, 2), (900, "2024-12-05", 3, 2)]))
    assert read == [["202402"]]
    rows = {(r["source_id"], str(r["month"]), r["pred_label_id"]) for r in spark.read.parquet(path).collect()}
    assert len(rows) == 91 and {(9, "202401", 1), (10, "202412", 2), (900, "202412", 3)} <= rows
    plan = plain(spark, path, ["202402"])._jdf.queryExecution().toString()
    assert "202402" in plan[plan.index("PartitionFilters"):].split("]")[0]
    # back again: the bits of the old place are gone, those of the new one are there
    read.clear()
    io.upsert_predictions(spark, path, predictions(spark, [(10, "2024-02-01", 4, 3)]))
    assert read == [["202412"]]


def test_upserts_index_tables_that_have_no_index(spark, tmp_path):
    path = str(tmp_path / "table")
    io.upsert_predictions(spark, path, predictions(spark, [(1, "2024-01-05", 0, 1), (2, None, 0, 1)]))
    io.delete_folder(spark, f"{path}-keys")
    io.upsert_predictions(spark, path, predictions(spark, [(2, "2024-03-01", 5, 2)]))
    assert {(r["source_id"], str(r["month"])) for r in spark.read.parquet(path).collect()} == {
        (1, "202401"), (2, "202403")}
    assert io.key_index(spark, path).months() == {"202401", "202403"}
