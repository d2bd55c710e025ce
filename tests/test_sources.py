"""Readers, writers and streams on small files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from checks import sinks
from checks.registry import QUERIES, Run
from checks.selection import letter_scorer
from tests.conftest import ROOT
from tidemark.functions.text import clean_text
from tidemark.sources import io
from tidemark.sources.tables import canonical_tables
from tidemark.streaming import streams as st


def test_read_raw_array_files(spark, tmp_path):
    rows = [{"id": 1, "content": "a\nb", "label": "happy"}, {"id": 2, "content": None}]
    (tmp_path / "a.txt").write_text(json.dumps(rows, indent=1))
    got = io.read_raw(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "a\nb", "happy"), (2, None, None)]


def test_read_table_rejects_unknown_suffix(spark):
    with pytest.raises(ValueError, match="unsupported"):
        io.read_table(spark, "/x/y.xlsx")
    with pytest.raises(ValueError, match="missing columns"):
        io.require_columns(spark.range(1), ["id", "content"])


def test_read_runs(spark, tmp_path):
    for name, f1 in (("bert-usual-20260501-0100", 0.7), ("ernie-virus-20260502-0200", None)):
        d = tmp_path / name
        d.mkdir()
        (d / "train_args.json").write_text(json.dumps({"pretrained": "p"}, indent=2))
        log = [{"epoch": i, "macro_f1": v, "train_time_s": 2, "eval_time_s": 1}
               for i, v in enumerate((0.1, 0.5, 0.5), 1)]
        (d / "eval_history.jsonl").write_text("\n".join(map(json.dumps, log)))
        if f1:
            (d / "final_test_report.json").write_text(json.dumps(
                {"macro_f1": f1, "accuracy": 0.8, "loss": 0.5, "samples": 9,
                 "per_class_f1": [0.1] * 6, "confusion_matrix": [[1] * 6] * 6}, indent=2))
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "train_args.json").write_text("{}")
    runs = {r["name"]: r for r in io.read_runs(spark, str(tmp_path)).collect()}
    assert set(runs) == {"bert-usual-20260501-0100", "ernie-virus-20260502-0200"}
    bert = runs["bert-usual-20260501-0100"]
    assert (bert["best_epoch"], bert["epochs_run"], bert["total_time_s"]) == (2, 3, 9)
    assert bert["problem"] is None and bert["track"] == "usual" and bert["test_loss"] == 0.5
    assert bert["test_samples"] == 9 and bert["confusion_matrix"] == [[1] * 6] * 6
    assert runs["ernie-virus-20260502-0200"]["problem"] == "no final_test_report.json"


def predictions(spark, rows):
    df = spark.createDataFrame(
        rows, "source_id long, at string, pred_label_id int, predicted_at int")
    return df.selectExpr("'v' model_version", "'post' source_type", "source_id",
                         "cast(at as timestamp_ntz) source_created_at", "pred_label_id",
                         "predicted_at")


def test_upsert_replaces_only_touched_keys(spark, tmp_path):
    path = str(tmp_path / "table")
    first = [(1, "2024-01-05", 0, 1), (2, "2024-01-06", 0, 1), (3, "2024-02-01", 0, 1)]
    io.upsert_predictions(spark, path, predictions(spark, first))
    again = predictions(spark, [(2, "2024-01-06", 5, 2), (4, "2024-03-01", 1, 2)])
    for _ in range(2):
        io.upsert_predictions(spark, path, again)
    rows = spark.read.parquet(path).collect()
    assert {(r["source_id"], r["pred_label_id"]) for r in rows} == {(1, 0), (2, 5), (3, 0), (4, 1)}
    assert len(rows) == 4


def test_upsert_moves_keys_between_months_and_reads_only_theirs(spark, tmp_path):
    path = str(tmp_path / "table")
    first = [(1, "2024-01-05", 0, 1), (2, "2024-02-06", 0, 1), (3, "2024-03-01", 0, 1)]
    io.upsert_predictions(spark, path, predictions(spark, first))
    io.upsert_predictions(spark, path, predictions(spark, [(2, "2024-03-09", 4, 2)]))
    rows = {(r["source_id"], str(r["month"]), r["pred_label_id"])
            for r in spark.read.parquet(path).collect()}
    assert rows == {(1, "202401", 0), (2, "202403", 4), (3, "202403", 0)}
    plan = io.predictions_of(spark, path, ["202403"])._jdf.queryExecution().toString()
    assert "202403" in plan[plan.index("PartitionFilters"):].split("]")[0]


def test_upserts_keep_rows_without_a_time(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(1, None, 0, 1), (2, None, 0, 1), (3, "2024-01-05", 0, 1)]
    io.upsert_predictions(spark, path, predictions(spark, rows))
    again = [(2, None, 5, 2), (4, None, 1, 2)]
    io.upsert_predictions(spark, path, predictions(spark, again))
    def held():
        return sorted((r["source_id"], str(r["month"]), r["pred_label_id"])
                      for r in spark.read.parquet(path).collect())
    assert held() == [(1, "none", 0), (2, "none", 5), (3, "202401", 0), (4, "none", 1)]
    moved = [(1, "2024-02-01", 2, 3), (2, "2024-01-01", 3, 3), (4, "2024-01-09", 4, 3)]
    io.upsert_predictions(spark, path, predictions(spark, moved))
    assert held() == [(1, "202402", 2), (2, "202401", 3), (3, "202401", 0), (4, "202401", 4)]


def test_upsert_takes_over_the_default_partition(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = predictions(spark, [(1, None, 0, 1), (2, None, 0, 1), (3, "2024-01-05", 0, 1)])
    rows.withColumn("month", F.date_format("source_created_at", "yyyyMM")).write.partitionBy(
        "month").parquet(path)
    io.upsert_predictions(spark, path, predictions(spark, [(1, None, 7, 2)]))
    assert sorted((r["source_id"], r["month"], r["pred_label_id"])
                  for r in spark.read.parquet(path).collect()) == [
        (1, "none", 7), (2, "none", 0), (3, "202401", 0)]


def test_scoring_batches_without_times_keep_earlier_ones(run, spark, tmp_path):
    path, out = str(tmp_path / "docs"), str(tmp_path / "out")
    for k in range(2):
        run.tables.documents.filter(f"doc_id % 2 = {k}").coalesce(1).write.mode("append").parquet(
            path)
    texts = st.read_stream(spark, path, 1).selectExpr(
        "'post' source_type", "doc_id source_id", "doc_id post_id",
        "cast(null as timestamp_ntz) source_created_at", "text text_raw")
    query = st.run_available(texts, "append", str(tmp_path / "state"),
                             st.scoring_sink(out, letter_scorer, "letters", clean_text))
    assert query.lastProgress["batchId"] >= 1
    scored = [r[0] for r in spark.read.parquet(out).select("source_id").collect()]
    assert sorted(scored) == sorted(
        r[0] for r in run.tables.documents.select("doc_id").collect())


def test_canonical_tables_resolve_versions(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, "old", "2024-01-01", "2024-01-01"), (1, "new", "2024-01-09", "2024-01-05")],
        "post_id long, text_raw string, last string, first string")
    df.selectExpr("post_id", "text_raw", "cast(last as timestamp_ntz) last_crawled_at",
                  "cast(first as timestamp_ntz) first_crawled_at").write.parquet(
        str(tmp_path / "post"))
    tables = canonical_tables(spark, str(tmp_path))
    row = tables.post.first()
    assert row["text_raw"] == "new" and str(row["first_crawled_at"]).startswith("2024-01-01")
    assert tables.post.count() == 1 and tables.post_versions.count() == 2


def test_contents_skip_bad_files(spark, tmp_path):
    spark.createDataFrame([("a",), (None,)], "text string").write.parquet(str(tmp_path / "a.parquet"))
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 not a table PAR1")
    paths = [str(tmp_path / "a.parquet"), str(tmp_path / "none.parquet"), "/x/y.zip",
             str(tmp_path / "broken.parquet")]
    assert [r[0] for r in io.read_contents(spark, paths).collect()] == ["a"]
    assert io.read_contents(spark, paths[1:3]) is None
    assert io.read_contents(spark, paths[3:]).count() == 0


def chunks(run, tmp_path, parts=4):
    """Events in several files, ordered by time, so that a stream sees several batches."""
    path = str(tmp_path / "events")
    for i in range(parts):
        run.tables.events.filter(F.expr(f"floor(event_id * {parts} / 1000) % {parts} = {i}")) \
            .coalesce(1).write.mode("append").parquet(path)
    return path


def test_daily_counts_in_batches_equal_the_batch_result(run, spark, tmp_path):
    path = chunks(run, tmp_path)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    counts = st.daily_counts(st.read_stream(spark, path, 1), "ts", "event_type", "100 days")
    query = st.run_available(counts, "update", state, st.change_sink(out))
    assert query.lastProgress["batchId"] >= 3
    def daily(df):
        return {(str(r["day"])[:10], r["event_type"]): r["n"] for r in df.collect()}
    want = daily(run.tables.events.groupBy(
        F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n")))
    assert daily(st.read_changes(spark, out, ["day", "event_type"])) == want
    st.run_available(counts, "update", state, st.change_sink(out))
    assert daily(st.read_changes(spark, out, ["day", "event_type"])) == want


def test_scoring_stream_skips_scored_samples(run, spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("docs", "out", "state"))
    docs = run.tables.documents
    docs.coalesce(1).write.parquet(path)
    docs.coalesce(1).write.mode("append").parquet(path)  # every document arrives twice
    texts = st.read_stream(spark, path, 1).selectExpr(
        "'post' source_type", "doc_id source_id", "doc_id post_id",
        "timestamp_ntz '2024-01-01 00:00:00' source_created_at", "text text_raw")
    sink = st.scoring_sink(out, letter_scorer, "letters", clean_text)
    st.run_available(texts, "append", state, sink)
    scored = spark.read.parquet(out)
    assert scored.count() == docs.count() == scored.select("source_id").distinct().count()


def test_new_checkpoint_neither_loses_nor_repeats_scores(run, spark, tmp_path):
    out = str(tmp_path / "out")
    for k, part in enumerate(("doc_id % 2 = 0", "doc_id % 3 = 0", "true", "true")):
        path = str(tmp_path / f"docs{k}")
        run.tables.documents.filter(part).coalesce(1).write.parquet(path)
        texts = st.read_stream(spark, path).selectExpr(
            "'post' source_type", "doc_id source_id", "doc_id post_id",
            "timestamp_ntz '2024-01-01 00:00:00' source_created_at", "text text_raw")
        st.run_available(texts, "append", str(tmp_path / f"state{k}"),
                         st.scoring_sink(out, letter_scorer, "letters", clean_text))
        seen = {r[0] for r in run.tables.documents.filter(
            " or ".join(("doc_id % 2 = 0", "doc_id % 3 = 0", "true")[:k + 1])).select(
            "doc_id").collect()}
        rows = [r[0] for r in spark.read.parquet(out).select("source_id").collect()]
        assert sorted(rows) == sorted(seen)


def test_new_prediction_tables_are_merged_and_written_once(spark, tmp_path, monkeypatch):
    written = []
    monkeypatch.setattr(io, "stored", lambda df, name: written.append(name) or df.localCheckpoint())
    when = dt.datetime(2024, 5, 1)
    rows = [("m", "post", k, when + dt.timedelta(days=20 * k), k, 1) for k in range(4)]
    new = spark.createDataFrame(rows + [("m", "post", 3, when, 9, 2)], """model_version string,
        source_type string, source_id long, source_created_at timestamp_ntz, pred_label_id int,
        predicted_at int""")
    path = str(tmp_path / "predictions")
    io.upsert_predictions(spark, path, new)
    assert written == ["fresh"]
    got = {(r["source_id"], r["pred_label_id"]) for r in spark.read.parquet(path).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 9)}
    index = io.key_index(spark, path)
    assert "202405" in index.months_with(new) and index.months_with(new, ["202405", "202406"]) == []


def test_daily_series_files_grow_in_number(spark, tmp_path, monkeypatch):
    run, seen = Run(spark, ROOT), []
    want = sorted(QUERIES["kpi_13"](spark, ROOT).collect())
    monkeypatch.setattr(sinks, "ROWS_PER_FILE", 1000)
    monkeypatch.setattr(sinks.st, "read_stream", lambda s, path, n, real=sinks.st.read_stream: seen.append(
        (len(s.read.parquet(path).inputFiles()), n)) or real(s, path, n))
    got = sorted(sinks.str_02_series(run).collect())
    files = 1 + run.tables.lineitem.count() // 1000
    assert files > 1 and seen == [(3 * files, files)]
    assert got == want
