"""Classifier evaluation and run comparison (ML-06..14, ML-17..21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.labels import label_name
from tidemark.functions.numeric import MICRO, micros, ratio, round_to
from tidemark.operators.disagreement import label_grid
from tidemark.schema import LABELS

CASES = ("both_correct", "a_only_correct", "b_only_correct", "both_wrong")
IDS = range(len(LABELS))


def confusion_matrix(df: DataFrame, truth: str = "label_id", pred: str = "pred_label_id"
                     ) -> DataFrame:
    """36 rows: true_id, pred_id, n."""
    counts = df.groupBy(F.col(truth).alias("true_id"), F.col(pred).alias("pred_id")).agg(
        F.count("*").alias("n"))
    return label_grid(counts, "true_id", "pred_id")


def accuracy(df: DataFrame, truth: str = "label_id", pred: str = "pred_label_id") -> DataFrame:
    hit = F.count_if(F.col(truth) == F.col(pred))
    return df.agg(F.count("*").alias("samples"), round_to(ratio(hit, F.count("*")), 6)
                  .alias("accuracy"))


def per_class(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    def total(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    true, pred = F.col("true_id"), F.col("pred_id")
    rows = F.array(*[F.struct(
        F.lit(i).alias("label_id"), total((true == i) & (pred == i)).alias("hits"),
        total(true == i).alias("support"), total(pred == i).alias("predicted")) for i in IDS])
    cells = matrix.agg(rows.alias("rows")).select(F.inline("rows"))
    precision = ratio(F.col("hits"), F.col("predicted"))
    recall = ratio(F.col("hits"), F.col("support"))
    f1 = ratio(F.col("hits") * 2, F.col("support") + F.col("predicted"))
    return cells.withColumns({"precision": precision, "recall": recall, "f1": f1})


def macro_f1(classes: DataFrame) -> DataFrame:
    """Mean F1 over the classes present in truth or prediction."""
    present = (F.col("support") > 0) | (F.col("predicted") > 0)
    return classes.agg(round_to(F.avg(F.when(present, F.col("f1"))), 6).alias("macro_f1"))


def mean_cross_entropy(df: DataFrame, probs: str = "probs", truth: str = "label_id") -> DataFrame:
    """Average of -ln(p[true label])."""
    p = F.element_at(probs, (F.col(truth) + 1).cast("int"))
    return df.agg(round_to(ratio(F.sum(micros(-F.ln(p))), F.count("*") * float(MICRO)), 4)
                  .alias("loss"))


def top_confusions(matrix: DataFrame, k: int = 3) -> DataFrame:
    """The k largest off-diagonal cells; ties by true id, then predicted id."""
    return matrix.filter((F.col("true_id") != F.col("pred_id")) & (F.col("n") > 0)).orderBy(
        F.desc("n"), "true_id", "pred_id").limit(k)


# ------------------------------------------------------------------- two models
def compare_models(df: DataFrame, a: str = "a_pred_id", b: str = "b_pred_id",
                   truth: str = "label_id") -> DataFrame:
    """Correctness of both models, their agreement and the case of each sample."""
    a_ok, b_ok = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    case = (F.when(a_ok & b_ok, CASES[0]).when(a_ok, CASES[1]).when(b_ok, CASES[2])
            .otherwise(CASES[3]))
    return df.withColumns({
        "a_correct": a_ok, "b_correct": b_ok, "agree": F.col(a) == F.col(b), "case_type": case})


def disagreement_summary(compared: DataFrame) -> DataFrame:
    """Counts and rates of a two-model comparison in one aggregate."""
    n = F.count("*")
    differ = F.count_if(~F.col("agree"))

    def count(test: Column, name: str) -> Column:
        return F.count_if(test).alias(name)

    def rate(test: Column, base: Column, name: str) -> Column:
        return round_to(ratio(F.count_if(test), base), 6).alias(name)
    either = F.col("a_correct") | F.col("b_correct")
    return compared.agg(
        n.alias("samples"), rate(F.col("a_correct"), n, "a_accuracy"),
        rate(F.col("b_correct"), n, "b_accuracy"), count(F.col("agree"), "agreement_count"),
        rate(F.col("agree"), n, "agreement_rate"), differ.alias("disagreement_count"),
        rate(~F.col("agree"), n, "disagreement_rate"),
        *[count(F.col("case_type") == c, c) for c in CASES],
        rate(either, n, "oracle_accuracy"),
        rate(~F.col("agree") & F.col("a_correct"), differ, "disagreement_a_accuracy"),
        rate(~F.col("agree") & F.col("b_correct"), differ, "disagreement_b_accuracy"))


def second_only_by_label(compared: DataFrame, truth: str = "label_id") -> DataFrame:
    """Samples only the second model gets right, per true label, zeros included."""
    only = F.col("case_type") == CASES[2]
    counts = compared.agg(F.array(*[F.struct(
        F.lit(i).alias("label_id"), F.count_if(only & (F.col(truth) == i)).alias("n"))
        for i in IDS]).alias("rows"))
    return counts.select(F.inline("rows"))


# ------------------------------------------------------------------------- runs
def pick_runs(runs: DataFrame, pick: str = "best") -> DataFrame:
    """One run per (model, track): highest test macro-F1 or newest; the rest are kept as
    rejected."""
    if pick not in ("best", "latest"):
        raise ValueError("pick is 'best' or 'latest'")
    first = F.desc("test_macro_f1") if pick == "best" else F.desc("timestamp")
    w = Window.partitionBy("model", "track").orderBy(first, F.asc("name"))
    return runs.withColumn("picked", F.row_number().over(w) == 1)


def epoch_summary(epochs: DataFrame) -> DataFrame:
    """Total seconds, epochs run and the first epoch with the best macro-F1 of each run."""
    best = F.max_by("epoch", F.struct(F.col("macro_f1"), (-F.col("epoch")).alias("k")))
    seconds = F.sum(F.col("train_time_s") + F.col("eval_time_s"))
    return epochs.groupBy("name").agg(
        seconds.alias("total_time_s"), F.count("*").alias("epochs_run"),
        best.alias("best_epoch"), F.max("macro_f1").alias("best_macro_f1"))


def epoch_progress(epochs: DataFrame, patience: int = 2) -> DataFrame:
    """New-best flag, epochs since the last improvement and the early-stop point of each run.

    One row per epoch, so a run is a short group.
    """
    w = Window.partitionBy("name").orderBy("epoch")
    before = F.max("macro_f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = epochs.withColumn("new_best", before.isNull() | (F.col("macro_f1") > before))
    last = F.max(F.when(F.col("new_best"), F.col("epoch"))).over(w)
    at = F.row_number().over(w)
    placed = marked.withColumn("_at", at).withColumn("_last", F.max(
        F.when(F.col("new_best"), F.col("_at"))).over(w))
    return placed.withColumns({
        "best_epoch": last, "epochs_since_improve": F.col("_at") - F.col("_last"),
    }).withColumn("would_stop", F.col("epochs_since_improve") >= patience).drop("_at", "_last")


def confusion_cells(matrix: Column) -> Column:
    """(n, true_id, pred_id) of every cell of a nested matrix."""
    return F.flatten(F.transform(matrix, lambda row, i: F.transform(row, lambda n, j: F.struct(
        n.cast("bigint").alias("n"), i.alias("true_id"), j.alias("pred_id")))))


def worst_confusions(matrix: Column, k: int = 3) -> Column:
    """The k largest off-diagonal cells with label names; ties by true id, then predicted id."""
    wrong = F.filter(confusion_cells(matrix), lambda c: (c["true_id"] != c["pred_id"]) & (c["n"] > 0))
    ranked = F.array_sort(F.transform(wrong, lambda c: F.struct(
        (-c["n"]).alias("order"), c["true_id"], c["pred_id"], c["n"])))
    return F.transform(F.slice(ranked, 1, k), lambda c: F.struct(
        label_name(c["true_id"]).alias("true_label"), label_name(c["pred_id"]).alias("pred_label"),
        c["n"].alias("n")))


def quality_payload(reports: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Rounded metrics and label -> F1 map of each run, with the second model when compared.

    Reports with a ``confusion_matrix`` also bring it and its three worst confusions; a run without a
    report has nulls.
    """
    scores = F.transform("per_class_f1", lambda x: round_to(x))
    labels = F.array(*[F.lit(x) for x in LABELS])
    matrix = []
    if "confusion_matrix" in reports.columns:
        matrix = ["confusion_matrix", worst_confusions(F.col("confusion_matrix")).alias("top_confusions")]
    base = reports.select(
        "name", "samples", round_to(F.col("accuracy")).alias("accuracy"),
        round_to(F.col("macro_f1")).alias("macro_f1"),
        F.map_from_arrays(labels, scores).alias("per_class_f1"), *matrix)
    return base.join(comparisons, "name", "left")


def confusion_table(reports: DataFrame) -> DataFrame:
    """Long confusion table of runs: count and share of the true label's samples per cell."""
    cells = reports.select("name", F.inline(confusion_cells(F.col("confusion_matrix"))))
    rows = reports.select("name", F.posexplode("confusion_matrix").alias("true_id", "row")).select(
        "name", "true_id", F.aggregate("row", F.lit(0).cast("bigint"), lambda t, n: t + n).alias("total"))
    return cells.join(rows, ["name", "true_id"]).select(
        "name", label_name(F.col("true_id")).alias("true_label"),
        label_name(F.col("pred_id")).alias("pred_label"), "n",
        round_to(ratio(F.col("n"), F.col("total"))).alias("share"))


def class_table(reports: DataFrame) -> DataFrame:
    """Long per-class F1 table of runs."""
    return reports.select("name", F.posexplode("per_class_f1").alias("label_id", "f1")).select(
        "name", label_name(F.col("label_id")).alias("label"), round_to(F.col("f1")).alias("f1"))
