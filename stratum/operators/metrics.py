"""I. Evaluation tables over scored rows ``(row_id, y, yhat, score)``.

Curves (ROC / PR) are computed from score-grouped counts: rows collapse to
one row per distinct score (partial aggregation), then exact cumulative
counts come from ``running_totals`` (range-partitioned, no single-partition
window).  Every metric accepts ``by`` to evaluate many methods in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.exprs import merge_one_row, safe_div, stack
from stratum.operators.windows import running_totals


def accuracy(df: DataFrame, y="y", yhat="yhat", by: list[str] | None = None) -> DataFrame:
    by = by or []
    return df.groupBy(*by).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))


MAX_CLASSES = 1000


def _labels(df: DataFrame, y: str, yhat: str) -> list:
    """Class levels (the label domain; refused beyond ``MAX_CLASSES``)."""
    a = df.select(F.col(y).alias("l")).union(df.select(F.col(yhat).alias("l"))).distinct()
    got = a.limit(MAX_CLASSES + 1).collect()
    if len(got) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification label")
    return sorted(r["l"] for r in got if r["l"] is not None)


def _cells(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """(actual, predicted, count) for the non-empty cells: one partial aggregation
    whose output is bounded by classes²."""
    return (df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull())
            .groupBy(F.col(y).alias("actual"), F.col(yhat).alias("predicted")).agg(F.count(F.lit(1)).alias("count")))


def confusion_matrix(df: DataFrame, y="y", yhat="yhat", labels: list | None = None) -> DataFrame:
    """Long confusion table (actual, predicted, count) with zero cells kept."""
    labels = labels if labels is not None else _labels(df, y, yhat)
    spark = df.sparkSession
    lv = F.array(*[F.lit(v) for v in labels])
    # the label grid is generated from the bounded label list (no join of two tables)
    grid = spark.range(1).select(F.explode(lv).alias("actual")).select("actual", F.explode(lv).alias("predicted"))
    return grid.join(_cells(df, y, yhat), ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("count", F.lit(0).cast("long")).alias("count"))


def _per_class(df: DataFrame, y: str, yhat: str, labels: list) -> DataFrame:
    """(class, tp, fp, fn, support, n, precision, recall, f1) from the cell counts."""
    c = _cells(df, y, yhat)
    spark = df.sparkSession
    lv = spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in labels])).alias("cls"))
    tp = c.where(F.col("actual") == F.col("predicted")).select(F.col("actual").alias("cls"), F.col("count").alias("tp"))
    sup = c.groupBy(F.col("actual").alias("cls")).agg(F.sum("count").alias("support"))
    pred = c.groupBy(F.col("predicted").alias("cls")).agg(F.sum("count").alias("npred"))
    t = (lv.join(tp, "cls", "left").join(sup, "cls", "left").join(pred, "cls", "left")
         .select("cls", *[F.coalesce(F.col(k), F.lit(0).cast("long")).alias(k) for k in ("tp", "support", "npred")]))
    # n = all scored rows: the sum of the (non-null) cell counts, as a window over ≤ classes rows
    n = F.sum("support").over(Window.partitionBy(F.lit(0)))
    t = t.select(F.col("cls").cast("string").alias("class"), "tp", (F.col("npred") - F.col("tp")).alias("fp"),
                 (F.col("support") - F.col("tp")).alias("fn"), "support", n.alias("n"))
    prec = F.coalesce(safe_div("tp", F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(safe_div("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    t = t.select("*", prec.alias("precision"), rec.alias("recall"))
    f1 = F.coalesce(safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return t.withColumn("f1", f1)


def precision_recall_weighted(df: DataFrame, y="y", yhat="yhat", labels: list | None = None) -> DataFrame:
    """Support-weighted precision, recall and F1 (0/0 → 0)."""
    labels = labels if labels is not None else _labels(df, y, yhat)
    t = _per_class(df, y, yhat, labels)
    s = F.sum("support")
    return t.agg(safe_div(F.sum(F.col("precision") * F.col("support")), s).alias("precision"),
                 safe_div(F.sum(F.col("recall") * F.col("support")), s).alias("recall"),
                 safe_div(F.sum(F.col("f1") * F.col("support")), s).alias("f1"))


def classification_report(df: DataFrame, y="y", yhat="yhat", labels: list | None = None) -> DataFrame:
    """Per class precision/recall/f1/support + 'accuracy', 'macro avg', 'weighted avg' rows."""
    labels = labels if labels is not None else _labels(df, y, yhat)
    t = _per_class(df, y, yhat, labels)
    per = t.select("class", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    summ = t.agg(F.sum("tp").alias("tp"), F.first("n").alias("n"),
                 F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                 safe_div(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                 safe_div(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                 safe_div(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    rows = F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), safe_div("tp", "n").alias("f1"),
                 F.col("n").cast("long").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                 F.col("mf").alias("f1"), F.col("n").cast("long").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                 F.col("wf").alias("f1"), F.col("n").cast("long").alias("support")))
    return per.unionByName(summ.select(F.inline(rows)))


def _score_counts(df: DataFrame, y: str, score: str, by: list[str]) -> DataFrame:
    return (df.where(F.col(score).isNotNull())
            .groupBy(*by, F.col(score).cast("double").alias("_s"))
            .agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) != 1).cast("long")).alias("neg")))


def curve_areas(df: DataFrame, y="y", score="score", by: list[str] | None = None) -> DataFrame:
    """roc_auc (tie-aware Mann–Whitney) and pr_auc (trapezoid over the precision–recall
    curve including (recall 0, precision 1)); 0 when a class is absent."""
    by = by or []
    g = _score_counts(df, y, score, by)
    c = running_totals(g, "_s", ["pos", "neg"], descending=True, by=by)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    p_now = safe_div(tp, tp + fp)
    p_prev = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(safe_div(tp0, tp0 + fp0))
    a = c.groupBy(*by).agg(
        F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"),
        F.sum(F.col("pos") * fp).cast("double").alias("s1"),
        F.sum(F.col("pos") * F.col("neg")).cast("double").alias("s2"),
        F.sum(F.col("pos") * (p_now + p_prev) / 2.0).alias("s3"))
    roc = F.when((F.col("P") == 0) | (F.col("N") == 0), F.lit(0.0)).otherwise(
        F.lit(1.0) - (F.col("s1") - 0.5 * F.col("s2")) / (F.col("P") * F.col("N")))
    pr = F.when(F.col("P") == 0, F.lit(0.0)).otherwise(F.col("s3") / F.col("P"))
    return a.select(*by, roc.alias("roc_auc"), pr.alias("pr_auc"))


def roc_auc(df: DataFrame, y="y", score="score", by: list[str] | None = None) -> DataFrame:
    return curve_areas(df, y, score, by).select(*(by or []), "roc_auc")


def pr_auc(df: DataFrame, y="y", score="score", by: list[str] | None = None) -> DataFrame:
    return curve_areas(df, y, score, by).select(*(by or []), "pr_auc")


def compare_results(df: DataFrame, method: str = "method", y="y", yhat="yhat", score="score") -> tuple[DataFrame, DataFrame]:
    """Per-method Accuracy / ROC-AUC / PR-AUC, wide and long (method, metric, value)."""
    acc = accuracy(df, y, yhat, by=[method])
    cur = curve_areas(df, y, score, by=[method])
    wide = acc.join(cur, method).select(method, "accuracy", "roc_auc", "pr_auc")
    long = wide.select(method, F.inline(stack([("Accuracy", F.col("accuracy")), ("ROC-AUC", F.col("roc_auc")),
                                               ("PR-AUC", F.col("pr_auc"))], "metric", "value")))
    return wide, long


def majority_baseline(df: DataFrame, y="y") -> DataFrame:
    """Share of the most frequent class (ties → smallest class)."""
    g = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.max_by("cls", F.struct(F.col("c"), -F.col("cls"))).alias("majority_class"),
                 (F.max("c") / F.sum("c")).alias("baseline"))


def summary_report(df: DataFrame, y="y", yhat="yhat", score="score") -> DataFrame:
    """One combined row: n, accuracy, roc_auc, pr_auc, majority baseline."""
    acc = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("accuracy"))
    return merge_one_row(acc, curve_areas(df, y, score), majority_baseline(df, y).select("baseline"))
