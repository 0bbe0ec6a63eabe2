"""Queries for evaluation tables (I) on the ``scores`` binding."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.operators import metrics as I
from stratum.plans.catalog import register
from stratum.sources import bindings as bd

_CURVE_SQL = """
    g AS (SELECT {by} score, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos,
                 CAST(sum(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS neg
          FROM {src} WHERE score IS NOT NULL GROUP BY {by} score),
    c AS (SELECT *, sum(pos) OVER (PARTITION BY {part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
                 sum(neg) OVER (PARTITION BY {part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp FROM g),
    a AS (SELECT {by} sum(pos) AS P, sum(neg) AS N, sum(pos * fp) AS s1, sum(pos * neg) AS s2,
                 sum(pos * (tp / (tp + fp) + CASE WHEN (tp - pos) + (fp - neg) = 0 THEN 1.0
                      ELSE (tp - pos) / ((tp - pos) + (fp - neg)) END) / 2.0) AS s3
          FROM c GROUP BY {by_nocomma}),
    curve AS (SELECT {by} CASE WHEN P = 0 OR N = 0 THEN 0.0 ELSE 1.0 - (s1 - 0.5 * s2) / (P * N) END AS roc_auc,
                     CASE WHEN P = 0 THEN 0.0 ELSE s3 / P END AS pr_auc FROM a)"""


def curve_sql(src: str, by: str | None = None) -> str:
    if by:
        return _CURVE_SQL.format(by=f"{by},", part=by, src=src, by_nocomma=by)
    return _CURVE_SQL.format(by="", part="1", src=src, by_nocomma="()").replace("GROUP BY ()", "")


@register("accuracy", uses=("scores",), dbl=("accuracy",),
          sql="SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores")
def q_accuracy(spark, sf):
    return I.accuracy(bd.scores(spark, sf))


@register("confusion_matrix", uses=("scores",), sql="""
    SELECT a.l AS actual, p.l AS predicted,
           CAST((SELECT count(*) FROM scores s WHERE s.y = a.l AND s.yhat = p.l) AS BIGINT) AS count
    FROM (SELECT y AS l FROM scores UNION SELECT yhat FROM scores) a,
         (SELECT y AS l FROM scores UNION SELECT yhat FROM scores) p""")
def q_confusion_matrix(spark, sf):
    return I.confusion_matrix(bd.scores(spark, sf))


_PER_CLASS_SQL = """
    lv AS (SELECT y AS l FROM scores UNION SELECT yhat FROM scores),
    pc AS (SELECT CAST(lv.l AS VARCHAR) AS class,
             CAST(sum(CASE WHEN s.y = lv.l AND s.yhat = lv.l THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
             CAST(sum(CASE WHEN s.y <> lv.l AND s.yhat = lv.l THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
             CAST(sum(CASE WHEN s.y = lv.l AND s.yhat <> lv.l THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
             CAST(sum(CASE WHEN s.y = lv.l THEN 1 ELSE 0 END) AS BIGINT) AS support, count(*) AS n
           FROM lv, scores s GROUP BY lv.l),
    pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision,
                     coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall FROM pc),
    f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM pr)"""


@register("precision_recall_weighted", uses=("scores",), dbl=("precision", "recall", "f1"), ctes=_PER_CLASS_SQL,
          sql="""SELECT sum(precision * support) / sum(support) AS precision,
                        sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM f""")
def q_precision_recall_weighted(spark, sf):
    return I.precision_recall_weighted(bd.scores(spark, sf))


@register("classification_report", uses=("scores",), dbl=("precision", "recall", "f1"), ctes=_PER_CLASS_SQL, sql="""
    SELECT class, precision, recall, f1, support FROM f
    UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / max(n), max(n) FROM f
    UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), max(n) FROM f
    UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                     sum(f1 * support) / sum(support), max(n) FROM f""")
def q_classification_report(spark, sf):
    return I.classification_report(bd.scores(spark, sf))


@register("roc_auc", uses=("scores",), dbl=("roc_auc",), ctes=curve_sql("scores"), sql="SELECT roc_auc FROM curve")
def q_roc_auc(spark, sf):
    return I.roc_auc(bd.scores(spark, sf))


@register("pr_auc", uses=("scores",), dbl=("pr_auc",), ctes=curve_sql("scores"), sql="SELECT pr_auc FROM curve")
def q_pr_auc(spark, sf):
    return I.pr_auc(bd.scores(spark, sf))


def _methods(spark, sf):
    s = bd.scores(spark, sf)
    model = s.select(F.lit("model").alias("method"), "row_id", "y", "yhat", "score")
    majority = s.select(F.lit("majority").alias("method"), "row_id", "y", F.lit(1).alias("yhat"),
                        F.lit(1.0).alias("score"))
    return model.unionByName(majority)


_METHODS_SQL = """methods AS (SELECT 'model' AS method, row_id, y, yhat, score FROM scores
                  UNION ALL SELECT 'majority', row_id, y, 1, 1.0 FROM scores),"""


@register("compare_results", uses=("scores",), dbl=("value",), ctes=_METHODS_SQL + curve_sql("methods", "method"),
          sql="""SELECT method, 'Accuracy' AS metric, avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) AS value
                 FROM methods GROUP BY method
                 UNION ALL SELECT method, 'ROC-AUC', roc_auc FROM curve
                 UNION ALL SELECT method, 'PR-AUC', pr_auc FROM curve""")
def q_compare_results(spark, sf):
    wide, long = I.compare_results(_methods(spark, sf))
    return long


@register("summary_report", uses=("scores",), dbl=("accuracy", "roc_auc", "pr_auc", "baseline"),
          ctes=curve_sql("scores"), sql="""
    SELECT (SELECT count(*) FROM scores) AS n,
           (SELECT avg(CASE WHEN y = yhat THEN 1.0 ELSE 0.0 END) FROM scores) AS accuracy, roc_auc, pr_auc,
           (SELECT max(c) / sum(c) FROM (SELECT y, count(*) AS c FROM scores GROUP BY y)) AS baseline
    FROM curve""")
def q_summary_report(spark, sf):
    return I.summary_report(bd.scores(spark, sf))


@register("majority_baseline", uses=("scores",), dbl=("baseline",), sql="""
    SELECT arg_max(y, c * 1000000 - y) AS majority_class, max(c) / sum(c) AS baseline
    FROM (SELECT y, count(*) AS c FROM scores GROUP BY y)""")
def q_majority_baseline(spark, sf):
    return I.majority_baseline(bd.scores(spark, sf))


def _members(spark, sf):
    """Three deterministic member probabilities per document (fixed logistic forms)."""
    d = bd.docs(spark, sf)
    sig = lambda z: F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    base = d.select("row_id", F.col("label").alias("y"),
                    sig(F.lit(2.0) - F.lit(25.0) * F.col("upper_share")
                        + F.lit(0.3) * (F.log(F.col("n_chars")) - F.lit(7.3))).alias("m1"),
                    sig(F.lit(1.0) - F.lit(30.0) * F.col("upper_share")).alias("m2"),
                    sig(F.lit(0.5) * (F.log(F.col("n_chars")) - F.lit(7.0))).alias("m3"))
    return [base.select("row_id", "y", F.col(m).alias("p1")) for m in ("m1", "m2", "m3")]


@register("vote_soft_scores", uses=("docs",), dbl=("p1",), sql="""
    SELECT row_id, y, CAST(p1 > 0.5 AS INTEGER) AS yhat, p1 FROM (
      SELECT row_id, label AS y,
             (round(1.0 / (1.0 + exp(-(2.0 - 25.0 * upper_share + 0.3 * (ln(n_chars) - 7.3)))), 6)
              + round(1.0 / (1.0 + exp(-(1.0 - 30.0 * upper_share))), 6)
              + round(1.0 / (1.0 + exp(-(0.5 * (ln(n_chars) - 7.0)))), 6)) / 3.0 AS p1
      FROM docs)""")
def q_vote_soft_scores(spark, sf):
    """Soft vote of three fixed member probabilities (class 1 iff mean > 0.5)."""
    from stratum.operators.models import vote_soft

    return vote_soft(_members(spark, sf))
