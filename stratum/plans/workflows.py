"""End-to-end compositions of the reference's pipelines built from
the operators; each returns small result tables, the data stays in Spark.

* ``balancing_contest`` — pipeline 1: stratified split → undersampling, SMOTE,
  SMOTE+Tomek on the training rows → min-max + forest per balanced set →
  Accuracy / ROC-AUC / PR-AUC on the same test rows → choice (strictly best
  accuracy; ties → the hybrid).
* ``significance_report`` — pipeline 2: feature t-tests, majority baseline
  and bootstrap interval of a scored test set, as one summary table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import metrics as I
from stratum.operators import models as H
from stratum.operators import sampling as G
from stratum.operators import stats as S
from stratum.functions.exprs import merge_one_row
from stratum.session import cut_lineage

ORDER = ["undersampled", "smote", "smote_tomek"]


def balancing_contest(df: DataFrame, feats: list[str], label: str = "label", key: str = "row_id", seed: int = 42,
                      num_trees: int = 200, max_depth: int = 30):
    """Returns (wide comparison, long comparison, chosen method as a one-row frame)."""
    base = df.select(key, *feats, F.col(label).cast("int").alias("label"))
    s = cut_lineage(G.split_stratified(base, "label", 0.2, seed, key))
    train, test = s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")
    sets = {
        "undersampled": G.undersample_random(train, "label", 1.0, seed, key),
        "smote": G.smote(train, feats, "label", 1.0, 5, seed, key).drop("synthetic"),
        "smote_tomek": G.smote_tomek(train, feats, "label", 5, seed, key).drop("synthetic"),
    }
    preds = None
    for name in ORDER:
        m = H.fit_pipeline(sets[name], feats, H.clf_forest(num_trees=num_trees, max_depth=max_depth, seed=seed))
        p = H.predict(m, test, key).select(F.lit(name).alias("method"), key, "y", "yhat", F.col("p1").alias("score"))
        preds = p if preds is None else preds.unionByName(p)
    wide, long = I.compare_results(preds)
    declared = F.create_map(*[x for i, n in enumerate(ORDER) for x in (F.lit(n), F.lit(i))])
    # strictly best accuracy wins; ties go to the hybrid (last declared)
    choice = wide.orderBy(F.col("accuracy").desc(), declared[F.col("method")].desc()).limit(1).select(
        F.col("method").alias("chosen"), "accuracy")
    return wide, long, choice


def significance_report(scored: DataFrame, features: DataFrame, feats: list[str], label: str = "label",
                        n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """One row: #features, #significant (raw and Bonferroni), accuracy with its
    bootstrap interval, majority baseline and the replica t-test p-value."""
    t = S.welch_ttest_features(features, label, feats)
    sig = t.agg(F.count(F.lit(1)).alias("n_features"),
                F.sum(F.col("significant").cast("int")).alias("n_significant"),
                F.sum(F.col("bonferroni_significant").cast("int")).alias("n_bonferroni"))
    b = S.bootstrap_ci(scored, n_boot=n_boot, seed=seed)
    return merge_one_row(sig, b)
