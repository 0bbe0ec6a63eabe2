"""Boosted trees on cells of equal bins: the library's learner on rows binned the same way."""

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stratum.operators import models as H
from stratum.operators.boosted import binned

FEATS = ["a", "b"]


def table(spark, n, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, (n, 2)).astype(float)
    y = (rng.random(n) < np.where(x[:, 0] * x[:, 1] > 6, 0.9, 0.1)).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
                                 "row_id long, a double, b double, label int").persist()


def test_cells_give_what_rows_give(spark):
    """Few values: the library's own bins on rows are the values too, so probabilities are equal."""
    d = table(spark, 700)
    got = {r["row_id"]: r["p1"] for r in H.predict(H.fit_pipeline(d, FEATS, H.clf_gbt(max_iter=8)), d).collect()}
    plain = GBTClassifier(featuresCol="features", labelCol="label", maxIter=8, maxDepth=3, stepSize=0.1, seed=42)
    want = {r["row_id"]: r["p1"] for r in H.predict(H.fit_pipeline(d, FEATS, plain), d).collect()}
    assert len(got) == 700 and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_same_bins_as_the_library_up_to_its_sample(spark):
    """Many values, one of them frequent: probabilities are those of the library on rows."""
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.lognormal(size=600), np.where(rng.random(600) < 0.5, 0.0, rng.random(600))])
    y = (rng.random(600) < np.where(x[:, 0] * (x[:, 1] + 0.3) > 0.5, 0.9, 0.1)).astype(int)
    d = spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(x, y))],
                              "row_id long, a double, b double, label int")
    got = {r["row_id"]: r["p1"] for r in H.predict(H.fit_pipeline(d, FEATS, H.clf_gbt(max_iter=6, max_depth=4)), d).collect()}
    plain = GBTClassifier(featuresCol="features", labelCol="label", maxIter=6, maxDepth=4, stepSize=0.1, seed=42)
    want = {r["row_id"]: r["p1"] for r in H.predict(H.fit_pipeline(d, FEATS, plain), d).collect()}
    assert len(got) == 600 and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_rounds_read_cells_not_rows(spark, monkeypatch):
    """What the rounds run over does not grow with the rows: 36 cells a class at most."""
    seen = []
    fit = GBTClassifier._fit
    monkeypatch.setattr(GBTClassifier, "_fit", lambda self, rows: (seen.append(rows.agg(F.count(F.lit(1)), F.sum("_n")).first()), fit(self, rows))[1])
    H.fit_pipeline(table(spark, 900), FEATS, H.clf_gbt(max_iter=1))
    assert len(seen) == 1 and seen[0][0] <= 72 and seen[0][1] == 900


def test_bins_are_those_of_searchsorted(spark):
    edges = [np.array([0.0, 1.0, 2.5]), np.array([])]
    x = [float("-inf"), -1.0, 0.0, 0.5, 1.0, 2.5, 3.0, float("nan"), float("inf")]
    d = spark.createDataFrame([(v, 7.0) for v in x], "a double, b double").select("a", array_to_vector(F.array("a", "b")).alias("v"))
    got = [r[0] for r in d.select(binned(vector_to_array("v"), edges)).collect()]
    assert got == [[float(np.searchsorted(edges[0], v)), 0.0] for v in x]


def test_missing_values_are_scored(spark):
    d = table(spark, 200)
    holes = d.withColumn("a", F.when(F.col("row_id") % 7 == 0, None).otherwise(F.col("a")))
    out = H.predict(H.fit_pipeline(holes, FEATS, H.clf_gbt(max_iter=3)), holes).collect()
    assert len(out) == 200 and all(0 <= r["p1"] <= 1 for r in out)
