"""Learners at size: what their passes cost."""

import threading

import numpy as np
import pytest
from pyspark.ml.base import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from stratum.operators import models as H
from stratum.operators import network as N
from stratum.plans import q_features


def plain_adam(state, step, x, y, epochs, batch, rate, alpha, rng, hidden):
    """The steps written down one by one, nothing in place and nothing dropped."""
    w, m, v = state.copy()
    losses = []
    for _ in range(epochs):
        order, total = rng.permutation(len(x)), 0.0
        for a in range(0, len(x), batch):
            r = order[a:a + batch]
            layers, seen = N.parts(w, N.layer_sizes(x.shape[1], hidden)), [x[r]]
            for wi, bi in layers[:-1]:
                seen.append(np.maximum(seen[-1] @ wi + bi, 0))
            z = (seen[-1] @ layers[-1][0] + layers[-1][1])[:, 0]
            total += (np.logaddexp(0, z) - y[r] * z).sum() + alpha / 2 * sum((wi ** 2).sum() for wi, _ in layers)
            back, grads = ((1 / (1 + np.exp(-z)) - y[r]) / len(r))[:, None], []
            for (wi, _), below in zip(reversed(layers), reversed(seen)):
                grads = [(below.T @ back + alpha / len(r) * wi).ravel(), back.sum(axis=0), *grads]
                back = (back @ wi.T) * (below > 0)
            g, step = np.concatenate(grads), step + 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step) * m / (np.sqrt(v) + 1e-8)
        losses.append(total / len(x))
    return np.stack([w, m, v]), losses


@pytest.mark.parametrize("hidden", [(7,), (5, 4)])
def test_steps_in_place_are_the_plain_steps(hidden):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(230, 3)), (rng.random(230) < 0.4).astype(float)
    state = np.zeros((3, N.n_weights(N.layer_sizes(3, hidden))))
    state[0] = N.start_weights(3, hidden, 1)
    before = state.copy()
    got, losses = N.adam(state, 0, x, y, 60, 50, 1e-3, 1e-3, np.random.default_rng(2), hidden)
    want, plain = plain_adam(state, 0, x, y, 60, 50, 1e-3, 1e-3, np.random.default_rng(2), hidden)
    assert np.allclose(got, want, rtol=1e-7, atol=1e-12) and np.allclose(losses, plain) and (state == before).all()


def test_no_denormal_numbers_are_left():
    """Units that are never active: their weights shrink without end, and numbers that are too small to count
    would make every later step several times as long."""
    rng = np.random.default_rng(0)
    x, y = rng.random((64, 2)), (rng.random(64) < 0.5).astype(float)
    state = np.zeros((3, N.n_weights([2, 4, 1])))
    state[0] = N.start_weights(2, 4, 1)
    state[0][:8], state[0][8:12] = 0.001, -1.0  # dead from the start
    got, _ = N.adam(state, 0, x, y, 16_384, 64, 1e-3, 1e-4, rng, 4)
    assert np.isfinite(got).all() and not ((got != 0) & (np.abs(got) < 1e-300)).any()


def rows(spark, n=240):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 2))
    return spark.createDataFrame([(i, float(a), float(b), int(a + b + rng.normal() > 0)) for i, (a, b) in enumerate(x)],
                                 "row_id long, a double, b double, label int").persist()


def test_grid_search_equals_the_cross_validator(spark):
    d, grid = rows(spark), {"regParam": [10.0, 0.01, 1.0], "maxIter": [1, 20]}
    est = LogisticRegression(featuresCol="features", labelCol="label")
    best, tab = H.grid_search(d, ["a", "b"], est, grid)
    k = H.kfold_stratified(d.withColumn("label", F.col("label").cast("double")), "label", 3, 0)
    pg = ParamGridBuilder()
    for p, v in grid.items():
        pg = pg.addGrid(est.getParam(p), v)
    cv = CrossValidator(estimator=H.Pipeline(stages=[*H.assemble(k, ["a", "b"]), est]), estimatorParamMaps=pg.build(), numFolds=3, foldCol="fold",
                        evaluator=MulticlassClassificationEvaluator(metricName="accuracy")).fit(k)
    assert [r["mean_accuracy"] for r in tab.collect()] == pytest.approx(cv.avgMetrics)
    assert np.allclose(best.stages[-1].coefficients.toArray(), cv.bestModel.stages[-1].coefficients.toArray())


class Meeting(LogisticRegression):
    """Its fits on parts of the rows wait for one another."""
    all_here = None

    def _fit(self, dataset):
        if Meeting.all_here is not None:
            Meeting.all_here.wait()
        return super()._fit(dataset)


def test_fits_of_all_folds_are_under_way_together(spark, monkeypatch):
    est = Meeting(featuresCol="features", labelCol="label", maxIter=2)
    monkeypatch.setattr(Meeting, "all_here", threading.Barrier(6, action=lambda: setattr(Meeting, "all_here", None), timeout=60))
    _, tab = H.grid_search(rows(spark), ["a", "b"], est, {"regParam": [0.1, 1.0]})
    assert tab.count() == 2


def test_a_fold_without_rows_is_refused(spark):
    assert issubclass(Meeting, Estimator)
    with pytest.raises(ValueError):
        H.grid_search(rows(spark, 2), ["a", "b"], Meeting(featuresCol="features", labelCol="label"), {"regParam": [0.1]})


def test_texts_are_read_once_for_ica(spark, tmp_path):
    """Fits make dozens of passes; the rows they return come from what the first one left."""
    rng = np.random.default_rng(0)
    words = ["Alpha", "b2", "C", "delta 9", "EPS", "zeta7x"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(2, 60, 80)]
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = q_features.q_ica_components(spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" in plan and out.count() == 80
    assert plan.split("InMemoryRelation")[0].count("Relation [") == 0
