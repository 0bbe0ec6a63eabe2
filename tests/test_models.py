"""Learners: properties of what they predict (values depend on the library's solvers)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import features as E
from stratum.operators import models as H
from stratum.operators import network as N

FEATS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(300) < 0.35).astype(int)
    x = rng.normal(size=(300, 4)) + y[:, None] * np.array([2.5, -1.5, 0.0, 1.0])
    x[:, 1] = x[:, 1] * 1000 + 5e4
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "row_id long, a double, b double, c double, d double, label int").persist()


def check(pred, floor):
    rows = pred.collect()
    ys = [r["y"] for r in rows]
    majority = max(np.mean(ys), 1 - np.mean(ys))
    assert len(rows) == 60 and all(0 <= r["p1"] <= 1 for r in rows)
    assert np.mean([r["y"] == r["yhat"] for r in rows]) >= max(majority, floor)
    return rows


@pytest.mark.parametrize("name", ["logistic", "tree", "forest", "svm", "poly"])
def test_learners(blobs, name):
    est = {"logistic": H.clf_logistic(), "tree": H.clf_tree(), "forest": H.clf_forest(num_trees=40), "svm": H.clf_svm("linear"),
           "poly": H.clf_svm("poly", C=1.2)}[name]
    rows = check(H.train_eval(blobs, FEATS, est), 0.75)
    if name in ("logistic", "svm", "poly"):  # the penalty follows the rows: probabilities separate the classes
        p = np.array([r["p1"] for r in rows])
        assert p.max() - p.min() > 0.5 and {r["yhat"] for r in rows} == {0, 1}


def test_penalty_is_one_over_c_n(blobs):
    train, _ = H.holdout(blobs)
    m = H.fit_pipeline(train, FEATS, H.clf_logistic(C=2.0))
    assert m.stages[-1].getRegParam() == pytest.approx(1 / (2.0 * train.count()))


def test_five_voters_on_one_split(blobs, monkeypatch):
    small = {"clf_forest": lambda seed=42: H.RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=10, seed=seed),
             "clf_gbt": lambda seed=42: H.GBTClassifier(featuresCol="features", labelCol="label", maxIter=5, seed=seed),
             "clf_boosted_deep": lambda seed=42: H.GBTClassifier(featuresCol="features", labelCol="label", maxIter=5, maxDepth=6, seed=seed),
             "clf_mlp": lambda n, seed=42: H.NetworkClassifier(hidden=8, max_iter=120, seed=seed),
             "clf_svm": (lambda svm: lambda kind, C=1.0: svm(kind, C, max_iter=15))(H.clf_svm)}
    for k, v in small.items():
        monkeypatch.setattr(H, k, v)
    train, test = H.holdout(blobs)
    models, scored = H.fit_members(train, test, FEATS, n_components=12)
    assert list(models) == H.VOTERS
    joins = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Join")
    assert joins(scored) == joins(test)  # none beside those that made the test rows
    rows = {r["row_id"]: r for r in scored.collect()}
    vote = check(H.vote_columns(scored, H.VOTERS), 0.75)
    for r in vote:
        mean = np.mean([rows[r["row_id"]][f"p_{n}"] for n in H.VOTERS])
        assert r["p1"] == pytest.approx(mean) and r["yhat"] == int(mean > 0.5)


def test_reduction_is_fitted_on_training_rows(blobs):
    out = H.compare_reduction(blobs, FEATS, est=H.clf_forest(num_trees=20)).orderBy("declared").collect()
    assert [r["approach"] for r in out] == H.APPROACHES and all(0.5 < r["accuracy"] <= 1 for r in out)
    train, test = H.holdout(blobs)
    tr, te, cols = H.reduced(train, test, FEATS, "pca")
    assert len(cols) >= 2  # scaled first: the wide column does not take all of the variance
    lo, hi = H.reduced(train, test, FEATS, "baseline")[0].agg(F.min("b"), F.max("b")).first()
    assert (lo, hi) == (0.0, 1.0)


def test_ica_recovers_sources(spark):
    """Mixed non-Gaussian sources (heavy and light tails): found up to sign and order, in tens of jobs."""
    rng = np.random.default_rng(1)
    src = np.column_stack([rng.laplace(size=2000), rng.uniform(-1, 1, 2000), rng.exponential(size=2000), rng.choice([-1.0, 1.0], 2000)])
    src = (src - src.mean(axis=0)) / src.std(axis=0)
    x = src @ rng.normal(size=(4, 4)).T * np.array([1, 100, 0.01, 5]) + 3
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double, d double")
    scaled = E.apply_scale(df, E.fit_scale(df, FEATS))
    out, info = E.ica_components(scaled, FEATS)
    assert info["converged"] and info["n_iter"] <= 60 and info["residual"] < 1e-4
    got = np.array([r[1:] for r in sorted((r["row_id"], *[r[f"IC{i}"] for i in range(1, 5)]) for r in out.collect())])
    c = np.abs(np.corrcoef(got.T, src.T)[:4, 4:])
    assert sorted(c.argmax(axis=0)) == [0, 1, 2, 3] and c.max(axis=0).min() > 0.97


def test_ica_of_gaussian_columns_is_a_rotation(blobs):
    """Near-Gaussian data: whatever it ends with is white; not converging is a stated result."""
    out, info = E.ica_components(E.apply_scale(blobs, E.fit_scale(blobs, FEATS)), FEATS, max_iter=40)
    assert info["n_iter"] <= 40 and info["converged"] == (info["residual"] < 1e-4) and out.count() == 300
    w = info["unmixing"]
    assert np.allclose(w @ w.T, np.eye(4), atol=1e-8)


def test_rotation_is_the_exponential():
    a = np.random.default_rng(0).normal(size=(5, 5))
    a = a - a.T
    term, total = np.eye(5), np.eye(5)
    for n in range(1, 60):
        term = term @ a / n
        total = total + term
    assert np.allclose(E._rotation(a), total)


@pytest.mark.parametrize("hidden", [5, (5,), (4, 3), (3, 4, 2)])
def test_network_gradient_against_differences(hidden):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(13, 3)), (rng.random(13) < 0.4).astype(float)
    w = N.start_weights(3, hidden, 1)
    assert len(w) == N.n_weights(N.layer_sizes(3, hidden))
    w = w + rng.normal(size=len(w)) * 0.1
    _, g = N.loss_and_gradient(w, x, y, 0.3, hidden)
    for k in range(len(w)):
        e = np.zeros(len(w))
        e[k] = 1e-6
        up, down = (N.loss_and_gradient(w + s * e, x, y, 0.3, hidden)[0] for s in (1, -1))
        assert g[k] == pytest.approx((up - down) / 2e-6, abs=1e-7)


@pytest.fixture(scope="module")
def rings(spark):
    """No line separates the classes."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    return spark.createDataFrame([(i, float(a), float(b), int(a * a + b * b < 1.2)) for i, (a, b) in enumerate(x)],
                                 "row_id long, a double, b double, label int").persist()


def test_network_separates_rings(rings):
    """In one task and averaged over several; probabilities spread over both classes."""
    for rows in (50_000, 150):
        est = H.NetworkClassifier(hidden=30, max_iter=400, rows_per_task=rows, rate=0.01)
        m = H.fit_pipeline(rings, ["a", "b"], est, scaler="standard")
        p = H.predict(m, rings).collect()
        assert np.mean([r["y"] == r["yhat"] for r in p]) > 0.95
        assert min(r["p1"] for r in p) < 0.1 and max(r["p1"] for r in p) > 0.9 and all(r["yhat"] == int(r["p1"] > 0.5) for r in p)
        assert 0 < m.stages[-1].passes <= 400 and np.isfinite(m.stages[-1].loss)
    again = H.predict(H.fit_pipeline(rings, ["a", "b"], est, scaler="standard"), rings).collect()
    assert {r["row_id"]: r["yhat"] for r in again} == {r["row_id"]: r["yhat"] for r in p}


def test_calibration_sees_out_of_fold_margins_only(rings):
    """With labels that are noise, in-sample margins of a rich map look informative; the
    curve fitted to out-of-fold margins is flat."""
    noise = rings.select("row_id", "a", "b", (F.xxhash64("row_id") % 2 == 0).cast("int").alias("label")).limit(120)
    rff = H.rff_features(noise, ["a", "b"], 60, gamma=4.0)
    cols = [f"rff{i}" for i in range(60)]
    stages = H.clf_svm("rbf", C=100.0, max_iter=40)
    m = H.fit_pipeline(rff, cols, stages, scaler=None)
    fitted = m.stages[-1]
    d = m.stages[0].transform(rff.withColumn("label", F.col("label").cast("double")))
    oof = H.OutOfFoldPlatt(stages[-1].estimator.copy({stages[-1].estimator.regParam: 1 / (100.0 * 120)}), "features").out_of_fold(d)
    got = oof.collect()
    assert len(got) == rff.count() and len({r["_fold"] for r in got}) == 3
    inside = fitted.model.transform(d).select("label", "rawPrediction").collect()
    auc = lambda y, s: np.mean([a > b for a, i in zip(s, y) if i for b, j in zip(s, y) if not j])
    assert auc([r["label"] for r in inside], [r["rawPrediction"][1] for r in inside]) > 0.7
    assert abs(auc([r["label"] for r in got], [r["_margin"] for r in got]) - 0.5) < 0.2
    p = [r["p1"] for r in H.predict(m, rff).collect()]
    assert max(p) - min(p) < 0.6


def test_candidates_on_folds(rings):
    """Every candidate has the mean of its folds' accuracies, computed here fit by fit."""
    grid = {str(h): H.NetworkClassifier(hidden=h, max_iter=200, rate=0.01) for h in ((30,), (12, 12))}
    out = {r["params"]: r for r in H.score_candidates(rings, ["a", "b"], grid, scaler="standard").collect()}
    assert set(out) == set(grid) and sum(r["is_best"] for r in out.values()) == 1 and min(r["mean_accuracy"] for r in out.values()) > 0.9
    d = H.kfold_stratified(rings, "label", 3, 0)
    one = [H.accuracy_of(H.predict(H.fit_pipeline(d.where(F.col("fold") != f), ["a", "b"], grid["(12, 12)"], scaler="standard"), d.where(F.col("fold") == f)))
           for f in range(3)]
    assert np.mean(one) == pytest.approx(out["(12, 12)"]["mean_accuracy"], abs=0.03)
    assert list(H.network_grid(4)) == [f"hidden={h}, alpha={a}" for h in ((50,), (100,), (50, 50)) for a in (0.0001, 0.001)]


class Table:
    """Scores written down: {(method, scaler): rows of (y, five probabilities)}."""

    def __init__(self, spark, reductions, voters):
        self.spark, self.red, self.vot, self.asked = spark, reductions, voters, []

    def correlations(self):
        return self.spark.createDataFrame([("a", "label", -0.9), ("b", "label", 0.5)], "a string, b string, corr double")

    def reductions(self):
        return self.spark.createDataFrame([(n, i, x) for i, (n, x) in enumerate(self.red.items())], "approach string, declared int, accuracy double")

    def voters(self, method, scaler):
        self.asked.append((method, scaler))
        names = ", ".join(f"p_{n} double, y_{n} int" for n in H.VOTERS)
        rows = [(i, y, *[v for p in ps for v in (p, int(p > 0.5))]) for i, (y, *ps) in enumerate(self.vot[method, scaler])]
        return self.spark.createDataFrame(rows, f"row_id int, y int, {names}")


def test_selection_rule(spark):
    good, bad, split = (1, 0.9, 0.9, 0.9, 0.9, 0.9), (1, 0.1, 0.1, 0.1, 0.1, 0.1), (1, 0.1, 0.6, 0.1, 0.6, 0.1)
    base = {"baseline": 0.8, "pca": 0.8, "ica": 0.7}
    last = lambda t: dict((r[0], r[1:]) for r in H.select_flow(t))
    t = Table(spark, base, {("baseline", "standard"): [good, bad], ("baseline", "minmax"): [good, bad]})
    got = last(t)  # equal scalers: standard; no voter above the vote: the vote
    assert got["correlation"] == ("a", -0.9) and got["chosen"] == ("ensemble", 0.5) and "scaler:minmax" in got
    t = Table(spark, base, {("baseline", "standard"): [good, bad], ("baseline", "minmax"): [good, good]})
    assert last(t)["chosen"] == ("ensemble", 1.0)
    t = Table(spark, {"baseline": 0.5, "pca": 0.6, "ica": 0.6}, {("pca", None): [good, split]})
    got = last(t)  # reduction wins: no scaler contest; two voters beat the vote: the first
    assert t.asked == [("pca", None)] and not any(s.startswith("scaler") for s in got)
    assert got["chosen"] == ("gbt", 1.0) and got["ensemble"] == ("vote_soft", 0.5)
