"""Contests of balanced sets and of families: the whole job, on rows of their own."""

import numpy as np
import pytest

from stratum.operators import models as H
from stratum.plans import q_models


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Documents with labels that their capitals tell, one class three times the other."""
    rng, d = np.random.default_rng(0), str(tmp_path_factory.mktemp("docs"))
    words = ["alpha", "b2", "c", "delta 9", "eps", "zeta7x"]
    docs, labels = [], []
    for i in range(240):
        good = int(i % 4 > 0)
        text = " ".join(w.upper() if rng.random() < (0.1 if good else 0.35) else w for w in rng.choice(words, int(rng.integers(3, 60))))
        docs.append((i, text, "en", "web", len(text)))
        labels.append((i, good, 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_every_balanced_set_is_trained_and_measured(spark, sf, monkeypatch):
    """All four sets, with their confusion matrices; what a fit reads is cut from the searches behind it."""
    monkeypatch.setattr(H, "clf_forest", lambda: H.ForestClassifier(numTrees=10))
    plans, fit = [], H.fit_pipeline

    def seen(train, *more):
        plans.append(train._jdf.queryExecution().optimizedPlan().toString())
        return fit(train, *more)

    monkeypatch.setattr(H, "fit_pipeline", seen)
    out = {r["dataset"]: r for r in q_models.q_train_eval_resampled(spark, sf).collect()}
    assert list(out) == ["original", "undersampled", "smote", "combined"]
    for r in out.values():
        assert r["tn"] + r["fp"] == 12 and r["fn"] + r["tp"] == 36
        assert r["accuracy"] == pytest.approx((r["tn"] + r["tp"]) / 48, abs=1e-6) and r["roc_auc"] > 0.6 and r["pr_auc"] > 0.6
    assert len(plans) == 4 and not any(w in p for p in plans for w in ("Join", "Window", "Union", "InMemoryRelation"))


def test_boosted_grid_in_tasks_is_the_librarys(spark):
    """Whole fits in tasks give what Spark ML's learner gives on the same cells, at every number of rounds."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(400, 2)), 1)
    d = spark.createDataFrame([(i, float(a), float(b), int(a * b + 0.3 * rng.normal() > 0)) for i, (a, b) in enumerate(x)],
                              "row_id long, a double, b double, label int").persist()
    grid = {"maxIter": [3, 8], "stepSize": [0.1, 0.3], "maxDepth": [2, 4]}
    best, got = H.grid_search_boosted(d, ["a", "b"], H.clf_gbt(), grid)
    _, want = H.grid_search(d, ["a", "b"], H.clf_gbt(), grid)
    got, want = ({r["params"]: r["mean_accuracy"] for r in t.collect()} for t in (got, want))
    assert list(got) == list(want) and len(got) == 8 and len(set(got.values())) > 2
    assert max(abs(got[p] - want[p]) for p in got) < 0.015
    m = H.fit_in_task(d, ["a", "b"], 3, 0.3, 6)
    mine, its = ({r["row_id"]: r for r in H.predict(x, d).collect()} for x in (H.PipelineModel([*H.assemble(d, ["a", "b"], scaler=None), m]),
                                                                               H.fit_pipeline(d, ["a", "b"], H.clf_gbt(6, 3, 0.3), scaler=None)))
    assert max(abs(mine[i]["p1"] - its[i]["p1"]) for i in its) < 1e-6 and all(r["yhat"] == int(r["p1"] > 0.5) for r in mine.values())
    assert H.accuracy_of(H.predict(best, d)) > 0.75


def test_every_family_is_tuned(spark, sf, monkeypatch):
    grids = H.reference_grids(4, 160)
    cut = {"forest": {"numTrees": [3, 5]}, "gbt": {"maxIter": [2], "maxDepth": [2, 3]}, "svm": grids["svm"][1], "boosted_deep": {"maxIter": [2, 3]}}
    monkeypatch.setattr(H, "reference_grids", lambda d, n: {k: (grids[k][0].copy({grids[k][0].maxIter: 5}) if k == "svm" else grids[k][0], g) for k, g in cut.items()})
    monkeypatch.setattr(H, "network_grid", lambda d: {"hidden=4": H.clf_mlp(d, 4, 5)})
    rows = q_models.q_tune_families(spark, sf).collect()
    n = {f: sum(r["family"] == f for r in rows) for f in dict.fromkeys(r["family"] for r in rows)}
    assert n == {"tree": 1, "forest": 2, "gbt": 2, "boosted_deep": 2, "mlp": 1, "svm_linear": 3, "svm_rbf": 3}
    assert all(0 <= r["mean_accuracy"] <= 1 for r in rows) and {r["family"] for r in rows if r["is_best"]} == set(n)


def test_fits_at_once_are_bounded_by_their_rows(spark, sf, monkeypatch):
    """With room for the rows of two fits no third one starts."""
    d = q_models._docs(spark, sf)
    monkeypatch.setattr(H, "KEPT", 2 * 8 * 5 * d.count())
    seen, many = [], H.side_by_side
    monkeypatch.setattr(H, "side_by_side", lambda jobs, threads=8: (seen.append(threads), many(jobs, threads))[1])
    H.grid_search(d, q_models.DOC_NUM, H.clf_tree(), {"maxDepth": [1, 2]})
    assert seen == [2]


def test_forests_of_a_contest_in_parts(spark):
    """As many forests at a time as ``held`` allows; the scores are those of all together."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 2)), 1)
    d = spark.createDataFrame([(i, float(a), float(b), int(a > b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double, label int").persist()
    whole, parts = (sorted(H.balancing_fold_scores({"all": d, "half": d.where("row_id % 2 = 0")}, ["a", "b"], repeats=2, k=2, trees=5, bins=8, held=held).collect())
                    for held in (1 << 25, 16 * 100))
    assert whole == parts and len(whole) == 8
