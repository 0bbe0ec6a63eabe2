import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import metrics as I
from stratum.operators import sampling as G
from stratum.operators.neighbors import knn


def _brute_knn(pts, k):
    out = {}
    for i, a in pts.items():
        d = sorted((sum((x - y) ** 2 for x, y in zip(a, b)), j) for j, b in pts.items() if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("seed,dups", [(0, False), (1, True)])
def test_knn_equals_brute_force(spark, seed, dups):
    rng = np.random.default_rng(seed)
    X = rng.lognormal(0, 1, size=(120, 3))
    if dups:
        X[60:90] = X[0]          # a block of identical points (ties broken by id)
    pts = {i: tuple(map(float, X[i])) for i in range(len(X))}
    df = spark.createDataFrame([(i, *v) for i, v in pts.items()], "row_id long, a double, b double, c double")
    got = {}
    for r in knn(df, "row_id", ["a", "b", "c"], 5).collect():
        got.setdefault(r["q_id"], {})[r["nn_rank"]] = r["nn_id"]
    exp = _brute_knn(pts, 5)
    assert {q: [v[i] for i in range(5)] for q, v in got.items()} == exp


def test_split_is_partition_and_stratified(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(700)], "row_id long, label int")
    s = G.split_stratified(df, "label", 0.2, 42)
    assert s.count() == 700
    c = {(r["label"], r["is_test"]): r["count"] for r in s.groupBy("label", "is_test").count().collect()}
    assert c[(1, True)] == 20 and c[(0, True)] == 120


def test_folds_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(103)], "row_id long, label int")
    f = G.kfold_stratified(df, "label", 5)
    sizes = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in sizes)


def test_smote_count_and_segments(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(x), float(y), 1 if i < 12 else 0) for i, (x, y) in enumerate(rng.normal(size=(60, 2)))]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    out = G.smote(df, ["a", "b"], "label", 1.0, k=5)
    assert out.where("label = 1").count() == 48
    syn = out.where("synthetic").collect()
    mino = np.array([[r[1], r[2]] for r in rows if r[3] == 1])
    lo, hi = mino.min(0), mino.max(0)
    for r in syn:                     # synthetic points lie inside the minority bounding box
        assert lo[0] - 1e-9 <= r["a"] <= hi[0] + 1e-9 and lo[1] - 1e-9 <= r["b"] <= hi[1] + 1e-9


def test_smote_minority_smaller_than_k(spark):
    rows = [(i, float(i), 1 if i < 3 else 0) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, a double, label int")
    assert G.smote(df, ["a"], "label", 1.0, k=5).where("label = 1").count() == 17


def test_tomek_removes_mutual_opposite_pairs(spark):
    rows = [(1, 0.0, 0), (2, 0.1, 1), (3, 5.0, 0), (4, 5.05, 0), (5, 9.0, 1), (6, 20.0, 1)]
    df = spark.createDataFrame(rows, "row_id long, a double, label int")
    links = {(r["a"], r["b"]) for r in G.tomek_links(df, ["a"]).collect()}
    assert links == {(1, 2)}
    assert sorted(r["row_id"] for r in G.tomek_clean(df, ["a"]).collect()) == [3, 4, 5, 6]


def test_undersample_ratio(spark):
    df = spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "row_id long, label int")
    out = G.undersample_random(df, "label", 0.5)
    assert out.where("label = 0").count() == 20 and out.where("label = 1").count() == 10


def test_roc_all_equal_scores_is_half(spark):
    df = spark.createDataFrame([(i, i % 2, 1, 0.7) for i in range(10)], "row_id long, y int, yhat int, score double")
    r = I.curve_areas(df).first()
    assert r["roc_auc"] == pytest.approx(0.5)


def test_roc_pr_match_bruteforce(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200), 2)
    df = spark.createDataFrame([(i, int(a), int(b >= .5), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "row_id long, y int, yhat int, score double")
    r = I.curve_areas(df).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > q) + 0.5 * (p == q) for p, q in itertools.product(pos, neg)])
    assert r["roc_auc"] == pytest.approx(auc)
    # PR: trapezoid over thresholds (descending) starting at (0, 1)
    pts = [(0.0, 1.0)]
    for t in sorted(set(s), reverse=True):
        tp, fp = ((s >= t) & (y == 1)).sum(), ((s >= t) & (y == 0)).sum()
        pts.append((tp / len(pos), tp / (tp + fp)))
    pr = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
    assert r["pr_auc"] == pytest.approx(pr)


def test_confusion_keeps_zero_cells(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 0, 0)], "row_id long, y int, yhat int")
    cm = I.confusion_matrix(df, labels=[0, 1]).collect()
    assert len(cm) == 4 and sum(r["count"] for r in cm) == 2


def test_classification_report_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0), (2, 1, 0)], "row_id long, y int, yhat int")
    rep = {r["class"]: r for r in I.classification_report(df).collect()}
    assert rep["1"]["precision"] == 0.0 and rep["accuracy"]["f1"] == 0.5


def test_knn_hot_copy_group(spark):
    """A third of the points are one copy group: exact results, no pairwise copies."""
    rng = np.random.default_rng(11)
    X = rng.normal(size=(90, 2))
    X[::3] = X[0]
    pts = {i: tuple(map(float, X[i])) for i in range(len(X))}
    df = spark.createDataFrame([(i, *v) for i, v in pts.items()], "row_id long, a double, b double")
    got = {}
    for r in knn(df, "row_id", ["a", "b"], 3).collect():
        got.setdefault(r["q_id"], {})[r["nn_rank"]] = r["nn_id"]
    exp = _brute_knn(pts, 3)
    assert {q: [v[i] for i in range(3)] for q, v in got.items()} == exp


def test_smote_makes_exactly_what_is_missing(spark):
    """need < n_min: rows of rank >= need serve no draw."""
    rows = [(i, float(i), float(i % 7), int(i >= 15)) for i in range(25)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    out = G.smote(df, ["a", "b"], "label", 1.0, k=3)
    assert out.where("synthetic").count() == 5 and out.where("label = 1").count() == 15


def test_knn_index_limits_cells_and_prunes(spark):
    """Clusters, a dense spot and far points: no cell above the limit, few candidates, exact neighbours."""
    import numpy as np

    from stratum.operators.neighbors import index_report

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.05, size=(60, 3)) for c in rng.uniform(-10, 10, size=(20, 3))]
                  + [rng.normal(0, 1e-4, size=(500, 3)), rng.uniform(-1e6, 1e6, size=(40, 3))])
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, c double").repartition(4)
    r = index_report(df, "row_id", ["a", "b", "c"], 5, cell=24).first()
    assert r["points"] == len(x) and r["largest_cell"] <= 24 and r["candidates"] < 100 and r["cells"] > 1740 / 24
    got = {}
    for q in knn(df, "row_id", ["a", "b", "c"], 5, cell=24).collect():
        got.setdefault(q["q_id"], {})[q["nn_rank"]] = q["nn_id"]
    for i in range(0, len(x), 7):
        d = ((x[i, 0] - x[:, 0]) ** 2 + (x[i, 1] - x[:, 1]) ** 2) + (x[i, 2] - x[:, 2]) ** 2
        d[i] = np.inf
        assert [got[i][k] for k in range(5)] == np.lexsort((np.arange(len(x)), d))[:5].tolist()
