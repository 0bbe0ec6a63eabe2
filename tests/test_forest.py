"""The forest stage: cells, trees grown in their task, storing, the contest's scores."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import features as E
from stratum.operators import models as H
from stratum.operators import trees as T
from stratum.operators.forest import ForestClassifier
from stratum.session import scratch_path
from stratum.sources.io import model_load, model_store

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    """Few distinct values, so that rows share cells; c is noise."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 3)), 1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    return spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                                 "row_id long, a double, b double, c double, label int").persist()


def cells(table):
    rows = table.withColumn("_y", F.col("label"))
    return T.cell_rows(T.bin_rows(rows, FEATS, T.bin_edges(rows, FEATS, 8), "row_id", ["_y"]))


def test_cells_count_rows(table):
    c = cells(table).collect()
    assert len(c) < 900 and sum(np.frombuffer(r["_w"], np.int64)[0] for r in c) == 900


def test_trees_grown_in_tasks_equal_levels(table):
    """Whole blocks in a task and a pass per level give the same trees."""
    here = T.laid_out(cells(table), tasks=3)
    spread = T.laid_out(cells(table), rows_per_task=100, tasks=1)
    assert T.whole_blocks(T.layout(here)) and not T.whole_blocks(T.layout(spread))
    a, b = (T.grow_forests(rows, 3, ["m"], trees=5, bins=8) for rows in (here, spread))
    assert len(a.feature) == len(b.feature) > 50
    todo = [(t, t) for t in range(5)]
    while todo:
        i, j = todo.pop()
        assert (a.feature[i], a.bin[i], a.tree[i]) == (b.feature[j], b.bin[j], b.tree[j]) and (a.stats[i] == b.stats[j]).all()
        if a.feature[i] >= 0:
            todo += [(a.left[i], b.left[j]), (a.left[i] + 1, b.left[j] + 1)]


def test_bootstrap_of_a_cell_is_that_of_its_rows():
    """Mean and variance of Poisson(n), below and above the pieces of a draw."""
    names, h = np.arange(1, 20_001, dtype=np.uint64), np.array([3, 7, 11, 13], np.uint64) * np.uint64(0x9E3779B97F4A7C15 >> 8)
    n = np.array([0, 1, 40, 200])
    w = T.bootstrap_weights(h, n, names)
    assert (w[0] == 0).all()
    for got, k in zip(w[1:], n[1:]):
        assert got.mean() == pytest.approx(k, rel=0.05) and got.var() == pytest.approx(k, rel=0.08)


def test_forest_is_stored_and_read(spark, table):
    m = H.fit_pipeline(table, FEATS, H.clf_forest(num_trees=20))
    again = model_load(model_store(m, scratch_path(spark, "forest")))
    p, q = (H.predict(x, table).orderBy("row_id").collect() for x in (m, again))
    assert p == q and np.mean([r["y"] == r["yhat"] for r in p]) > 0.95
    assert all(r["yhat"] == int(r["p1"] > 0.5) for r in p)
    imp = m.stages[-1].featureImportances.toArray()
    assert imp.sum() == pytest.approx(1) and imp[2] < min(imp[0], imp[1])
    assert E.select_features_by_importance(table, FEATS, num_trees=10)[0] == [f for _, f in sorted(zip(-imp, FEATS))][:2]


def test_missing_values_and_labels(table):
    holes = table.withColumn("a", F.when(F.col("row_id") % 7 == 0, None).otherwise(F.col("a")))
    p = H.predict(H.fit_pipeline(holes, FEATS, H.clf_forest(num_trees=10)), holes).collect()
    assert len(p) == 900 and all(0 <= r["p1"] <= 1 for r in p)
    with pytest.raises(ValueError):
        H.fit_pipeline(table.withColumn("label", F.col("label") * 2), FEATS, H.clf_forest(num_trees=2))


def test_depth_and_least_rows(table):
    rows = table.select(F.col("label").cast("double").alias("label"), *FEATS)
    v = H.VectorAssembler(inputCols=FEATS, outputCol="features").transform(rows)
    m = ForestClassifier(numTrees=3, maxDepth=2, minInstancesPerNode=50).fit(v)
    assert m.totalNumNodes <= 3 * 7 and m.stats[:, 0].min() >= 50


def test_contest_scores_by_cells(table):
    """Whole models per task and a pass per level give the same scores, one per fold of each repeat."""
    sets = {"original": table.select("row_id", *FEATS, "label"), "half": table.where("row_id % 2 = 0").select("row_id", *FEATS, "label")}
    got = {(r["method"], r["repeat"], r["fold"]): r["accuracy"] for r in H.balancing_fold_scores(sets, FEATS, repeats=2, k=3, trees=8, bins=8).collect()}
    assert len(got) == 12 and min(got.values()) > 0.8
    spread = T.laid_out
    try:
        T.laid_out = lambda rows: spread(rows, rows_per_task=100, tasks=1)
        far = {(r["method"], r["repeat"], r["fold"]): r["accuracy"] for r in H.balancing_fold_scores(sets, FEATS, repeats=2, k=3, trees=8, bins=8).collect()}
    finally:
        T.laid_out = spread
    assert far == got
