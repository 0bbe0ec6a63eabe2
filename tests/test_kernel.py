"""Landmark kernel map against the exact kernel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import models as H
from stratum.operators.kernel import apply_kernel_map, fit_kernel_map

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def points(spark):
    x = np.random.default_rng(5).normal(size=(240, 3)) * [1, 10, 0.1] + [0, 50, 0]
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "row_id long, a double, b double, c double").persist()


def mapped(df, kmap):
    rows = sorted(apply_kernel_map(df, kmap).select("row_id", "kernel_map").collect())
    return np.array([r["kernel_map"].toArray() for r in rows])


def exact(df, kmap):
    x = np.array([r["x"] for r in df.select("row_id", kmap.scaled().alias("x")).orderBy("row_id").collect()])
    return x, kmap.gram(x, x)


@pytest.mark.parametrize("kind", ["rbf", "poly"])
def test_error_falls_with_landmarks(points, kind):
    from stratum.operators.features import fit_scale

    scale, errors = fit_scale(points, COLS, "standard"), []
    for m in (4, 12, 48, 240):
        kmap = fit_kernel_map(points, COLS, kind, m, scale=scale, gamma=0.5)
        z = mapped(points, kmap)
        x, k = exact(points, kmap)
        errors.append(np.abs(z @ z.T - k).max())
        at = [int(np.abs(x - p).sum(axis=1).argmin()) for p in kmap.points]  # landmarks are rows: exact there
        assert len(kmap.points) <= m and np.allclose((z @ z.T)[at], k[at], atol=1e-3 * k.max())
    tiny = 1e-6 * errors[0]
    assert errors[0] > errors[1] and errors[1] >= errors[2] - tiny and errors[2] >= errors[3] - tiny and errors[3] < 1e-3 * errors[0]
    if kind == "poly":  # ten monomials: twelve drawn rows explain everything
        assert errors[2] < 1e-6 * errors[0]


def test_repeated_rows_nulls_and_empty(spark, points):
    same = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(50)] + [(90, None, float("nan"), float("inf")), (91, 5.0, 2.0, 3.0)],
                                 "row_id long, a double, b double, c double")
    kmap = fit_kernel_map(same, COLS, m=8, scale={"a": (1.0, 1.0), "b": (2.0, 1.0), "c": (3.0, 1.0)})
    assert len(kmap.points) == 2  # what is not there stands at the centre, where the fifty are
    z = mapped(same, kmap)
    assert np.allclose(z[:51] @ z[:51].T, 1) and np.isfinite(z).all()
    empty = same.where("row_id < 0")
    kmap = fit_kernel_map(empty, COLS)
    assert len(kmap.points) == 0 and apply_kernel_map(empty, kmap).count() == 0 and (mapped(same, kmap) == 0).all()
    clash = points.withColumn("_x", F.lit("mine")).withColumn("_z", F.lit(1))
    out = apply_kernel_map(clash, fit_kernel_map(clash, COLS, m=4))
    assert out.columns == [*clash.columns, "kernel_map"] and out.first()["_x"] == "mine"
    with pytest.raises(ValueError):
        fit_kernel_map(points, COLS, kind="sigmoid")


def test_draws_repeat_whatever_the_partitions(points):
    a, b = (fit_kernel_map(d, COLS, m=10).points for d in (points, points.repartition(7)))
    assert np.array_equal(a, b)


def test_no_python_in_the_map(points):
    plan = apply_kernel_map(points, fit_kernel_map(points, COLS, m=4))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_svm_on_landmarks_separates_rings(spark):
    x = np.random.default_rng(3).normal(size=(500, 2))
    rings = spark.createDataFrame([(i, float(a), float(b), int(a * a + b * b < 1.2)) for i, (a, b) in enumerate(x)],
                                  "row_id long, a double, b double, label int").persist()
    kmap = fit_kernel_map(rings, ["a", "b"], m=24)
    rows = apply_kernel_map(rings, kmap).persist()
    p = H.predict(H.fit_pipeline(rows, ["kernel_map"], H.clf_svm("rbf", C=10.0, max_iter=40), scaler=None), rows).collect()
    assert np.mean([r["y"] == r["yhat"] for r in p]) > 0.95
