import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.functions.pvalue import f_sf, t_sf2, with_f_sf
from stratum.operators import stats as S


@pytest.mark.parametrize("f,d1,d2,p", [(4.9646, 1, 10, 0.05), (3.2389, 3, 16, 0.05), (3.8416, 1, 500000, 0.05)])
def test_f_kernel_published_points(spark, f, d1, d2, p):
    r = spark.range(1).select(f_sf(F.lit(f), F.lit(d1), F.lit(d2)).alias("p")).first()["p"]
    assert abs(r - p) < 2e-4


def test_t_kernel_two_sided(spark):
    r = spark.range(1).select(t_sf2(F.lit(2.228), F.lit(10.0)).alias("p")).first()["p"]
    assert abs(r - 0.05) < 2e-4
    assert spark.range(1).select(t_sf2(F.lit(0.0), F.lit(5.0)).alias("p")).first()["p"] == pytest.approx(1.0)


def test_frame_kernel_equals_column_kernel(spark):
    df = spark.createDataFrame([("a", 2.0, 1.0, 7.5), ("b", 0.3, 2.0, 30.0), ("c", None, 1.0, 3.0)], "k string, f double, d1 double, d2 double")
    a = {r["k"]: r["p"] for r in df.select("k", f_sf("f", "d1", "d2").alias("p")).collect()}
    b = {r["k"]: r["p_value"] for r in with_f_sf(df, ["k"], "f", "d1", "d2").collect()}
    assert b["c"] is None and a["c"] is None
    for k in "ab":
        assert a[k] == pytest.approx(b[k], rel=1e-10)


def test_welch_matches_formula(spark):
    rng = np.random.default_rng(1)
    x0, x1 = rng.normal(0, 1, 30), rng.normal(0.8, 2, 20)
    rows = [(i, 0, float(v)) for i, v in enumerate(x0)] + [(100 + i, 1, float(v)) for i, v in enumerate(x1)]
    df = spark.createDataFrame(rows, "row_id long, label int, x double")
    r = S.welch_ttest_features(df, "label", ["x"]).first()
    se = math.sqrt(x0.var(ddof=1) / 30 + x1.var(ddof=1) / 20)
    assert r["t_statistic"] == pytest.approx((x0.mean() - x1.mean()) / se, rel=1e-9)
    assert r["mean_difference"] == pytest.approx(x1.mean() - x0.mean(), rel=1e-9)
    assert 0 <= r["p_value"] <= 1


def test_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert S.corr_matrix(df, ["a", "b"]).first()["corr"] is None


def test_anova_skips_single_level(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0)], "g string, v double")
    assert S.anova_oneway(df, ["g"], ["v"]).count() == 0
    df2 = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0), ("y", 7.0)], "g string, v double")
    r = S.anova_oneway(df2, ["g"], ["v"]).first()
    # SSB = 2·(1.5−3.75)² + 2·(6−3.75)² = 20.25 ; SSW = 0.5 + 2 = 2.5 ; F = 20.25 / (2.5 / 2)
    assert r["f_statistic"] == pytest.approx(16.2)


def test_ttest_paired_zero_variance_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 3.0), (3.0, 4.0)], "a double, b double")
    r = S.ttest_paired(df, "a", "b").first()
    assert r["t_statistic"] is None and r["significant"] is False
    assert r["better_method"] == "no significant difference"


def test_bootstrap_interval_and_draws(spark):
    rows = [(i, i % 2, 1 if i % 3 else i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, y int, yhat int")
    a = S.bootstrap_ci(df, n_boot=200).first()
    assert a["accuracy_ci_lower"] < a["accuracy"] < a["accuracy_ci_upper"]
    # the same interval at any partitioning, and draws with a Poisson's mean and variance at every mean
    assert S.bootstrap_ci(df.repartition(7), n_boot=200).first() == a
    for mean in (0.0, 1.0, 12.0, 900.0, 1e9):
        t = spark.range(20000).select(S.poisson_draw(F.lit(mean), F.rand(1), F.rand(2)).alias("k"))
        m, v = t.agg(F.avg("k"), F.var_samp("k")).first()
        assert m == pytest.approx(mean, rel=0.05, abs=1e-9) and v == pytest.approx(mean, rel=0.1, abs=1e-9)


def test_correlation_is_one_definition_at_every_width(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 45))
    x[:, 1] += x[:, 0]
    x[:, 7] = 3.25
    hole = rng.random(x.shape) < 0.05
    rows = [[None if h else float(v) for v, h in zip(r, hr)] for r, hr in zip(x, hole)]
    cols = [f"c{i}" for i in range(45)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    wide = {(r["a"], r["b"]): r["corr"] for r in S.corr_matrix(df, cols).collect()}
    few = {(r["a"], r["b"]): r["corr"] for r in S.corr_matrix(df, cols[:9]).collect()}
    assert len(wide) == 45 * 44 // 2
    for (a, b), r in few.items():
        assert wide[(a, b)] == (None if r is None else pytest.approx(r, rel=1e-9))
        both = ~hole[:, int(a[1:])] & ~hole[:, int(b[1:])]
        if "c7" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(x[both, int(a[1:])], x[both, int(b[1:])])[0, 1], rel=1e-9)


def test_exact_quantiles_distributed_path_equals_percentile(spark):
    from stratum.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(0)
    x = rng.lognormal(0, 2, 20000)
    x[::3] = 5.0                                  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, ["x"], probs, accuracy=100, small=50, bins=64)["x"]
    ref = list(df.agg(F.percentile("x", F.array(*[F.lit(p) for p in probs]))).first()[0])
    assert got == ref


def test_grouped_exact_quantiles_equal_percentile(spark):
    from stratum.operators.quantiles import grouped_exact_quantiles

    rng = np.random.default_rng(2)
    rows = [(("hot" if i % 3 else f"g{i % 7}"), float(np.round(rng.lognormal(), 3)) if i % 5 else 1.0)
            for i in range(6000)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.25, 0.5, 0.75, 0.9]
    got = {r["g"]: [r[f"q{k}"] for k in range(4)] for r in grouped_exact_quantiles(df, "g", "v", probs, 16).collect()}
    ref = {r["g"]: list(r["q"]) for r in df.groupBy("g").agg(
        F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).collect()}
    assert got.keys() == ref.keys()
    for g in ref:
        assert got[g] == pytest.approx(ref[g], rel=1e-12)
