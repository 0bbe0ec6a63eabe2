import math

import pytest
from pyspark.sql import functions as F

from stratum.operators import clean as C
from stratum.operators import encode as D
from stratum.operators import profile as B


def test_missing_profile_all_null_and_constant(spark):
    df = spark.createDataFrame([(1, None, 5.0), (2, None, 5.0)], "row_id long, a double, c double")
    r = {x["column"]: x for x in B.missing_profile(df).collect()}
    assert set(r) == {"a"} and r["a"]["missing_share"] == 1.0


def test_describe_quantiles_linear(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 10]], "x double")
    r = B.describe(df, ["x"]).first()
    assert (r["q25"], r["q50"], r["q75"]) == (2.0, 3.0, 4.0)
    assert r["std"] == pytest.approx(3.5355339, rel=1e-6)


def test_histogram_last_bin_closed_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (10.0,)], "x double")
    h = {r["bin"]: r["count"] for r in B.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 1}


def test_class_balance_inf_when_no_positive(spark):
    df = spark.createDataFrame([(0,), (0,)], "label int")
    assert math.isinf(B.class_balance(df).first()["ratio"])


def test_kde_integrates_to_one(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 2, 3, 7, 8]], "x double")
    rows = sorted(B.kde_grid(df, "x").collect(), key=lambda r: r["point"])
    step = rows[1]["x"] - rows[0]["x"]
    assert sum(r["density"] for r in rows) * step == pytest.approx(1.0, abs=0.02)


def test_impute_mode_tie_smallest(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "b"), (4, "a"), (5, None)], "row_id long, c string")
    out = {r["row_id"]: r["c"] for r in C.impute_mode(df, ["c"]).collect()}
    assert out[5] == "a"


def test_impute_policy_branches(spark):
    rows = [(i, None if i % 20 == 0 else float(i), None if i % 4 == 0 else float(i)) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    out, pol = C.impute_policy(df)
    p = {r["column"]: r["strategy"] for r in pol.collect()}
    assert p == {"a": "mean", "b": "median"}
    assert out.where(F.col("a").isNull() | F.col("b").isNull()).count() == 0


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 100.0), (5, None)], "row_id long, x double")
    out, rep = C.clip_iqr(df, ["x"])
    vals = {r["row_id"]: r["x"] for r in out.collect()}
    assert vals[5] is None and vals[4] < 100.0
    assert rep.first()["n_outliers"] == 1


def test_zscore_skips_constant(spark):
    rows = [(i, float(i), 1.0) for i in range(20)] + [(99, 1000.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, x double, k double")
    out = C.filter_zscore(df, ["x", "k"])
    assert out.count() == 20


def test_null_out_inf(spark):
    df = spark.createDataFrame([(1, float("inf"), 1.0), (2, float("nan"), 1.0), (3, 2.0, 1.0)],
                               "row_id long, a double, b double")
    assert [r["row_id"] for r in C.null_out_inf(df, ["a", "b"]).collect()] == [3]


def test_adaptive_first_appearance_and_onehot(spark):
    df = spark.createDataFrame([(1, "y", "p"), (2, "x", "q"), (3, "y", "r"), (4, "x", "s"), (5, "x", "t"),
                                (6, "y", "u")], "row_id long, two string, many string")
    out = {r["row_id"]: r for r in D.adaptive_encode(df).collect()}
    assert out[1]["two"] == 0 and out[2]["two"] == 1
    assert "many_p" not in out[1] and out[2]["many_q"] == 1


def test_one_hot_null_and_stored_levels(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "zzz")], "row_id long, c string")
    out = {r["row_id"]: r.asDict() for r in D.one_hot(df, ["c"], levels={"c": ["a", "b"]}).collect()}
    assert out[2] == {"row_id": 2, "c_a": 0, "c_b": 0}
    assert out[3]["c_a"] == 0 and out[3]["c_b"] == 0


def test_label_encode_single_level(spark):
    df = spark.createDataFrame([(1, "k"), (2, "k")], "row_id long, c string")
    assert {r["c"] for r in D.label_encode(df).collect()} == {0}


def test_scaled_answers(spark):
    df = spark.createDataFrame([("3 (Moderate)",), ("abc",), (None,)], "v string")
    r = df.select(D.scaled_answer("v").alias("m"), D.leading_int("v").alias("i")).collect()
    assert [x["m"] for x in r] == [3, 0, 0]
    assert [x["i"] for x in r] == [3, None, None]


def test_kde_prebin_close_to_exact(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=3000)], "x double")
    ex = {r["point"]: r["density"] for r in B.kde_grid(df, "x").collect()}
    ap = {r["point"]: r["density"] for r in B.kde_grid(df, "x", prebin=2000).collect()}
    assert max(abs(ex[k] - ap[k]) for k in ex) < 1e-3


def test_kde_long_tail_close_to_unbinned(spark):
    import numpy as np

    # 4,096 bins of this range are 1.25 bandwidths wide
    v = F.when(F.col("id") == 0, 1e6).otherwise(F.col("id") % 7 * 10.0)
    rows = B.kde_grid(spark.range(200_000).select(v.alias("x")), "x").collect()
    values, counts = np.unique(np.r_[1e6, np.arange(1, 200_000) % 7 * 10.0], return_counts=True)
    mean = (values * counts).sum() / 200_000
    bw = np.sqrt((counts * (values - mean) ** 2).sum() / 199_999) * 200_000 ** -0.2
    for r in rows:
        exact = (counts * np.exp(-0.5 * ((r["x"] - values) / bw) ** 2)).sum() / (200_000 * bw * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(exact, rel=0.12, abs=1e-12)
