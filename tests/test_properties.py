"""Property-based checks (hypothesis) on generated inputs."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.functions.pvalue import t_sf2
from stratum.operators.neighbors import knn
from stratum.operators.sampling import kfold_stratified, split_stratified

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

coords = st.integers(min_value=-5, max_value=5).map(float)      # coarse grid → many ties and copies
points = st.lists(st.tuples(coords, coords), min_size=4, max_size=40)


@SETTINGS
@given(pts=points, k=st.integers(min_value=1, max_value=3))
def test_knn_matches_brute_force(spark, pts, k):
    k = min(k, len(pts) - 1)
    rows = [(i, a, b) for i, (a, b) in enumerate(pts)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    got = {}
    for r in knn(df, "row_id", ["a", "b"], k).collect():
        got.setdefault(r["q_id"], {})[r["nn_rank"]] = r["nn_id"]
    for i, a, b in rows:
        exp = sorted(((a - x) ** 2 + (b - y) ** 2, j) for j, x, y in rows if j != i)[:k]
        assert [got[i][r] for r in range(k)] == [j for _, j in exp]


@SETTINGS
@given(ts=st.lists(st.floats(min_value=0, max_value=8), min_size=2, max_size=6),
       df_=st.floats(min_value=1.5, max_value=500))
def test_t_pvalue_bounded_and_monotone(spark, ts, df_):
    ts = sorted(set(round(t, 3) for t in ts))
    rows = spark.createDataFrame([(t,) for t in ts], "t double").select(
        "t", t_sf2(F.col("t"), F.lit(df_)).alias("p")).orderBy("t").collect()
    ps = [r["p"] for r in rows]
    assert all(0.0 <= p <= 1.0 for p in ps)
    assert all(a >= b - 1e-12 for a, b in zip(ps, ps[1:]))


@SETTINGS
@given(n=st.integers(min_value=10, max_value=300), share=st.floats(min_value=0.05, max_value=0.5),
       seed=st.integers(min_value=0, max_value=99))
def test_split_and_folds_partition_each_class(spark, n, share, seed):
    rows = [(i, int(i < n * share)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    s = split_stratified(df, "label", 0.2, seed).collect()
    assert sorted(r["row_id"] for r in s) == list(range(n))
    f = kfold_stratified(df, "label", 5, seed).groupBy("label", "fold").count().collect()
    for lab in (0, 1):
        sizes = [r["count"] for r in f if r["label"] == lab]
        assert max(sizes) - min(sizes) <= 1
