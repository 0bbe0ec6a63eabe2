import itertools
import math
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratum.operators import features as E
from stratum.operators import form as FX
from stratum.operators import scoring as K
from stratum.streaming.score_stream import ANSWER_SCHEMA, flatten_reply, start_score_stream


def test_minmax_constant_zero_and_standard(spark):
    df = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0)], "row_id long, a double, c double")
    r = E.scale_minmax(df, ["a", "c"]).orderBy("row_id").collect()
    assert [x["c"] for x in r] == [0.0, 0.0] and [x["a"] for x in r] == [0.0, 1.0]
    s = E.scale_standard(df, ["a"]).orderBy("row_id").collect()
    assert [x["a"] for x in s] == [-1.0, 1.0]


def test_interactions_skip_ratio_with_zero(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (2.0, 1.0, 3.0)], "a double, b double, c double")
    cols = E.interactions(df, ["a", "b", "c"]).columns
    assert "a_div_b" not in cols and "a_div_c" in cols and "a_x_b" in cols


def test_pca_ratios_and_centering(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5)) + 10
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(X)], "row_id long, a double, b double, "
                                                                               "c double, d double, e double")
    proj, ev = E.pca_project(df, list("abcde"), k=3)
    ratios = [r["ratio"] for r in ev.collect()]
    assert sum(ratios) == pytest.approx(1.0)
    means = proj.agg(*[F.avg(f"PC{i}") for i in (1, 2, 3)]).first()
    assert all(abs(m) < 1e-8 for m in means)


def test_ica_unit_variance_uncorrelated(spark):
    rng = np.random.default_rng(1)
    S = np.c_[rng.laplace(size=400), rng.uniform(-1, 1, 400)]
    X = S @ np.array([[1.0, 0.5], [0.3, 1.0]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "row_id long, a double, b double")
    out, info = E.ica_components(df, ["a", "b"], max_iter=300)
    Y = np.array([[r["IC1"], r["IC2"]] for r in out.collect()])
    c = np.cov(Y.T)
    assert info["converged"]
    assert abs(c[0, 1]) < 0.05 and abs(c[0, 0] - 1) < 0.05 and abs(c[1, 1] - 1) < 0.05


def _brute_viterbi(obs):
    S = FX.STATES
    E_ = K.EVENT_EMISSIONS
    best = None
    for path in itertools.product(S, repeat=len(obs)):
        lp = math.log(FX.TRANSITIONS["Low"][path[0]]) + math.log(E_[path[0]].get(obs[0], FX.UNKNOWN_EMISSION))
        for t in range(1, len(obs)):
            lp += math.log(FX.TRANSITIONS[path[t - 1]][path[t]]) + math.log(E_[path[t]].get(obs[t], FX.UNKNOWN_EMISSION))
        if best is None or lp > best[0] + 1e-12:
            best = (lp, path)
    return best


@pytest.mark.parametrize("obs", [["view"], ["error", "error", "click", "view", "purchase"],
                                 ["unseen", "error", "signup", "view"]])
def test_viterbi_brute_force(spark, obs):
    rows = [(1, i, i, o) for i, o in enumerate(obs)]
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, event_type string")
    r = K.viterbi_decode(df, "user_id", ["ts", "event_id"], "event_type").first()
    lp, path = _brute_viterbi(obs)
    assert r["log_prob"] == pytest.approx(lp) and r["path"] == ",".join(path)


def _answers(spark):
    base = {f["id"]: (f["options"][0] if f["type"] == "select" else str(f["min"])) for f in FX.FORM}
    a = dict(base, Depression_Score="3 (Moderate)", Sleep_Quality="Poor")
    b = dict(base, CGPA="abc")
    c = dict(base, Anxiety_Score="2 (Mild)", Physical_Activity="Low", Financial_Stress="4 (Severe)")
    d = dict(base)
    del d["Depression_Score"]
    rows = [(i + 1, *[r.get(f) for f in FX.FORM_IDS]) for i, r in enumerate([a, b, c, d])]
    return spark.createDataFrame(rows, ANSWER_SCHEMA)


def test_scorer_levels_fallback_and_recommendations(spark):
    out = {r["row_id"]: r for r in K.score_answers(_answers(spark)).collect()}
    assert out[1]["stress_level"] == "High" and out[1]["stress_probability"] == 0.75
    assert FX.REC_POOR_SLEEP in out[1]["recommendations"] and len(out[1]["recommendations"]) == 7
    assert out[2]["is_fallback"] and out[2]["recommendations"] == FX.FALLBACK_RECS
    assert out[3]["stress_level"] == "Moderate" and len(out[3]["recommendations"]) == 8
    assert out[4]["stress_level"] == "Low" and not out[4]["is_fallback"]
    assert out[1]["message"].split("\n")[0] in FX.OPENINGS["High"]


def test_validation_messages(spark):
    v = {r["row_id"]: r["violations"] for r in K.validate_answers(_answers(spark)).collect()}
    assert v[2] == ["CGPA: not a number"] and v[4] == ["Depression_Score: required"] and v[1] == []


def test_stream_equals_batch(spark):
    a = _answers(spark)
    d = tempfile.mkdtemp(prefix="stratum-stream-")
    src, sink, ck = (os.path.join(d, x) for x in ("in", "out", "ck"))
    a.repartition(2).write.parquet(src)
    start_score_stream(spark, src, sink, ck).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    exp = sorted(tuple(r) for r in flatten_reply(K.score_answers(a)).collect())
    assert got == exp


@pytest.mark.parametrize("batch,segment", [(7, 4096), (10000, 4096), (7, 16), (50, 5), (10000, 1)])
def test_viterbi_hot_key_spans_partitions_and_batches(spark, batch, segment):
    """Segments that cross partitions and Arrow batches: one state per event, the sequential recursion's path."""
    from stratum.operators.sequence import viterbi_states

    rng = np.random.default_rng(5)
    kinds = ["view", "click", "purchase", "signup", "error", "odd"]
    rows, t = [], 0
    for u, size in ((1, 1500), (2, 1), (3, 40), (None, 25), *((10 + i, 6) for i in range(30))):
        for _ in range(size):
            t += 1
            rows.append((u, t, int(rng.integers(0, 3)), kinds[rng.integers(0, 6)]))
    df = spark.createDataFrame(rows, "user_id long, ts long, event_id long, event_type string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        states, scores = viterbi_states(df, "user_id", ["ts", "event_id"], "event_type", n_partitions=6, segment=segment)
        got = {(r["user_id"], r["ts"]): r["state"] for r in states.collect()}
        assert states.count() == len(rows) == len(got)
        assert scores.count() == 34
        score = {r["user_id"]: (r["n_obs"], r["log_prob"]) for r in scores.collect()}
        none, of_none = viterbi_states(df.limit(0), "user_id", ["ts", "event_id"], "event_type", n_partitions=6, segment=segment)
        assert none.count() == of_none.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = {}
    for u, ts, _, e in sorted(rows, key=lambda r: r[1]):
        by.setdefault(u, []).append((ts, e))
    for u, seq in by.items():
        lp, path = _recursion([e for _, e in seq])
        assert score[u][0] == len(seq) and score[u][1] == pytest.approx(lp, rel=1e-9)
        mine = [got[(u, ts)] for ts, _ in seq]
        assert _worth(mine, [e for _, e in seq]) == pytest.approx(lp, rel=1e-12)
        if segment > 1000:  # scores that enter a segment are rounded in another order, which may turn a tie
            assert mine == path


def _worth(path, obs):
    """Log-probability of one path."""
    steps = zip(["Low", *path], path, obs)
    return sum(math.log(FX.TRANSITIONS[a][b]) + math.log(K.EVENT_EMISSIONS[b].get(o, FX.UNKNOWN_EMISSION)) for a, b, o in steps)


def _recursion(obs):
    """The recursion, event by event; ties to the largest state name."""
    le = lambda s, o: math.log(K.EVENT_EMISSIONS[s].get(o, FX.UNKNOWN_EMISSION))
    lt = lambda a, b: math.log(FX.TRANSITIONS[a][b])
    v, back = {s: lt("Low", s) + le(s, obs[0]) for s in FX.STATES}, []
    for o in obs[1:]:
        best = {s: max(FX.STATES, key=lambda r: (v[r] + lt(r, s), r)) for s in FX.STATES}
        v, back = {s: v[best[s]] + lt(best[s], s) + le(s, o) for s in FX.STATES}, back + [best]
    at = max(FX.STATES, key=lambda s: (v[s], s))
    path, lp = [at], v[at]
    for b in reversed(back):
        path.append(b[path[-1]])
    return lp, path[::-1]
