"""Queries for learners, voting, tuning and contests (H), at the reference's sizes.

Fitted values cannot be written in SQL: those queries are held against
properties in ``tests/test_models.py``.  What is arithmetic on scores (soft
vote, fold summary, ranking, paired t) has its oracle on fixed score tables.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratum.functions.exprs import merge_one_row
from stratum.functions.hashing import hash_uniform, hash_uniform_sql
from stratum.functions.pvalue import t_sf2_sql
from stratum.operators import metrics as I
from stratum.operators import models as H
from stratum.operators import sampling as G
from stratum.operators import stats as S
from stratum.operators.features import fit_scale
from stratum.operators.kernel import apply_kernel_map, fit_kernel_map
from stratum.plans.catalog import register
from stratum.session import cut_lineage, scratch_path
from stratum.sources import bindings as bd
from stratum.sources.io import model_load, model_store

DOC_NUM = ["n_chars", "n_words", "digit_share", "upper_share"]


def _docs(spark, sf):
    return bd.docs(spark, sf).select("row_id", *DOC_NUM, "label")


@register("clf_logistic")
def q_clf_logistic(spark, sf):
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_logistic(C=1.0))


@register("clf_tree")
def q_clf_tree(spark, sf):
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_tree(max_depth=4))


@register("clf_forest")
def q_clf_forest(spark, sf):
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_forest())


@register("clf_gbt")
def q_clf_gbt(spark, sf):
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_gbt())


@register("clf_boosted_deep")
def q_clf_boosted_deep(spark, sf):
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_boosted_deep())


@register("clf_mlp")
def q_clf_mlp(spark, sf):
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_mlp(len(DOC_NUM)))


@register("clf_svm")
def q_clf_svm(spark, sf):
    """Degree-2 polynomial map + linear SVM + Platt probabilities."""
    return H.train_eval(_docs(spark, sf), DOC_NUM, H.clf_svm("poly", C=1.2))


@register("clf_svm_rbf")
def q_clf_svm_rbf(spark, sf):
    """Random Fourier features (RBF kernel map, scaled on training rows) + linear SVM + Platt."""
    train, test = H.holdout(_docs(spark, sf))
    scale = fit_scale(train, DOC_NUM, "standard")
    train, test = (H.rff_features(d, DOC_NUM, 50, scale=scale) for d in (train, test))
    m = H.fit_pipeline(train, [f"rff{i}" for i in range(50)], H.clf_svm("rbf", C=1.2), scaler=None)
    return H.predict(m, test)


@register("clf_svm_landmarks")
def q_clf_svm_landmarks(spark, sf):
    """RBF kernel by 64 landmarks (Nystrom map, scaled and drawn on training rows) + linear SVM + Platt."""
    train, test = H.holdout(_docs(spark, sf))
    kmap = fit_kernel_map(train, DOC_NUM, scale=fit_scale(train, DOC_NUM, "standard"))
    train, test = (apply_kernel_map(d, kmap) for d in (train, test))
    return H.predict(H.fit_pipeline(train, ["kernel_map"], H.clf_svm("rbf", C=1.2), scaler=None), test)


_TEST_ROWS = f"""
    r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY u, row_id) - 1 AS rk, count(*) OVER (PARTITION BY label) AS nc
          FROM (SELECT *, {hash_uniform_sql('row_id', 42, "'order'")} AS u FROM docs)),
    held AS (SELECT row_id, label AS y FROM r WHERE rk < floor(nc * 0.2 + 0.5))"""
_LEARNERS = ["logistic", "tree", *H.VOTERS, "vote"]


@register("learner_properties", uses=("docs",), ctes=_TEST_ROWS, sql=f"""
    SELECT learner, row_id, y, true AS p1_in_range, true AS yhat_follows_p1
    FROM held, (SELECT unnest([{', '.join(f"'{n}'" for n in _LEARNERS)}]) AS learner)""")
def q_learner_properties(spark, sf):
    """Per learner and test row: is p1 a probability, and does yhat follow it?  The threshold is 0.5; for the
    SVM, which decides by its margin, it is the probability that its curve gives to margin 0."""
    train, test = H.holdout(_docs(spark, sf))
    members, scored = H.fit_members(train, test, DOC_NUM)
    more = {"logistic": H.clf_logistic(C=1.0), "tree": H.clf_tree(max_depth=4)}
    more = dict(zip(more, H.side_by_side([lambda e=e: H.fit_pipeline(train, DOC_NUM, e) for e in more.values()])))
    svm = members["svm"].stages[-1]
    cuts = dict.fromkeys(_LEARNERS, 0.5) | {"svm": 1 / (1 + math.exp(-svm.intercept))}
    vote = H.vote_columns(scored, H.VOTERS).select("row_id", "y", F.col("p1").alias("p_vote"), F.col("yhat").alias("y_vote"))

    def melted(t, names):
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("learner"), F.col(f"p_{n}").alias("p"), F.col(f"y_{n}").alias("yhat"),
                                            F.lit(cuts[n]).alias("cut")) for n in names]))
        return t.select("row_id", "y", each.alias("e")).select(
            "e.learner", "row_id", "y", F.coalesce(F.col("e.p").between(0, 1), F.lit(False)).alias("p1_in_range"),
            F.coalesce((F.col("e.yhat") == 1) == (F.col("e.p") > F.col("e.cut")), F.lit(False)).alias("yhat_follows_p1"))

    return (melted(scored, H.VOTERS).unionByName(melted(H.predict_all(more, test), list(more))).unionByName(melted(vote, ["vote"])))


@register("vote_soft")
def q_vote_soft(spark, sf):
    """Five voters on one split, applied in one projection."""
    train, test = H.holdout(_docs(spark, sf))
    _, scored = H.fit_members(train, test, DOC_NUM)
    return H.vote_columns(scored, H.VOTERS)


@register("grid_search")
def q_grid_search(spark, sf):
    """The forest's grid, 3 folds."""
    est, grid = H.reference_grids(len(DOC_NUM), 0)["forest"]
    _, tab = H.grid_search(_docs(spark, sf), DOC_NUM, est, grid, folds=3)
    return tab


@register("tune_families")
def q_tune_families(spark, sf):
    """Grid search per family on shared folds: the tree that explains, the forest, both boosted learners, the SVM in
    both kernels and the network."""
    d = cut_lineage(_docs(spark, sf))
    grids = H.reference_grids(len(DOC_NUM), d.count() * 2 // 3)
    rff = H.rff_features(d, DOC_NUM, 50, scale=fit_scale(d, DOC_NUM, "standard"))
    svms = [(d, DOC_NUM, {"svm_linear": grids["svm"]}), (rff, [f"rff{i}" for i in range(50)], {"svm_rbf": grids["svm"]})]
    others = {"tree": (H.clf_tree(), {"maxDepth": [4]}), "forest": grids["forest"], "gbt": grids["gbt"],
              "boosted_deep": grids["boosted_deep"], "mlp": (None, H.network_grid(len(DOC_NUM)))}
    # one search of each kind at a time: the SVM's many short jobs beside the long tasks of the others
    found = H.side_by_side([lambda: [H.tune_families(t, f, g, folds=3)[1] for t, f, g in svms], lambda: [H.tune_families(d, DOC_NUM, others, folds=3)[1]]])
    linear, rbf, rest = [t for part in found for t in part]
    return rest.unionByName(linear).unionByName(rbf)


@register("grid_search_mlp")
def q_grid_search_mlp(spark, sf):
    """The network's grid (sizes and depths of the hidden layers, L2), 3 folds."""
    return H.score_candidates(_docs(spark, sf), DOC_NUM, H.network_grid(len(DOC_NUM)), folds=3)


@register("cross_validate")
def q_cross_validate(spark, sf):
    return H.cross_validate(_docs(spark, sf), DOC_NUM, H.clf_forest(), k=5)


_PAIR_FOLDS = f"""
    s AS (SELECT row_id, label AS y,
                 CAST(1.0 / (1.0 + exp(-(2.0 - 25.0 * upper_share + 0.3 * (ln(n_chars) - 7.3)))) > 0.5 AS INTEGER) AS a,
                 CAST(1.0 / (1.0 + exp(-(0.5 * (ln(n_chars) - 7.0)))) > 0.5 AS INTEGER) AS b FROM docs),
    k AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {hash_uniform_sql('row_id', 0, "'fold'")}, row_id) - 1) % 5 AS fold FROM s),
    f AS (SELECT fold, avg(CASE WHEN a = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS first,
                 avg(CASE WHEN b = y THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS second FROM k GROUP BY fold)"""


def _fold_scores(spark, sf):
    """Fold accuracies of two fixed scorers on the same hash folds."""
    d = bd.docs(spark, sf)
    logit = lambda z: (F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) > 0.5).cast("int")
    s = d.select("row_id", "label", logit(F.lit(2.0) - F.lit(25.0) * F.col("upper_share") + F.lit(0.3) * (F.log("n_chars") - F.lit(7.3))).alias("a"),
                 logit(F.lit(0.5) * (F.log("n_chars") - F.lit(7.0))).alias("b"))
    k = G.kfold_stratified(s, "label", 5, 0)
    hit = lambda c: F.avg((F.col(c) == F.col("label")).cast("double"))
    return k.groupBy("fold").agg(hit("a").alias("first"), hit("b").alias("second"))


@register("cv_summary", uses=("docs",), dbl=("mean_accuracy", "two_std"), ctes=_PAIR_FOLDS,
          sql="SELECT avg(first) AS mean_accuracy, 2 * stddev_pop(first) AS two_std FROM f")
def q_cv_summary(spark, sf):
    """Mean and two standard deviations of fold accuracies."""
    return H.cv_summary(_fold_scores(spark, sf).select("fold", F.col("first").alias("accuracy")))


_T = "(md / nullif(sd / sqrt(n), 0))"


@register("model_compare_ttest", uses=("docs",), dbl=("original_mean", "method_mean", "mean_diff", "t_statistic", "p_value"),
          ctes=_PAIR_FOLDS, sql=f"""
    SELECT 'first_vs_second' AS comparison, m1 AS original_mean, m2 AS method_mean, m2 - m1 AS mean_diff, {_T} AS t_statistic,
           {t_sf2_sql(_T, '(n - 1)')} AS p_value, coalesce({t_sf2_sql(_T, '(n - 1)')} < 0.05, false) AS significant,
           CASE WHEN {t_sf2_sql(_T, '(n - 1)')} < 0.05 AND m2 > m1 THEN 'second'
                WHEN {t_sf2_sql(_T, '(n - 1)')} < 0.05 AND m1 > m2 THEN 'first' ELSE 'no significant difference' END AS better_method
    FROM (SELECT count(*) AS n, avg(first) AS m1, avg(second) AS m2, avg(first - second) AS md,
                 stddev_samp(first - second) AS sd FROM f)""")
def q_model_compare_ttest(spark, sf):
    """Fold accuracies of two models on the same folds → paired t."""
    return S.ttest_paired(_fold_scores(spark, sf), "first", "second", comparison="first_vs_second")


@register("rank_approaches", uses=("docs",), dbl=("accuracy",), sql="""
    SELECT approach, declared, accuracy FROM (
      SELECT lang AS approach, CAST(row_number() OVER (ORDER BY lang) - 1 AS INTEGER) AS declared,
             avg(CAST(label AS DOUBLE)) AS accuracy FROM docs GROUP BY lang)
    ORDER BY accuracy DESC, declared LIMIT 2""")
def q_rank_approaches(spark, sf):
    """Best and runner-up of a table of scored approaches, declaration order breaking ties."""
    from stratum.operators.windows import distinct_rank

    d = bd.docs(spark, sf)
    t = d.groupBy(F.col("lang").alias("approach")).agg(F.avg(F.col("label").cast("double")).alias("accuracy"))
    order = distinct_rank(d, "lang").withColumnsRenamed({"level": "approach", "rank": "declared"})
    return H.rank_approaches(t.join(order, "approach").select("approach", "declared", "accuracy"))


_SETS = ["original", "undersampled", "smote", "combined"]


def _balanced(train):
    """The balanced versions of training rows; test rows are never resampled."""
    near = G.minority_neighbours(train, DOC_NUM, "label")
    return {"original": train, "undersampled": G.undersample_random(train, "label", 1.0),
            "smote": G.smote(train, DOC_NUM, "label", 1.0, near=near).drop("synthetic"),
            "combined": G.smote_undersample(train, DOC_NUM, "label", near=near).drop("synthetic", "undersample_applied")}


@register("train_eval_resampled")
def q_train_eval_resampled(spark, sf):
    """min-max → forest → accuracy / ROC-AUC / PR-AUC / confusion matrix of each resampled training set on the
    same test rows.  Every set and its predictions are cut from what made them: a plan that holds the searches of
    all sets, sent out with each of a fit's jobs, filled the driver."""
    train, test = (cut_lineage(t) for t in H.holdout(_docs(spark, sf)))
    preds = None
    for name, balanced in _balanced(train).items():
        p = cut_lineage(H.predict(H.fit_pipeline(cut_lineage(balanced), DOC_NUM, H.clf_forest()), test).withColumn("dataset", F.lit(name)))
        preds = p if preds is None else preds.unionByName(p)
    cells = preds.groupBy("dataset").agg(*[F.count_if((F.col("y") == y) & (F.col("yhat") == yhat)).alias(c)
                                           for c, y, yhat in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))])
    found = [{r["dataset"]: r for r in t.collect()} for t in (I.accuracy(preds, by=["dataset"]), I.curve_areas(preds, "y", "p1", by=["dataset"]), cells)]
    rows = [(n, *[found[i][n][c] if n in found[i] else None for i, cs in enumerate((["accuracy"], ["roc_auc", "pr_auc"], ["tn", "fp", "fn", "tp"])) for c in cs])
            for n in found[0]]
    return spark.createDataFrame(sorted(rows, key=lambda r: _SETS.index(r[0])),
                                 "dataset string, accuracy double, roc_auc double, pr_auc double, tn long, fp long, fn long, tp long")


@register("compare_balancers_ttest")
def q_compare_balancers_ttest(spark, sf):
    """{original, undersampled, smote, combined} training rows × folds: forest accuracy, paired t against
    the original (ten repeats of five folds, 200 trees: 200 forests grown together)."""
    train = cut_lineage(H.holdout(_docs(spark, sf))[0])
    scores = H.balancing_fold_scores(_balanced(train), DOC_NUM, repeats=10, k=5, trees=200)
    orig = scores.where("method = 'original'").select("repeat", "fold", F.col("accuracy").alias("original"))
    out = None
    for m in ("undersampled", "smote", "combined"):
        j = orig.join(scores.where(F.col("method") == m).select("repeat", "fold", F.col("accuracy").alias(m)), ["repeat", "fold"])
        t = S.ttest_paired(j, "original", m, comparison=f"original_vs_{m}")
        out = t if out is None else out.unionByName(t)
    return out


@register("compare_reduction")
def q_compare_reduction(spark, sf):
    """Baseline, PCA (95 % of the variance), ICA and feature selection: min-max scaled, fitted on training
    rows, forest accuracy on the same test rows."""
    return H.compare_reduction(_docs(spark, sf), DOC_NUM)


@register("train_select")
def q_train_select(spark, sf):
    return H.train_select(_docs(spark, sf), DOC_NUM)


# Fixed scores for every branch of the selection rule: a row is right where its draw is below q, and a voter's p1
# stands its margin from 0.5.  {scenario: ({approach: (q, draw)}, {stage: {voter: (q, draw, margin)}})}
_WEAK = {n: (0.62, i, 0.25) for i, n in enumerate(H.VOTERS)}
_STRONG = {n: (0.8, i, 0.25) for i, n in enumerate(H.VOTERS)}
_SAME = {n: (0.7, 0, 0.125) for n in H.VOTERS}
_LEADER = {n: (0.55, i, 0.375) for i, n in enumerate(H.VOTERS)}
_SCENARIOS = {
    "minmax_vote": ({"baseline": (0.9, 0), "pca": (0.7, 1), "ica": (0.6, 2)}, {"standard": _WEAK, "minmax": _STRONG}),
    "standard_vote": ({"baseline": (0.9, 0), "pca": (0.7, 1), "ica": (0.6, 2)}, {"standard": _STRONG, "minmax": _WEAK}),
    "ties_single": ({"baseline": (0.8, 0), "pca": (0.8, 0), "ica": (0.8, 0)},
                    {s: _LEADER | {"svm": (0.97, 7, 0.0625)} for s in ("standard", "minmax")}),
    "pca_same_voters": ({"baseline": (0.6, 0), "pca": (0.9, 1), "ica": (0.9, 1)}, {"pca": _SAME}),
    "ica_two_leaders": ({"baseline": (0.6, 0), "pca": (0.7, 1), "ica": (0.95, 2)},
                        {"ica": _LEADER | {"gbt": (0.95, 8, 0.0625), "mlp": (0.95, 8, 0.0625)}}),
}
_RULE = f"""
    par(scenario, approach, declared, q, draw) AS (VALUES {', '.join(
        f"('{s}', '{a}', {i}, {q}, {d})" for s, (ap, _) in _SCENARIOS.items() for i, (a, (q, d)) in enumerate(ap.items()))}),
    mem(scenario, stage, member, ord, q, draw, margin) AS (VALUES {', '.join(
        f"('{s}', '{st}', '{n}', {H.VOTERS.index(n)}, {q}, {d}, {m})" for s, (_, st_) in _SCENARIOS.items()
        for st, mem in st_.items() for n, (q, d, m) in mem.items())}),
    ap AS (SELECT scenario, approach, declared, avg(CASE WHEN {hash_uniform_sql('row_id', 'approach', 'draw')} < q THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
           FROM docs, par GROUP BY ALL),
    win AS (SELECT scenario, approach AS method FROM ap QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY accuracy DESC, declared) = 1),
    hits AS (SELECT scenario, stage, member, ord, row_id, label AS y, margin, {hash_uniform_sql('row_id', 'voter', 'draw')} < q AS ok FROM docs, mem),
    single AS (SELECT scenario, stage, member, ord, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM hits GROUP BY ALL),
    v AS (SELECT scenario, stage, row_id, y, sum(CASE WHEN ok = (y = 1) THEN 0.5 + margin ELSE 0.5 - margin END) / 5.0 AS p FROM hits GROUP BY ALL),
    vote AS (SELECT scenario, stage, avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM v GROUP BY ALL),
    scaler AS (SELECT a.scenario, CASE WHEN b.accuracy > a.accuracy THEN 'minmax' ELSE 'standard' END AS stage
               FROM vote a JOIN vote b ON a.scenario = b.scenario AND a.stage = 'standard' AND b.stage = 'minmax'),
    used AS (SELECT win.scenario, method, CASE WHEN method = 'baseline' THEN scaler.stage ELSE method END AS stage FROM win LEFT JOIN scaler USING (scenario)),
    top AS (SELECT * FROM (SELECT 'n_chars' AS f, corr(n_chars, label) AS c FROM docs UNION ALL SELECT 'n_words', corr(n_words, label) FROM docs
            UNION ALL SELECT 'digit_share', corr(digit_share, label) FROM docs UNION ALL SELECT 'upper_share', corr(upper_share, label) FROM docs)
            WHERE c IS NOT NULL ORDER BY abs(c) DESC, f LIMIT 1),
    lead AS (SELECT s.scenario, member, s.accuracy FROM single s JOIN used USING (scenario, stage)
             QUALIFY row_number() OVER (PARTITION BY s.scenario ORDER BY s.accuracy DESC, ord) = 1),
    ens AS (SELECT scenario, accuracy FROM vote JOIN used USING (scenario, stage))"""


class _FixedScores:
    def __init__(self, docs, scenario):
        self.docs, (self.approaches, self.stages) = docs, _SCENARIOS[scenario]

    def correlations(self):
        return S.corr_matrix(self.docs.select(*DOC_NUM, F.col("label").cast("double").alias("label")), [*DOC_NUM, "label"])

    def reductions(self):
        hit = [F.avg((hash_uniform("row_id", "approach", d) < q).cast("double")).alias(a) for a, (q, d) in self.approaches.items()]
        rows = F.array(*[F.struct(F.lit(a).alias("approach"), F.lit(i).alias("declared"), F.col(a).alias("accuracy"))
                         for i, a in enumerate(self.approaches)])
        return self.docs.agg(*hit).select(F.inline(rows))

    def voters(self, method, scaler):
        cols = []
        for n, (q, d, m) in self.stages[scaler or method].items():
            ok = hash_uniform("row_id", "voter", d) < q
            cols += [F.when(ok == (F.col("label") == 1), 0.5 + m).otherwise(0.5 - m).alias(f"p_{n}"),
                     F.when(ok, F.col("label")).otherwise(1 - F.col("label")).alias(f"y_{n}")]
        return self.docs.select("row_id", F.col("label").alias("y"), *cols)


@register("train_select_rule", uses=("docs",), dbl=("accuracy",), ctes=_RULE, sql="""
    SELECT scenario, 'correlation' AS step, f AS choice, c AS accuracy FROM win, top
    UNION ALL SELECT scenario, 'reduction:' || approach, approach, accuracy FROM ap
    UNION ALL SELECT scenario, 'scaler:' || stage, stage, accuracy FROM vote JOIN win USING (scenario) WHERE method = 'baseline'
    UNION ALL SELECT scenario, 'member:' || member, member, accuracy FROM single JOIN used USING (scenario, stage)
    UNION ALL SELECT scenario, 'ensemble', 'vote_soft', accuracy FROM ens
    UNION ALL SELECT scenario, 'chosen', CASE WHEN lead.accuracy > ens.accuracy THEN member ELSE 'ensemble' END,
                     greatest(lead.accuracy, ens.accuracy) FROM lead JOIN ens USING (scenario)""")
def q_train_select_rule(spark, sf):
    """The decisions of ``train_select`` on fixed scores of all labelled documents, one scenario for each branch."""
    d = _docs(spark, sf).persist()
    rows = [(s, *r) for s in _SCENARIOS for r in H.select_flow(_FixedScores(d, s))]
    d.unpersist()
    return spark.createDataFrame(rows, "scenario string, step string, choice string, accuracy double")


@register("model_store_roundtrip", uses=("docs",), sql="SELECT row_id, label AS y, true AS same FROM docs")
def q_model_store_roundtrip(spark, sf):
    """Does the reloaded model give every row the class and probability of the one that was stored?"""
    d = H.sized(_docs(spark, sf))
    m = H.fit_pipeline(d, DOC_NUM, H.clf_tree(max_depth=4))
    t = H.predict_all({"kept": m, "read": model_load(model_store(m, scratch_path(spark, "model")))}, d)
    return t.select("row_id", "y", (F.col("p_kept").eqNullSafe(F.col("p_read")) & (F.col("y_kept") == F.col("y_read"))).alias("same"))


@register("model_store")
def q_model_store(spark, sf):
    """Fit → persist to the shared scratch folder → reload → predict."""
    d = _docs(spark, sf)
    m = H.fit_pipeline(d, DOC_NUM, H.clf_forest())
    path = model_store(m, scratch_path(spark, "model"))
    return H.predict(model_load(path), d)


@register("workflow_balancing_contest")
def q_workflow_balancing_contest(spark, sf):
    """Pipeline 1: split → three balancers on training rows → forest each → comparison (long)."""
    from stratum.plans.workflows import balancing_contest

    _, long, _ = balancing_contest(_docs(spark, sf), DOC_NUM)
    return long


@register("workflow_choice")
def q_workflow_choice(spark, sf):
    from stratum.plans.workflows import balancing_contest

    _, _, choice = balancing_contest(_docs(spark, sf), DOC_NUM)
    return choice
