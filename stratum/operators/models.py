"""H. Classifiers, soft voting, tuning and contests on Spark ML.

Learners are Spark ML estimators (distributed training).  Deviations from
the single-machine originals are deliberate and listed per factory:
kernel SVM → linear SVM on an explicit feature map (degree-2 polynomial or
random Fourier features for RBF) with probabilities from out-of-fold margins; the second boosted-tree member → ``GBTClassifier`` with deeper
trees.  Folds are the hash-based ``fold`` column, so every repeat is reproducible and never depends on row order.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)  # noqa: F401
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.boosted import CellGBTClassifier, fit_in_task, fold_accuracies
from stratum.operators.calibration import OutOfFoldPlatt
from stratum.operators.forest import ForestClassifier
from stratum.operators.network import NetworkClassifier
from stratum.operators.sampling import kfold_repeated, kfold_stratified, split_stratified
from stratum.session import cut_lineage

FEAT = "features"


# ---------------------------------------------------------------- estimators

def _penalised(est, C: float):
    """Mark an estimator whose regParam is 1/(C·n) with n the rows it is fitted on
    (the objective C·Σ loss + ½‖w‖²); ``fit_pipeline`` fills n in."""
    est.inverse_penalty = C
    return est


def with_rows(est, n: int):
    c = getattr(est, "inverse_penalty", None)
    if c is None:
        return est
    owner = getattr(est, "estimator", est)
    return est.copy({owner.regParam: 1.0 / (c * max(n, 1))})


def clf_logistic(C: float = 1.0, max_iter: int = 100):
    """L2 logistic regression."""
    return _penalised(LogisticRegression(featuresCol=FEAT, labelCol="label", elasticNetParam=0.0, standardization=False,
                                         maxIter=max_iter), C)


def clf_tree(max_depth: int = 4, seed: int = 123):
    return DecisionTreeClassifier(featuresCol=FEAT, labelCol="label", impurity="entropy", maxDepth=max_depth,
                                  seed=seed)


def clf_forest(num_trees: int = 200, max_depth: int = 30, seed: int = 42, min_leaf: int = 1):
    """Random forest on binned features, whose trees grow side by side (``operators.forest``)."""
    return ForestClassifier(featuresCol=FEAT, labelCol="label", numTrees=num_trees, maxDepth=min(max_depth, 30),
                            minInstancesPerNode=min_leaf, seed=seed)


def clf_gbt(max_iter: int = 100, max_depth: int = 3, step: float = 0.1, seed: int = 42):
    """Spark ML's boosted trees on cells of equal bins (``operators.boosted``)."""
    return CellGBTClassifier(featuresCol=FEAT, labelCol="label", maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                             seed=seed)


def clf_boosted_deep(max_iter: int = 100, seed: int = 42):
    """Second boosted member: deeper, faster-learning GBT (no leaf L2 in Spark)."""
    return clf_gbt(max_iter=max_iter, max_depth=6, step=0.3, seed=seed)


def clf_mlp(n_features: int, hidden: int | tuple[int, ...] = 100, max_iter: int = 1000, seed: int = 42, alpha: float = 1e-4):
    """Network with hidden ReLU layers, mini-batch Adam and L2 (``operators.network``)."""
    return NetworkClassifier(featuresCol=FEAT, labelCol="label", hidden=hidden, max_iter=max_iter, seed=seed, alpha=alpha)


def clf_svm(kind: str = "linear", C: float = 1.0, max_iter: int = 100) -> list:
    """Stages of a linear SVM on the assembled features, on their degree-2 expansion
    (``kind`` 'poly'), or on random Fourier features assembled by the caller ('rbf');
    a logistic curve fitted to out-of-fold margins gives the probability."""
    col = "_poly" if kind == "poly" else FEAT
    svm = LinearSVC(featuresCol=col, labelCol="label", maxIter=max_iter, standardization=True)
    expand = [PolynomialExpansion(inputCol=FEAT, outputCol=col, degree=2)] if kind == "poly" else []
    return [*expand, _penalised(OutOfFoldPlatt(svm, col), C)]


def rff_features(df: DataFrame, cols: list[str], n_components: int = 50, gamma: float | None = None,
                 seed: int = 42, prefix: str = "rff", scale: dict | None = None) -> DataFrame:
    """Random Fourier features sqrt(2/D)·cos(w·x + b), w ~ N(0, 2γ) (Rahimi & Recht
    2007) as native expressions: an RBF kernel map without a Python UDF.  ``scale``
    {column: (shift, divisor)}, fitted on training rows, is applied inside."""
    d = len(cols)
    gamma = gamma or 1.0 / d
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, math.sqrt(2 * gamma), size=(n_components, d))
    b = rng.uniform(0, 2 * math.pi, size=n_components)
    s = math.sqrt(2.0 / n_components)
    outs = []
    for i in range(n_components):
        e = F.lit(float(b[i]))
        for j, c in enumerate(cols):
            shift, div = (scale or {}).get(c, (0.0, 1.0))
            e = e + (F.col(c).cast("double") - F.lit(float(shift))) / F.lit(float(div)) * F.lit(float(W[i, j]))
        outs.append((F.lit(s) * F.cos(e)).alias(f"{prefix}{i}"))
    return df.select("*", *outs)


# ------------------------------------------------------------------ plumbing

def assemble(df: DataFrame, feats: list[str], label: str = "label", scaler: str | None = "minmax") -> Pipeline:
    """Pipeline stages: assemble → (scale).  Scalers are fit inside the pipeline,
    i.e. on training rows only."""
    stages = [VectorAssembler(inputCols=feats, outputCol="_raw" if scaler else FEAT, handleInvalid="keep")]
    if scaler == "minmax":
        stages.append(MinMaxScaler(inputCol="_raw", outputCol=FEAT))
    elif scaler == "standard":
        stages.append(StandardScaler(inputCol="_raw", outputCol=FEAT, withMean=True, withStd=True))
    return stages


def sized(df: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """Persisted rows in as many partitions as they fill: learners make hundreds of
    passes, and a pass over a few rows should not start a task for each core."""
    df = df.persist()
    return df.coalesce(max(1, -(-df.count() // rows_per_task)))


def _label(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("label", F.col(label).cast("double")) if label != "label" else \
        df.withColumn("label", F.col("label").cast("double"))


def fit_pipeline(train: DataFrame, feats: list[str], est, label: str = "label",
                 scaler: str | None = "minmax") -> PipelineModel:
    """``est``: an estimator or a list of stages; scaling and penalties are fitted on ``train``."""
    stages = est if isinstance(est, list) else [est]
    n = train.count() if any(hasattr(e, "inverse_penalty") for e in stages) else 0
    return Pipeline(stages=[*assemble(train, feats, label, scaler), *(with_rows(e, n) for e in stages)]).fit(_label(train, label))


def predict(model: PipelineModel, df: DataFrame, key: str = "row_id", label: str = "label") -> DataFrame:
    """(key, y, yhat, p1) — p1 from the probability vector."""
    out = model.transform(_label(df, label))
    return out.select(key, F.col("label").cast("int").alias("y"), F.col("prediction").cast("int").alias("yhat"),
                      vector_to_array("probability")[1].alias("p1"))


def predict_all(models: dict[str, PipelineModel], df: DataFrame, key: str = "row_id", label: str = "label") -> DataFrame:
    """(key, y, p_<name> and y_<name> for each model): every member applied to the same
    rows in one projection, without a join."""
    t, base = _label(df, label), list(_label(df, label).columns)
    for name, m in models.items():
        t = m.transform(t).select(*base, vector_to_array("probability")[1].alias(f"p_{name}"),
                                  F.col("prediction").cast("int").alias(f"y_{name}"))
        base += [f"p_{name}", f"y_{name}"]
    return t.select(key, F.col("label").cast("int").alias("y"), *[c for c in base if c.startswith(("p_", "y_")) and c[2:] in models])


def _vote(names: list[str]):
    return sum((F.col(f"p_{n}") for n in names[1:]), F.col(f"p_{names[0]}")) / F.lit(float(len(names)))


def vote_columns(t: DataFrame, names: list[str], key: str = "row_id") -> DataFrame:
    """Soft vote over the p_<name> columns: (key, y, yhat, p1); a tie goes to class 0."""
    mean = _vote(names)
    return t.select(key, "y", (mean > 0.5).cast("int").alias("yhat"), mean.alias("p1"))


def side_by_side(jobs: list, threads: int = 8) -> list:
    """Results of independent fits, whose many small Spark jobs are submitted together."""
    with ThreadPool(min(threads, max(1, len(jobs)))) as pool:
        return pool.map(lambda f: f(), jobs)


def five_members(feats: list[str], rff: list[str], seed: int = 42) -> dict[str, tuple]:
    """The voters: {name: (feature columns, estimator, scaler)}; the SVM's RBF map is
    made of random Fourier features (columns ``rff``, scaled already)."""
    return {"forest": (feats, clf_forest(seed=seed), "minmax"), "gbt": (feats, clf_gbt(seed=seed), "minmax"),
            "svm": (rff, clf_svm("rbf", C=1.0), None), "mlp": (feats, clf_mlp(len(feats), seed=seed), "minmax"),
            "boosted_deep": (feats, clf_boosted_deep(seed=seed), "minmax")}


def fit_members(train: DataFrame, test: DataFrame, feats: list[str], scaler: str | None = "minmax", seed: int = 42,
                n_components: int = 50, key: str = "row_id") -> tuple[dict, DataFrame]:
    """Fit the five voters on ``train``; returns (models, ``predict_all`` of ``test``)."""
    from stratum.operators.features import fit_scale

    scale = fit_scale(train, feats, "standard")
    rff = [f"rff{i}" for i in range(n_components)]
    tr, te = (rff_features(d, feats, n_components, seed=seed, scale=scale) for d in (train, test))
    members = five_members(feats, rff, seed)
    tr.count()  # persisted rows are there before the fits ask for them side by side
    models = dict(zip(members, side_by_side([lambda f=f, e=e, sc=sc: fit_pipeline(tr, f, e, scaler=sc and scaler)
                                             for f, e, sc in members.values()])))
    return models, predict_all(models, te, key)


def vote_soft(preds: list[DataFrame], key: str = "row_id") -> DataFrame:
    """Mean of member class-1 probabilities; class 1 iff mean > 0.5 (a tie goes to
    the lower class, like argmax)."""
    base = preds[0].select(key, "y", F.col("p1").alias("_p0"))
    for i, p in enumerate(preds[1:], 1):
        base = base.join(p.select(key, F.col("p1").alias(f"_p{i}")), key)
    mean = sum((F.col(f"_p{i}") for i in range(1, len(preds))), F.col("_p0")) / F.lit(float(len(preds)))
    return base.select(key, "y", (mean > 0.5).cast("int").alias("yhat"), mean.alias("p1"))


# ------------------------------------------------------------------- tuning

KEPT = 1 << 30  # bytes that the fits of a grid search keep of their rows, over all executors


def _points(est, grid: dict) -> list[dict]:
    pg = ParamGridBuilder()
    for p, vals in grid.items():
        pg = pg.addGrid(est.getParam(p), vals)
    return pg.build()


def _fold_rows(d: DataFrame, folds: int) -> dict:
    rows = {r["fold"]: r["count"] for r in d.groupBy("fold").count().collect()}
    for f in range(folds):
        if not rows.get(f) or rows[f] == sum(rows.values()):
            raise ValueError(f"fold {f} leaves no rows for training or for test")
    return rows


def grid_search_boosted(df: DataFrame, feats: list[str], est: CellGBTClassifier, grid: dict, label: str = "label", folds: int = 3, seed: int = 0):
    """``grid_search`` of the boosted trees over maxIter, stepSize and maxDepth, with whole fits in tasks; where the
    rows' cells don't fit one task it is ``grid_search`` itself."""
    d = cut_lineage(kfold_stratified(_label(df, label), "label", folds, seed).withColumn("fold", F.col("fold").cast("int")))
    _fold_rows(d, folds)
    maps = [{k.name: v for k, v in pm.items()} for pm in _points(est, grid)]
    full = [{p: m.get(p, est.getOrDefault(p)) for p in ("maxDepth", "stepSize", "maxIter")} for m in maps]
    settings = list(dict.fromkeys((m["maxDepth"], m["stepSize"]) for m in full))
    stages = sorted({m["maxIter"] for m in full})
    got = side_by_side([lambda f=f: fold_accuracies(d, feats, f, settings, stages) for f in range(folds)])
    if set().union(*maps) - {"maxDepth", "stepSize", "maxIter"} or any(g is None for g in got):
        return grid_search(df, feats, est, grid, label, folds, seed)
    means = [float(np.mean([g[settings.index((m["maxDepth"], m["stepSize"])), stages.index(m["maxIter"])] for g in got])) for m in full]
    top = full[int(np.argmax(means))]
    whole = assemble(d, feats, label, None)[0]
    best = PipelineModel([whole, fit_in_task(d, feats, top["maxDepth"], top["stepSize"], top["maxIter"], FEAT)])
    return best, df.sparkSession.createDataFrame([(", ".join(f"{k}={v}" for k, v in m.items()), a) for m, a in zip(maps, means)], "params string, mean_accuracy double")


def grid_search(df: DataFrame, feats: list[str], est, grid: dict, label: str = "label", folds: int = 3,
                seed: int = 0, parallelism: int = 9):
    """Grid search over a fold column from ``kfold_stratified`` (accuracy); returns (best
    PipelineModel, table of (params, mean accuracy)).  What ``CrossValidator(foldCol)`` gives, but the
    fits of all folds are submitted side by side, on rows whose lineage is cut: a linear learner
    makes hundreds of small jobs, each of which sends the lineage out again."""
    d = kfold_stratified(_label(df, label), "label", folds, seed).withColumn("fold", F.col("fold").cast("int"))
    whole = sized(d)
    # more tasks than cores would only make each of the many jobs longer
    d = cut_lineage(whole.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))).persist()
    pipe, maps = Pipeline(stages=[*assemble(d, feats, "label"), est]), _points(est, grid)
    score = MulticlassClassificationEvaluator(metricName="accuracy")
    rows = _fold_rows(d, folds)
    # a fit keeps its rows while it lasts: no more of them at once than ``KEPT`` bytes hold
    parallelism = max(1, min(parallelism, KEPT // (8 * (len(feats) + 1) * max(1, sum(rows.values())))))
    jobs = [(i, f) for f in range(folds) for i in range(len(maps))]
    got = side_by_side([lambda i=i, f=f: score.evaluate(pipe.fit(d.where(F.col("fold") != f), maps[i]).transform(d.where(F.col("fold") == f)))
                        for i, f in jobs], parallelism)
    means = [float(np.mean([a for (j, _), a in zip(jobs, got) if j == i])) for i in range(len(maps))]
    best = pipe.fit(d, maps[int(np.argmax(means))])
    for t in (d, whole):
        t.unpersist()
    table = [(", ".join(f"{k.name}={v}" for k, v in pm.items()), a) for pm, a in zip(maps, means)]
    tab = df.sparkSession.createDataFrame(table, "params string, mean_accuracy double")
    return best, tab


def cross_validate(df: DataFrame, feats: list[str], est, label: str = "label", k: int = 5, seed: int = 0,
                   key: str = "row_id") -> DataFrame:
    """Per-fold accuracy on a hash fold column: (fold, accuracy)."""
    d = sized(kfold_stratified(_label(df, label), "label", k, seed, key))
    rows = []
    for f in range(k):
        m = fit_pipeline(d.where(F.col("fold") != f), feats, est)
        p = predict(m, d.where(F.col("fold") == f), key)
        rows.append((f, float(p.agg(F.avg((F.col("y") == F.col("yhat")).cast("double"))).first()[0])))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double")


def cv_summary(folds: DataFrame) -> DataFrame:
    """mean accuracy and 2·std (population, as numpy)."""
    return folds.agg(F.avg("accuracy").alias("mean_accuracy"), (2 * F.stddev_pop("accuracy")).alias("two_std"))


# ---------------------------------------------------------------- contests

def holdout(df: DataFrame, label: str = "label", seed: int = 42, key: str = "row_id", test_size: float = 0.2):
    """(training rows, test rows) of one stratified split, persisted together."""
    s = sized(split_stratified(_label(df, label), "label", test_size, seed, key))
    return s.where(~F.col("is_test")).drop("is_test"), s.where(F.col("is_test")).drop("is_test")


def train_eval(df: DataFrame, feats: list[str], est, label: str = "label", seed: int = 42, key: str = "row_id",
               scaler: str | None = "minmax") -> DataFrame:
    """Stratified 80/20 split → fit on train → test predictions (key, y, yhat, p1)."""
    train, test = holdout(df, label, seed, key)
    return predict(fit_pipeline(train, feats, est, scaler=scaler), test, key)


def accuracy_of(pred: DataFrame) -> float:
    return float(pred.agg(F.avg((F.col("y") == F.col("yhat")).cast("double"))).first()[0])


def reduced(train: DataFrame, test: DataFrame, feats: list[str], method: str, key: str = "row_id"):
    """Min-max scale, then reduce; both fitted on training rows.  Returns
    (training rows, test rows, feature columns) for baseline | pca | ica | feature_selection."""
    from stratum.operators import features as E

    params = E.fit_scale(train, feats, "minmax")
    tr, te = (E.apply_scale(d, params) for d in (train, test))
    if method == "pca":
        fit = E.pca_fit(tr, feats)
        tr, te = (E.pca_project(d, feats, var_threshold=0.95, fit=fit)[0] for d in (tr, te))
    elif method == "ica":
        fit = E.ica_fit(tr, feats, k=min(10, len(feats)))
        tr, te = (E.ica_apply(d, feats, fit) for d in (tr, te))
    elif method == "feature_selection":
        keep, _ = E.select_features_by_importance(tr, feats, "label")
        tr, te = (d.select(key, "label", *keep) for d in (tr, te))
    return tr, te, [c for c in tr.columns if c not in (key, "label")]


APPROACHES = ["baseline", "pca", "ica", "feature_selection"]


def compare_reduction(df: DataFrame, feats: list[str], label: str = "label", seed: int = 42, key: str = "row_id",
                      approaches: list[str] = APPROACHES, est=None) -> DataFrame:
    """(approach, declared, accuracy): a forest per approach on one split's test rows."""
    train, test = holdout(df.select(key, *feats, label), label, seed, key)

    def one(name):
        tr, te, cols = reduced(train, test, feats, name, key)
        return accuracy_of(predict(fit_pipeline(tr, cols, est or clf_forest(), scaler=None), te, key))

    scores = side_by_side([lambda n=n: one(n) for n in approaches])
    rows = [(n, i, a) for i, (n, a) in enumerate(zip(approaches, scores))]
    return df.sparkSession.createDataFrame(rows, "approach string, declared int, accuracy double")


class FittedScores:
    """What ``select_flow`` asks for, from models fitted on one stratified split."""

    def __init__(self, df: DataFrame, feats: list[str], label: str = "label", seed: int = 42, key: str = "row_id"):
        self.df, self.feats, self.label, self.seed, self.key = df, feats, label, seed, key
        self._split = None

    def correlations(self) -> DataFrame:
        """(a, b, corr) of features and label."""
        from stratum.operators import stats as S

        return S.corr_matrix(self.df.select(*self.feats, F.col(self.label).cast("double").alias(self.label)), [*self.feats, self.label])

    def reductions(self) -> DataFrame:
        """(approach, declared, accuracy)."""
        return compare_reduction(self.df, self.feats, self.label, self.seed, self.key, ["baseline", "pca", "ica"])

    def voters(self, method: str, scaler: str | None) -> DataFrame:
        """(key, y, p_<voter>, y_<voter>) of the test rows."""
        if self._split is None:
            self._split = holdout(self.df.select(self.key, *self.feats, self.label), self.label, self.seed, self.key)
        train, test = self._split
        if method == "baseline":
            return fit_members(train, test, self.feats, scaler, self.seed, key=self.key)[1]
        tr, te, cols = reduced(train, test, self.feats, method, self.key)
        return fit_members(tr, te, cols, None, self.seed, key=self.key)[1]


def select_flow(scores, label: str = "label") -> list[tuple]:
    """The training flow's decisions as rows (step, choice, accuracy), whatever gives the
    scores (see ``FittedScores``): strongest correlation with the label; reduction contest,
    whose winner overrides the flags (the first declared of equals); without reduction the
    scaler contest (min-max only if strictly better); five voters; the best single voter
    (the first of equals) only if strictly better than the vote."""
    from stratum.operators import stats as S

    top = S.top_correlated(scores.correlations(), label, 1).first()
    rows = [("correlation", top["feature"] if top else None, float(top["corr"]) if top else None)]
    contest = scores.reductions().orderBy(F.desc("accuracy"), "declared").collect()
    method = contest[0]["approach"]
    rows += [(f"reduction:{r['approach']}", r["approach"], r["accuracy"]) for r in sorted(contest, key=lambda r: r["declared"])]

    def measure(scaler):  # accuracy of the vote and of each voter, in one aggregation
        hit = lambda yhat: F.avg((yhat == F.col("y")).cast("double"))
        return scores.voters(method, scaler).agg(hit((_vote(VOTERS) > 0.5).cast("int")).alias("vote"),
                                                 *[hit(F.col(f"y_{n}")).alias(n) for n in VOTERS]).first()

    if method == "baseline":
        tried = {s: measure(s) for s in ("standard", "minmax")}
        rows += [(f"scaler:{s}", s, m["vote"]) for s, m in tried.items()]
        got = tried["minmax" if tried["minmax"]["vote"] > tried["standard"]["vote"] else "standard"]
    else:
        got = measure(None)
    rows += [(f"member:{n}", n, got[n]) for n in VOTERS]
    best = max(VOTERS, key=lambda n: got[n])
    return [*rows, ("ensemble", "vote_soft", got["vote"]),
            ("chosen", *((best, got[best]) if got[best] > got["vote"] else ("ensemble", got["vote"])))]


def train_select(df: DataFrame, feats: list[str], label: str = "label", seed: int = 42, key: str = "row_id") -> DataFrame:
    """``select_flow`` on models fitted here, as a table (step, choice, accuracy)."""
    rows = select_flow(FittedScores(df, feats, label, seed, key), label)
    return df.sparkSession.createDataFrame(rows, "step string, choice string, accuracy double")


VOTERS = ["forest", "gbt", "svm", "mlp", "boosted_deep"]


def rank_approaches(results: DataFrame, metric: str = "accuracy", order_col: str = "declared") -> DataFrame:
    """Approaches by metric desc, declaration order breaking ties; best and runner-up."""
    return results.orderBy(F.col(metric).desc(), order_col).limit(2)


def balancing_fold_scores(sets: dict[str, DataFrame], feats: list[str], repeats: int = 10, k: int = 5, trees: int = 200,
                          key: str = "row_id", depth: int = 30, bins: int = 32, seed: int = 42, held: int = 32 << 20) -> DataFrame:
    """Accuracy per (method, repeat, fold): each balanced set gets its own hash folds
    (seed = repeat), and a forest is fitted for every fold of every repeat of every
    set.  The forests of a set are grown together, as many as keep what a task holds
    of the models' counts within ``held`` bytes."""
    from stratum.operators import trees as T

    names = list(sets)
    rows = None
    for i, d in enumerate(sets.values()):
        one = d.select(key, *feats, F.col("label").cast("int").alias("_y"), F.lit(i).alias("_set"))
        rows = one if rows is None else rows.unionByName(one)
    rows = kfold_repeated(cut_lineage(rows), ["_set", "_y"], k, repeats, key)
    folds = [(r, f) for r in range(repeats) for f in range(k)]
    rows = rows.withColumn("_flags", F.array(*[F.col("_folds")[r] == f for r, f in folds]))
    counted = cut_lineage(T.cell_counts(T.bin_rows(rows, feats, T.bin_edges(rows, feats, bins), key, ["_y", "_set", "_flags"]), ["_set"]))
    sizes = {r["_set"]: r["count"] for r in counted.groupBy("_set").count().collect()}

    def hits(i, some):  # of some folds' forests of one set
        def counts(b):  # rows for training and for test, per model
            test = np.column_stack([b.column(f"_k{folds.index(x)}").to_numpy() for x in some])
            return b.column("_n").to_numpy()[:, None] - test, test

        cells = T.model_rows(counted.where(F.col("_set") == i), ["_set"], counts).persist()
        laid = T.laid_out(cells)
        got = T.forest_hits(laid, len(feats), [f"{names[i]}|{r}|{f}" for r, f in some], trees, depth, bins=bins, seed=seed)
        laid.unpersist()
        cells.unpersist()
        return [(names[i], r, f, float(x[1] / x[0])) for (r, f), x in zip(some, got) if x[0]]

    out = []
    for i in sorted(sizes):
        # two numbers of 8 bytes per cell and model, which every task holds
        step = max(1, held // (16 * sizes[i]))
        out += [x for a in range(0, len(folds), step) for x in hits(i, folds[a:a + step])]
    return next(iter(sets.values())).sparkSession.createDataFrame(out, "method string, repeat int, fold int, accuracy double")


def reference_grids(n_features: int, n_rows: int) -> dict:
    """Four tuning grids, mapped onto Spark ML params (grid values: fixed values); the
    network's is ``network_grid``.

    Dropped (no Spark equivalent): forest ``min_samples_split``; SVM ``gamma``.  The SVM's kernel choice is two
    searches: these features (linear), and ``rff_features`` of them (rbf).  ``max_depth=None`` → Spark's max 30.
    Returns {family: (estimator, {param: values})}."""
    n = max(n_rows, 1)
    return {
        "forest": (clf_forest(), {"numTrees": [100, 200], "maxDepth": [30, 10, 20], "minInstancesPerNode": [1, 2]}),
        "gbt": (clf_gbt(), {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 5]}),
        "svm": (clf_svm("linear")[0].estimator, {"regParam": [1.0 / (c * n) for c in (0.1, 1.0, 10.0)]}),
        "boosted_deep": (clf_boosted_deep(), {"maxIter": [100, 200], "maxDepth": [3, 5, 7],
                                              "stepSize": [0.05, 0.1, 0.2]}),
    }


def network_grid(n_features: int, max_iter: int = 1000) -> dict:
    """The network's tuning grid (grid values: fixed values) as {params: estimator}.  The
    schedule of the learning rate is no axis: it has no meaning for Adam."""
    return {f"hidden={hidden}, alpha={alpha}": clf_mlp(n_features, hidden, max_iter, alpha=alpha)
            for hidden in [(50,), (100,), (50, 50)] for alpha in [0.0001, 0.001]}


def score_candidates(df: DataFrame, feats: list[str], candidates: dict, label: str = "label", folds: int = 3, seed: int = 0,
                     key: str = "row_id", scaler: str | None = "minmax", threads: int = 8) -> DataFrame:
    """Mean accuracy of estimators that have no parameter map, on the hash folds that
    ``grid_search`` uses: (params, mean_accuracy, is_best); the first of equals is best.
    Fits run side by side and return one number each; a fold without rows counts for none."""
    d = sized(kfold_stratified(_label(df, label).select(key, *feats, "label"), "label", folds, seed, key))

    def one(name, f):
        test = d.where(F.col("fold") == f)
        if test.limit(1).count() == 0:
            return None
        return accuracy_of(predict(fit_pipeline(d.where(F.col("fold") != f), feats, candidates[name], scaler=scaler), test, key))

    jobs = [(n, f) for n in candidates for f in range(folds)]
    got = dict(zip(jobs, side_by_side([lambda n=n, f=f: one(n, f) for n, f in jobs], threads)))
    d.unpersist()
    means = {n: [got[n, f] for f in range(folds) if got[n, f] is not None] for n in candidates}
    means = {n: float(np.mean(v)) for n, v in means.items() if v}
    best = max(means, key=means.get) if means else None
    return df.sparkSession.createDataFrame([(n, m, n == best) for n, m in means.items()],
                                           "params string, mean_accuracy double, is_best boolean")


def tune_families(df: DataFrame, feats: list[str], grids: dict, label: str = "label", folds: int = 3,
                  seed: int = 0):
    """Grid-search every family on the same hash folds; returns (best models by
    family, table (family, params, mean_accuracy, is_best)); the overall best
    single model is the strictly highest mean accuracy (first family wins ties).
    A family without an estimator has a dict of them (``score_candidates``) for its grid."""
    best, rows = {}, []
    for fam, (est, grid) in grids.items():
        if est is None:
            tab = score_candidates(df, feats, grid, label, folds, seed)
            top = max(tab.collect(), key=lambda r: r["mean_accuracy"])["params"]
            m = fit_pipeline(df, feats, grid[top], label)
        else:
            m, tab = (grid_search_boosted if isinstance(est, CellGBTClassifier) else grid_search)(df, feats, est, grid, label, folds, seed)
        best[fam] = m
        top = max(r["mean_accuracy"] for r in tab.collect())
        rows += [(fam, r["params"], float(r["mean_accuracy"]), r["mean_accuracy"] == top) for r in tab.collect()]
    spark = df.sparkSession
    return best, spark.createDataFrame(rows, "family string, params string, mean_accuracy double, is_best boolean")
