"""E. Feature construction, scaling and dimensionality reduction.

Scalers and transforms are fit with ONE aggregation and applied as a single
generated projection (never chained ``withColumn``).  PCA uses Spark ML's
distributed covariance; ICA iterations are each one native aggregation of
k² + k expressions (no Python in the hot path); only k×k matrices reach the
driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.exprs import numeric_columns


def _fit(df: DataFrame, aggs) -> dict:
    return df.agg(*aggs).first().asDict()


# ------------------------------------------------------------------- transforms

def log1p_skewed(df: DataFrame, cols: list[str] | None = None, key: str = "row_id",
                 threshold: float = 1.0) -> tuple[DataFrame, list[str]]:
    """log1p of every column whose values are all > 0 (a null fails the test) and
    whose bias-corrected skewness G1 = g1·sqrt(n(n−1))/(n−2) exceeds ``threshold``."""
    cols = cols or numeric_columns(df, exclude=(key,))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(x).alias(f"k{i}"), F.min(x).alias(f"lo{i}"), F.skewness(x).alias(f"g{i}")]
    p = _fit(df, aggs)
    chosen = []
    for i, c in enumerate(cols):
        n = p[f"k{i}"]
        if n != p["_n"] or p[f"lo{i}"] is None or p[f"lo{i}"] <= 0 or n < 3 or p[f"g{i}"] is None:
            continue
        g1 = p[f"g{i}"] * math.sqrt(n * (n - 1)) / (n - 2)
        if abs(g1) > threshold:
            chosen.append(c)
    out = df.select(*[F.log1p(F.col(c).cast("double")).alias(c) if c in chosen else F.col(c) for c in df.columns])
    return out, chosen


def interactions(df: DataFrame, cols: list[str]) -> DataFrame:
    """``a_x_b`` for every pair; ``a_div_b`` only when b has no zero (one probe
    aggregation, then a single projection)."""
    z = _fit(df, [F.sum((F.col(c) == 0).cast("long")).alias(f"z{i}") for i, c in enumerate(cols)])
    new = []
    for i, a in enumerate(cols[:-1]):
        for j in range(i + 1, len(cols)):
            b = cols[j]
            new.append((F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}_x_{b}"))
            if not z[f"z{j}"]:
                new.append((F.col(a).cast("double") / F.col(b).cast("double")).alias(f"{a}_div_{b}"))
    return df.select("*", *new)


def prepare_features(df: DataFrame, target: str, key: str = "row_id") -> DataFrame:
    """log1p of skewed positive columns, then pairwise interactions of the numeric columns."""
    nums = numeric_columns(df, exclude=(key, target))
    out, _ = log1p_skewed(df, nums, key)
    return interactions(out, nums) if len(nums) >= 2 else out


def fit_scale(df: DataFrame, cols: list[str], kind: str = "minmax") -> dict[str, tuple[float, float]]:
    """{column: (shift, divisor)} from one aggregation; a constant column's divisor is 1."""
    x = [F.col(c).cast("double") for c in cols]
    if kind == "minmax":
        p = _fit(df, [a for i, v in enumerate(x) for a in (F.min(v).alias(f"s{i}"), (F.max(v) - F.min(v)).alias(f"d{i}"))])
    else:
        p = _fit(df, [a for i, v in enumerate(x) for a in (F.avg(v).alias(f"s{i}"), F.stddev_pop(v).alias(f"d{i}"))])
    return {c: (float(p[f"s{i}"] or 0.0), float(p[f"d{i}"] or 1.0)) for i, c in enumerate(cols)}


def apply_scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    ex = {c: ((F.col(c).cast("double") - F.lit(s)) / F.lit(d)).alias(c) for c, (s, d) in params.items()}
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


def scale_minmax(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − min)/(max − min); a constant column maps to 0."""
    p = _fit(df, [a for i, c in enumerate(cols) for a in (F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))])
    ex = {}
    for i, c in enumerate(cols):
        lo, hi = p[f"lo{i}"], p[f"hi{i}"]
        rng = (hi - lo) if lo is not None and hi != lo else 1.0
        ex[c] = ((F.col(c).cast("double") - F.lit(lo if lo is not None else 0.0)) / F.lit(float(rng))).alias(c)
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


def scale_standard(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x − mean)/std with population std; a constant column keeps divisor 1."""
    p = _fit(df, [a for i, c in enumerate(cols)
                  for a in (F.avg(F.col(c).cast("double")).alias(f"m{i}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))])
    ex = {}
    for i, c in enumerate(cols):
        s = p[f"s{i}"] or 1.0
        ex[c] = ((F.col(c).cast("double") - F.lit(p[f"m{i}"] or 0.0)) / F.lit(float(s))).alias(c)
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


def scale_robust(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """(x − median)/IQR (exact quantiles by default); IQR 0 keeps divisor 1."""
    from stratum.operators.quantiles import exact_quantiles

    probs = [0.25, 0.5, 0.75]
    if approx:
        p = _fit(df, [F.percentile_approx(F.col(c).cast("double"), probs, 100000).alias(c) for c in cols])
    else:
        p = exact_quantiles(df, cols, probs)
    ex = {}
    for i, c in enumerate(cols):
        q1, med, q3 = p[c]
        iqr = (q3 - q1) or 1.0
        ex[c] = ((F.col(c).cast("double") - F.lit(med)) / F.lit(float(iqr))).alias(c)
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


# ------------------------------------------------------------------------- PCA

def _project(df: DataFrame, cols: list[str], mean: list[float], comp: np.ndarray, names: list[str],
             keep: list[str]) -> DataFrame:
    """Centered projection as native multiply-adds (k × d per row)."""
    cen = [F.col(c).cast("double") - F.lit(float(m)) for c, m in zip(cols, mean)]
    outs = []
    for j, nm in enumerate(names):
        e = cen[0] * F.lit(float(comp[0, j]))
        for i in range(1, len(cols)):
            e = e + cen[i] * F.lit(float(comp[i, j]))
        outs.append(e.alias(nm))
    return df.select(*keep, *outs)


def pca_fit(df: DataFrame, cols: list[str]) -> dict:
    """Distributed covariance PCA (Spark ML) over complete rows: all d components,
    variance ratios, column means; each component's sign fixed so that its
    largest-|loading| entry is positive."""
    from pyspark.ml.feature import PCA, VectorAssembler

    clean = df.na.drop(subset=cols)
    v = VectorAssembler(inputCols=cols, outputCol="_v").transform(clean).select("_v")
    model = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(v)
    raw = model.pc.toArray()
    signs = np.ones(raw.shape[1])
    for j in range(raw.shape[1]):
        if raw[int(np.argmax(np.abs(raw[:, j]))), j] < 0:
            signs[j] = -1.0
    row = clean.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mean = [row[f"m{i}"] for i in range(len(cols))]
    return {"components": raw * signs[None, :], "raw": raw, "signs": signs, "model": model,
            "ratio": np.asarray(model.explainedVariance.toArray()), "mean": mean, "cols": cols}


def pca_project(df: DataFrame, cols: list[str], k: int | None = None, var_threshold: float = 0.95,
                key: str = "row_id", fit: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Project onto PC1..PCk (k fixed, or the smallest k reaching ``var_threshold``
    of the variance).  Returns (projected frame, explained-variance table)."""
    fit = fit or pca_fit(df, cols)
    ratio = fit["ratio"]
    if k is None:
        k = int(np.searchsorted(np.cumsum(ratio), var_threshold - 1e-12) + 1)
        k = min(k, len(cols))
    names = [f"PC{j + 1}" for j in range(k)]
    keep = [c for c in df.columns if c not in cols]
    clean = df.na.drop(subset=cols)
    if len(cols) * k <= 256:
        proj = _project(clean, cols, fit["mean"], fit["components"][:, :k], names, keep)
    else:
        # wide: the fitted model multiplies in the JVM (one BLAS gemv per row);
        # centring is a constant offset per component: sign · (wᵀx − wᵀμ)
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        off = fit["raw"].T @ np.asarray(fit["mean"])
        v = VectorAssembler(inputCols=cols, outputCol="_v").transform(clean)
        t = fit["model"].setInputCol("_v").setOutputCol("_p").transform(v)
        arr = vector_to_array(F.col("_p"))
        proj = t.select(*keep, *[(F.lit(float(fit["signs"][j])) * (arr[j] - F.lit(float(off[j])))).alias(nm)
                                 for j, nm in enumerate(names)])
    return proj, explained_variance(df.sparkSession, ratio)


def explained_variance(spark, ratio) -> DataFrame:
    cum = np.cumsum(ratio)
    rows = [(j + 1, float(ratio[j]), float(cum[j])) for j in range(len(ratio))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


# ------------------------------------------------------------------------- ICA

def _ica_sums(z: DataFrame, zcols: list[str], tries: list[np.ndarray]) -> list[tuple]:
    """For each candidate unmixing: means of log cosh y (k), tanh(y_i) y_j (k x k) and
    1 - tanh^2 y (k), of all candidates in ONE aggregation (partial sums per task)."""
    k, shared = len(zcols), z.sparkSession.sparkContext.broadcast(tries)

    def run(batches):
        sums, n = np.zeros((len(shared.value), k * k + 2 * k)), 0
        for b in batches:
            x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False) for c in zcols])
            n += len(x)
            for c, w in enumerate(shared.value):
                y = x @ w.T
                t, a = np.tanh(y), np.abs(y)
                sums[c] += np.concatenate([(a + np.log1p(np.exp(-2 * a)) - np.log(2)).sum(axis=0), (t.T @ y).ravel(), (1 - t * t).sum(axis=0)])
        flat = np.append(sums.ravel(), n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    got = z.select(*zcols).mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(len(tries) * (k * k + 2 * k) + 1)
    flat[got["i"].to_numpy()] = got["v"].to_numpy()
    means = (flat[:-1] / max(flat[-1], 1)).reshape(len(tries), -1)
    return [(m[:k], m[k:-k].reshape(k, k), m[-k:]) for m in means]


def ica_fit(df: DataFrame, cols: list[str], k: int | None = None, max_iter: int = 100, tol: float = 1e-4,
            seed: int = 42) -> dict:
    """ICA (parallel, logcosh) on PCA-whitened data, by preconditioned quasi-Newton steps
    over rotations (Ablin, Cardoso, Gramfort 2018).

    At an unmixing W the relative gradient is the skew part of S E[tanh(y) y^T], where
    the sign S_i tells whether log cosh is to be raised or lowered for component i; its
    Hessian is close to diagonal, so a step is the matrix exponential of the gradient
    divided by it.  Each iteration is ONE aggregation over the cached whitened rows
    that scores several step lengths and yields the next gradient of whichever is
    taken; k x k algebra runs on the driver.  Returns mean, matrix (columns ->
    components), converged, n_iter, residual (largest gradient entry), unmixing.

    Components without structure (Gaussian data) have no direction to converge to:
    the fit stops after ``max_iter``, or when no step length improves, with
    ``converged`` false and the last unmixing, which is still a rotation."""
    d = len(cols)
    k = k or min(df.count(), d, 10)
    fit = pca_fit(df, cols)
    comp = fit["components"][:, :k]
    # whitening: divide each principal score by its standard deviation
    clean = df.na.drop(subset=cols)
    var_total = clean.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    total = sum(float(var_total[c] or 0.0) for c in cols)
    sd = np.sqrt(np.maximum(fit["ratio"][:k] * total, 1e-300))
    zcols = [f"_z{j}" for j in range(k)]
    z = _project(clean, cols, fit["mean"], comp / sd[None, :], zcols, []).persist()

    W = _sym_decorrelate(np.random.default_rng(seed).standard_normal((k, k)))
    lengths, converged, it, resid, stalled = (1.0, 0.5, 0.1, 0.02), False, 0, float("nan"), 0
    state, signs = _ica_sums(z, zcols, [W])[0], None
    for it in range(1, max_iter + 1):
        logcosh, ty, dt = state
        kind = dt - np.diag(ty)  # E[psi'] - E[psi y]: positive for heavy tails
        changed = signs is None or (np.sign(kind) != signs).any()
        signs = np.where(kind >= 0, 1.0, -1.0)
        g = signs[:, None] * ty
        g = (g - g.T) / 2
        resid = float(np.abs(g).max(initial=0.0))
        if resid < tol:
            converged = True
            break
        h = (np.abs(kind)[:, None] + np.abs(kind)[None, :]) / 2
        step = -g / np.maximum(h, 0.01)
        tries = [_sym_decorrelate(_rotation(step * a) @ W) for a in lengths]
        scored = _ica_sums(z, zcols, tries)
        losses = [float((signs * s[0]).sum()) for s in scored]
        best = int(np.argmin(losses))
        # lengths that do not lower the loss are noise of its rounding; a few are let pass
        stalled = 0 if changed or losses[best] < float((signs * logcosh).sum()) - 1e-12 else stalled + 1
        if stalled > 5:
            break
        W, state = tries[best], scored[best]
    z.unpersist()
    return {"mean": fit["mean"], "matrix": (comp / sd[None, :]) @ W.T, "converged": converged, "n_iter": it,
            "residual": resid, "unmixing": W}


def _rotation(skew: np.ndarray) -> np.ndarray:
    """Matrix exponential of a real skew-symmetric matrix, by the eigenvectors of i times it."""
    lam, u = np.linalg.eigh(1j * skew)
    return np.real((u * np.exp(-1j * lam)) @ u.conj().T)


def ica_apply(df: DataFrame, cols: list[str], fit: dict) -> DataFrame:
    """IC1..ICk of complete rows, other columns kept."""
    names = [f"IC{i + 1}" for i in range(fit["matrix"].shape[1])]
    return _project(df.na.drop(subset=cols), cols, fit["mean"], fit["matrix"], names, [c for c in df.columns if c not in cols])


def ica_components(df: DataFrame, cols: list[str], k: int | None = None, max_iter: int = 100, tol: float = 1e-4,
                   seed: int = 42, key: str = "row_id") -> tuple[DataFrame, dict]:
    """(frame with IC1..ICk, the fit) on the same rows."""
    fit = ica_fit(df, cols, k, max_iter, tol, seed)
    return ica_apply(df, cols, fit), fit


def _sym_decorrelate(W: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(W @ W.T)
    s = np.clip(s, 1e-300, None)
    return (u * (1.0 / np.sqrt(s))) @ u.T @ W


def component_kurtosis(df: DataFrame, cols: list[str]) -> DataFrame:
    """Excess kurtosis (population, biased) per column in one aggregation."""
    one = df.agg(*[F.kurtosis(F.col(c).cast("double")).alias(f"k{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("component"), F.col(f"k{i}").alias("kurtosis")) for i, c in enumerate(cols)])
    return one.select(F.inline(arr))


# --------------------------------------------------------------- importances

def feature_importance_rank(model, feats: list[str]) -> list[tuple[str, float]]:
    """Sorted (feature, importance) from a fitted tree ensemble (or its best /
    first member having importances)."""
    m = model
    for cand in (m, getattr(m, "bestModel", None), *(getattr(m, "stages", []) or [])[::-1]):
        if cand is not None and hasattr(cand, "featureImportances"):
            imp = cand.featureImportances.toArray()
            return sorted(zip(feats, map(float, imp)), key=lambda t: (-t[1], t[0]))
    return []


def select_features_by_importance(df: DataFrame, feats: list[str], label: str = "label", num_trees: int = 200,
                                  seed: int = 42, max_depth: int = 30) -> tuple[list[str], DataFrame]:
    """Random-forest importances; keep features with importance ≥ the median."""
    from pyspark.ml.feature import VectorAssembler

    from stratum.operators.forest import ForestClassifier

    v = VectorAssembler(inputCols=feats, outputCol="_f", handleInvalid="skip").transform(df)
    rf = ForestClassifier(featuresCol="_f", labelCol=label, numTrees=num_trees, seed=seed, maxDepth=max_depth).fit(v)
    ranked = feature_importance_rank(rf, feats)
    med = float(np.median([v for _, v in ranked])) if ranked else 0.0
    keep = [f for f, v in ranked if v >= med]
    tab = df.sparkSession.createDataFrame([(f, v, v >= med) for f, v in ranked],
                                          "feature string, importance double, selected boolean")
    return keep, tab
