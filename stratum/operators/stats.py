"""F. Statistics and tests.

Moments are shared: one aggregation produces per-(class, feature) n / mean /
variance for every feature at once, and every test (Welch, ANOVA, Cohen d,
point-biserial) is arithmetic on that small table plus the native p-value
kernel (``stratum.functions.pvalue``), whose cost is per result row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.exprs import safe_div, stack
from stratum.functions.hashing import hash_uniform
from stratum.functions.pvalue import t_sf2, with_f_sf, with_t_sf2

# ------------------------------------------------------------------ correlation

def _pair_corr(a: str, b: str) -> Column:
    """Pearson on pairwise-complete rows; NULL (not an error) for a constant column."""
    xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
    both = xa.isNotNull() & xb.isNotNull()
    va = F.var_pop(F.when(both, xa))
    vb = F.var_pop(F.when(both, xb))
    return F.try_divide(F.covar_pop(xa, xb), F.sqrt(va * vb))


def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Long table (a, b, corr) for every pair a < b (column order): Pearson over the
    rows in which both are there, at every width; NULL if one is constant there.

    Values are shifted by the column's minimum (which changes no correlation).
    Each task reduces its rows to six sums per pair with a handful of matrix
    products, so the shuffle is pairs x tasks short rows, partially aggregated."""
    x = [F.col(c).cast("double") for c in cols]
    low = df.agg(*[F.min(v).alias(f"c{i}") for i, v in enumerate(x)]).first()
    low = [low[i] or 0.0 for i in range(len(cols))]
    slim = df.select(*[(v - F.lit(float(m))).alias(f"c{i}") for i, (v, m) in enumerate(zip(x, low))])
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def sums(batches):
        d, total = len(cols), None
        for batch in batches:
            v = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(d)])
            here = ~np.isnan(v)
            v, m = np.where(here, v, 0.0), here.astype(float)
            # [i, j]: count, sum of i, sum of i squared, sum of i times j, over rows that have both
            part = np.stack([m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(d, 1)
            n, s1, s2, s11 = total
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()),
                 *[pa.array(t) for t in (n[i, j], s1[i, j], s1[j, i], s2[i, j], s2[j, i], s11[i, j])]],
                names=["i", "j", *names])

    t = (slim.mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in names))
         .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names]))
    var = lambda one, two: F.col(two) - F.col(one) * F.col(one) / F.col("n")
    # what a constant leaves behind is rounding of the sum of squares
    solid = lambda one, two: F.when(var(one, two) > F.col(two) * 1e-12, var(one, two))
    r = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / F.sqrt(solid("sa", "saa") * solid("sb", "sbb"))
    name = F.array(*[F.lit(c) for c in cols])
    got = t.where("n > 0").select("i", "j", r.alias("corr"))
    # pairs that no row holds together are NULL, like constants: the pair table is fixed by the columns
    pairs = df.sparkSession.createDataFrame([(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))], "i int, j int")
    return pairs.join(F.broadcast(got), ["i", "j"], "left").select(
        F.element_at(name, F.col("i") + 1).alias("a"), F.element_at(name, F.col("j") + 1).alias("b"), "corr")


def top_correlated(corr_long: DataFrame, target: str, k: int = 4) -> DataFrame:
    """Top-k |corr| with the target (target itself skipped); ties by name."""
    t = corr_long.where((F.col("a") == target) | (F.col("b") == target)).select(
        F.when(F.col("a") == target, F.col("b")).otherwise(F.col("a")).alias("feature"), "corr")
    return t.where(F.col("corr").isNotNull()).orderBy(F.abs("corr").desc(), "feature").limit(k)


def point_biserial(df: DataFrame, binary: str, numeric: list[str], top: int | None = 10) -> DataFrame:
    """r between a 0/1 column and each numeric column (pairwise complete), its
    two-sided p-value (t² = r²(n−2)/(1−r²), F(1, n−2)), sorted by |r|."""
    aggs = []
    for i, c in enumerate(numeric):
        both = F.col(binary).isNotNull() & F.col(c).isNotNull()
        aggs += [_pair_corr(binary, c).alias(f"r{i}"), F.sum(both.cast("long")).alias(f"n{i}")]
    one = df.agg(*aggs)
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("correlation"),
                             F.col(f"n{i}").alias("n")) for i, c in enumerate(numeric)])
    t = one.select(F.lit(binary).alias("binary"), F.inline(arr))
    r2 = F.col("correlation") * F.col("correlation")
    t2 = F.when(r2 >= 1, F.lit(None).cast("double")).otherwise(r2 * (F.col("n") - 2) / (F.lit(1.0) - r2))
    t = with_f_sf(t.withColumn("_t2", t2), ["feature"], F.col("_t2"), F.lit(1.0), F.col("n") - 2, out="_p")
    p = F.when(r2 >= 1, F.lit(0.0)).otherwise(F.col("_p"))
    out = t.select("binary", "feature", "correlation", p.alias("p_value"), "n")
    if top:
        out = out.orderBy(F.abs("correlation").desc_nulls_last(), "feature").limit(top)
    return out


# ---------------------------------------------------------------------- moments

def class_moments(df: DataFrame, label: str, features: list[str], classes=(0, 1), wide_limit: int = 16) -> DataFrame:
    """(feature, n_c, mean_c, var_c for each class c) from ONE pass.

    Few features: one wide aggregation.  Many features: rows are unpivoted to
    (feature, value) and grouped by feature with conditional aggregates — a
    handful of expressions instead of 6·d (fast codegen), partial aggregation
    map-side, and the final aggregation spread over features."""
    if len(features) <= wide_limit:
        aggs = []
        for i, f in enumerate(features):
            x = F.col(f).cast("double")
            for c in classes:
                xc = F.when(F.col(label) == c, x)
                aggs += [F.count(xc).alias(f"n{c}_{i}"), F.avg(xc).alias(f"m{c}_{i}"),
                         F.var_samp(xc).alias(f"v{c}_{i}")]
        one = df.agg(*aggs)
        fields = lambda i: [F.lit(features[i]).alias("feature")] + [
            F.col(f"{k}{c}_{i}").alias(f"{k}{c}") for c in classes for k in ("n", "m", "v")]
        return one.select(F.inline(F.array(*[F.struct(*fields(i)) for i in range(len(features))])))
    long = df.select(F.col(label).alias("_y"),
                     F.inline(stack([(f, F.col(f).cast("double")) for f in features], "feature", "_x")))
    aggs = []
    for c in classes:
        xc = F.when(F.col("_y") == c, F.col("_x"))
        aggs += [F.count(xc).alias(f"n{c}"), F.avg(xc).alias(f"m{c}"), F.var_samp(xc).alias(f"v{c}")]
    return long.groupBy("feature").agg(*aggs)


def welch_ttest_features(df: DataFrame, label: str, features: list[str], alpha: float = 0.05) -> DataFrame:
    """Per feature, class 0 vs class 1: Welch t (class0 − class1), p, class means,
    mean_difference (class1 − class0), Cohen d with the mean of the two variances,
    significance at alpha and at alpha/d (Bonferroni), −log10 p."""
    m = class_moments(df, label, features)
    se2 = F.col("v0") / F.col("n0") + F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(se2))
    dfw = F.try_divide(se2 * se2, F.pow(F.col("v0") / F.col("n0"), 2) / (F.col("n0") - 1)
                       + F.pow(F.col("v1") / F.col("n1"), 2) / (F.col("n1") - 1))
    pooled = F.sqrt((F.col("v0") + F.col("v1")) / 2.0)
    diff = F.col("m1") - F.col("m0")
    eff = F.when(pooled == 0, F.lit(0.0)).otherwise(diff / pooled)
    r = m.select("feature", t.alias("t_statistic"), dfw.alias("df"), F.col("m0").alias("mean_class_0"),
                 F.col("m1").alias("mean_class_1"), diff.alias("mean_difference"), eff.alias("effect_size"))
    r = with_t_sf2(r, ["feature"], F.col("t_statistic"), F.col("df"))
    d = len(features)
    return r.select(
        "feature", "t_statistic", "p_value", "mean_class_0", "mean_class_1", "mean_difference", "effect_size",
        (F.col("p_value") < alpha).alias("significant"),
        (F.col("p_value") < alpha / d).alias("bonferroni_significant"),
        F.when(F.col("p_value") > 0, -F.log10("p_value")).alias("neg_log_p"))


def anova_oneway(df: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """One-way ANOVA F and p of each numeric column across the levels of each
    categorical column (null levels and null values skipped).  Rows are expanded
    once per categorical column (like grouping sets) and reduced to
    (cat, level) moments with a partial aggregation."""
    long = df.select(F.inline(stack([(c, F.col(c).cast("string")) for c in cats], "categorical", "level")),
                     *[F.col(n).cast("double").alias(n) for n in nums])
    g = long.where(F.col("level").isNotNull()).groupBy("categorical", "level").agg(
        *[a for n in nums for a in (F.count(n).alias(f"n_{n}"), F.avg(n).alias(f"m_{n}"),
                                    F.var_samp(n).alias(f"v_{n}"))])
    per = g.select("categorical", "level", F.inline(F.array(*[
        F.struct(F.lit(n).alias("numeric"), F.col(f"n_{n}").alias("n"), F.col(f"m_{n}").alias("m"),
                 F.col(f"v_{n}").alias("v")) for n in nums])))
    per = per.where(F.col("n") > 0)
    tot = per.groupBy("categorical", "numeric").agg(
        F.sum("n").alias("ntot"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"),
        F.count(F.lit(1)).alias("k"))
    j = per.join(tot, ["categorical", "numeric"])
    s = j.groupBy("categorical", "numeric", "ntot", "k").agg(
        F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), 2)).alias("ssb"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("v"), F.lit(0.0))).alias("ssw"))
    s = s.where(F.col("k") > 1)
    fstat = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("ntot") - F.col("k")))
    r = s.select("categorical", "numeric", fstat.alias("f_statistic"), (F.col("k") - 1).alias("_d1"),
                 (F.col("ntot") - F.col("k")).alias("_d2"))
    r = with_f_sf(r, ["categorical", "numeric"], F.col("f_statistic"), F.col("_d1"), F.col("_d2"))
    return r.select("categorical", "numeric", "f_statistic", "p_value")


# ------------------------------------------------------------------------ t tests

def ttest_paired(df: DataFrame, a: str, b: str, comparison: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Paired t on a − b (ddof=1): means, t, p, significance and the verdict."""
    d = F.col(a).cast("double") - F.col(b).cast("double")
    one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(a).cast("double")).alias("original_mean"),
        F.avg(F.col(b).cast("double")).alias("method_mean"), F.avg(d).alias("md"), F.stddev_samp(d).alias("sd"))
    t = F.try_divide(F.col("md"), F.col("sd") / F.sqrt("n"))
    r = one.select(F.lit(comparison or f"{a}_vs_{b}").alias("comparison"), "original_mean", "method_mean",
                   (F.col("method_mean") - F.col("original_mean")).alias("mean_diff"), t.alias("t_statistic"),
                   (F.col("n") - 1).alias("dfree"))
    r = r.withColumn("p_value", t_sf2(F.col("t_statistic"), F.col("dfree")))
    sig = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    better = (F.when(sig & (F.col("method_mean") > F.col("original_mean")), F.lit(b))
              .when(sig & (F.col("original_mean") > F.col("method_mean")), F.lit(a))
              .otherwise(F.lit("no significant difference")))
    return r.select("comparison", "original_mean", "method_mean", "mean_diff", "t_statistic", "p_value",
                    sig.alias("significant"), better.alias("better_method"))


def ttest_1samp(df: DataFrame, col: str, mu) -> DataFrame:
    """One-sample t of ``col`` against ``mu`` (a number or a column of a one-row frame)."""
    x = F.col(col).cast("double")
    one = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    t = F.try_divide(F.col("mean") - F.lit(float(mu)), F.col("sd") / F.sqrt("n"))
    r = one.select("n", "mean", t.alias("t_statistic"))
    return r.withColumn("p_value", t_sf2(F.col("t_statistic"), F.col("n") - 1))


# ---------------------------------------------------------------------- bootstrap

def poisson_draw(mean: Column, u1: Column, u2: Column) -> Column:
    """A Poisson draw by the Cornish-Fisher expansion of its quantile at a normal
    deviate z (Box-Muller): mean + sd z + (z^2 - 1)/6 + (z - z^3)/(72 sd), rounded,
    0 at least.  The same expression at every mean, and in any SQL engine."""
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)
    sd = F.sqrt(mean)
    q = mean + sd * z + (z * z - 1) / 6.0 + (z - z * z * z) / (sd * 72.0)
    return F.when(mean <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.floor(q + 0.5).cast("double")))


def bootstrap_replicas(df: DataFrame, y: str = "y", yhat: str = "yhat", n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Accuracy of every Poisson-bootstrap replica: (replica, accuracy).

    A replica weighs each row by a Poisson(1) draw; a sum of n of those is
    Poisson(n), so rows collapse to the counts of right and wrong ones (one
    aggregation) and a replica draws twice, from md5(cell | seed | replica): the
    work is rows + replicas at every size."""
    n = df.agg(F.count(F.when(F.col(y) == F.col(yhat), 1)).alias("right"),
               F.count(F.when(F.col(y) != F.col(yhat), 1)).alias("wrong")).first()
    reps = df.sparkSession.range(n_boot).select(F.col("id").cast("int").alias("replica"))
    draw = lambda cell: poisson_draw(F.lit(float(n[cell])), hash_uniform(F.lit(f"{cell}:1"), seed, F.col("replica")),
                                     hash_uniform(F.lit(f"{cell}:2"), seed, F.col("replica")))
    t = reps.select("replica", draw("right").alias("_r"), draw("wrong").alias("_w"))
    return t.select("replica", safe_div(F.col("_r"), F.col("_r") + F.col("_w")).alias("accuracy"))


def bootstrap_ci(df: DataFrame, y: str = "y", yhat: str = "yhat", n_boot: int = 1000, seed: int = 42,
                 alpha: float = 0.05) -> DataFrame:
    """accuracy, percentile CI of replica accuracies, majority baseline, and the
    one-sample t of the replicas against the baseline."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("a")).first()
    acc = st["a"]
    reps = bootstrap_replicas(df, y, yhat, n_boot, seed)
    base = df.groupBy(F.col(y).alias("cls")).agg(F.count(F.lit(1)).alias("c")).agg(
        (F.max("c") / F.sum("c")).alias("baseline")).first()["baseline"]
    s = reps.agg(F.percentile("accuracy", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("ci"),
                 F.avg("accuracy").alias("m"), F.stddev_samp("accuracy").alias("sd"), F.count("accuracy").alias("n"))
    t = F.try_divide(F.col("m") - F.lit(base), F.col("sd") / F.sqrt("n"))
    out = s.select(F.lit(acc).alias("accuracy"), F.col("ci")[0].alias("accuracy_ci_lower"),
                   F.col("ci")[1].alias("accuracy_ci_upper"), F.lit(base).alias("baseline"),
                   t.alias("t_statistic_vs_baseline"), (F.col("n") - 1).alias("_df"))
    return out.withColumn("p_value_vs_baseline", t_sf2(F.col("t_statistic_vs_baseline"), F.col("_df"))).drop("_df")
