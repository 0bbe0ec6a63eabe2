"""B. Profiling, counting and distribution tables.

Each profile is ONE wide aggregation over the scan (no per-column jobs) and is
unpivoted afterwards with ``inline`` on the one-row result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.exprs import categorical_columns, numeric_columns, safe_div, stack


def _quantiles(c, probs, approx: bool, accuracy: int = 100000):
    x = F.col(c).cast("double")
    if approx:
        return F.percentile_approx(x, list(probs), accuracy)
    return F.percentile(x, F.array(*[F.lit(float(p)) for p in probs]))


def missing_profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_missing, missing_share) for columns with at least one null."""
    cols = cols or df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"_m{i}") for i, c in enumerate(cols)])
    long = agg.select("_n", F.inline(stack([(c, F.col(f"_m{i}")) for i, c in enumerate(cols)], "column", "n_missing")))
    return long.where("n_missing > 0").select("column", "n_missing", safe_div("n_missing", "_n").alias("missing_share"))


def describe(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """count, mean, std (ddof=1), min, q25, q50, q75, max per numeric column.

    Moments come from one aggregation (the mean of whole numbers and of values with
    up to six decimals is an exact decimal sum, as a double, by the count, so that it does
    not depend on the order of addition); quartiles are exact (linear
    interpolation) via ``exact_quantiles`` — distributed selection, never a
    single task holding a column's distinct values — or approximate sketches
    with ``approx=True``.  The result has one row per column."""
    from stratum.operators.quantiles import exact_quantiles

    cols = cols or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        exact = x.try_cast("decimal(38,6)")
        mean = F.when(F.count_if(exact.isNull() & x.isNotNull() | (exact.cast("double") != x)) == 0,
                      F.try_sum(exact).cast("double") / F.count(x))
        aggs += [F.count(x).alias(f"n{i}"), F.coalesce(mean, F.avg(x)).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]
        if approx:
            aggs.append(_quantiles(c, (0.25, 0.5, 0.75), True).alias(f"q{i}"))
    r = df.agg(*aggs).first()
    q = {c: r[f"q{i}"] for i, c in enumerate(cols)} if approx else exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, r[f"n{i}"], r[f"m{i}"], r[f"s{i}"], r[f"lo{i}"], *(q[c] or [None] * 3), r[f"hi{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "column string, count long, mean double, std double, min double, "
                                                 "q25 double, q50 double, q75 double, max double")


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, count); nulls excluded like pandas."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def value_counts_norm(df: DataFrame, col: str) -> DataFrame:
    """(value, count, share).  The total is a fitted scalar (one pruned
    count), so no join and no single-partition window is needed."""
    tot = _scalars(df, F.count(F.col(col)).alias("t"))["t"]
    vc = value_counts(df, col)
    return vc.select("value", "count", (F.col("count") / F.lit(float(tot or 1))).alias("share"))


def cardinality(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """(column, n_distinct, kind) with kind constant | binary | multilevel."""
    cols = cols or df.columns
    fn = (lambda c: F.approx_count_distinct(c, 0.01)) if approx else (lambda c: F.count_distinct(c))
    one = df.agg(*[fn(c).alias(f"d{i}") for i, c in enumerate(cols)])
    long = one.select(F.inline(stack([(c, F.col(f"d{i}").cast("bigint")) for i, c in enumerate(cols)],
                                     "column", "n_distinct")))
    kind = (F.when(F.col("n_distinct") <= 1, "constant").when(F.col("n_distinct") == 2, "binary")
            .otherwise("multilevel"))
    return long.withColumn("kind", kind)


def select_by_role(df: DataFrame, role: str = "numeric", keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Plan-time projection by schema role (numeric | categorical)."""
    cols = numeric_columns(df, exclude=keep) if role == "numeric" else categorical_columns(df, exclude=keep)
    return df.select(*[k for k in keep if k in df.columns], *cols)


def head_sample(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows in key order (TakeOrderedAndProject, no global sort)."""
    return df.orderBy(key).limit(n)


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """n0, n1 and ratio n0/n1 (inf when n1 = 0)."""
    y = F.col(label)
    one = df.agg(F.sum((y == 0).cast("long")).alias("n0"), F.sum((y == 1).cast("long")).alias("n1"))
    ratio = F.when(F.col("n1") == 0, F.lit(math.inf)).otherwise(F.col("n0") / F.col("n1"))
    return one.select(F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"),
                      ratio.alias("ratio"))


def _scalars(df: DataFrame, *aggs) -> dict:
    """Fit step: one bounded parameter row to the driver."""
    return df.agg(*aggs).first().asDict()


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Fixed-width bins over [min, max], last bin closed; empty bins kept."""
    x = F.col(col).cast("double")
    p = _scalars(df, F.min(x).alias("mn"), F.max(x).alias("mx"))
    mn, mx = p["mn"], p["mx"]
    spark = df.sparkSession
    if mn is None:
        return spark.range(0).select(F.col("id").cast("int").alias("bin"), F.lit(0.0).alias("lo"),
                                     F.lit(0.0).alias("hi"), F.lit(0).cast("bigint").alias("count"))
    w = (mx - mn) / bins
    b = F.lit(0) if w == 0 else F.least(F.floor((x - F.lit(mn)) / F.lit(w)), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    # the bin table is fixed at `bins` rows
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(F.broadcast(counts), "bin", "left")
    return out.select("bin", (F.lit(mn) + F.col("bin") * F.lit(w)).alias("lo"),
                      (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
                      F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


def kde_grid(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, prebin: int = 4096) -> DataFrame:
    """Gaussian KDE on a ``grid``-point grid spanning [min - cut·bw, max + cut·bw],
    Scott bandwidth std·n^(-1/5) of the values themselves.  By definition each value
    stands at the centre of its bin among equal widths of [min, max]: ``prebin`` of them,
    or as many as make a bin bw/16 wide at most (off by bw/32).  Only occupied bins become
    rows, of fewer than 23·n^0.7 (the range is under sqrt(2n)·std); rows meet only in the
    partial count per bin."""
    x = F.col(col).cast("double")
    p = _scalars(df, F.count(x).alias("n"), F.stddev_samp(x).alias("sd"), F.min(x).alias("mn"), F.max(x).alias("mx"))
    n, sd, mn, mx = p["n"], p["sd"], p["mn"], p["mx"]
    if not n or sd is None or sd == 0:
        return df.sparkSession.range(0).select(F.col("id").cast("int").alias("point"), F.lit(0.0).alias("x"),
                                               F.lit(0.0).alias("density"))
    bw = sd * n ** (-0.2)
    lo, hi = mn - cut * bw, mx + cut * bw
    step = (hi - lo) / (grid - 1)
    v = x
    if mx > mn:
        bins = max(prebin, math.ceil((mx - mn) / bw * 16))
        bw_bin = (mx - mn) / bins
        v = F.lit(mn) + (F.least(F.floor((x - F.lit(mn)) / F.lit(bw_bin)), F.lit(bins - 1)) + 0.5) * F.lit(bw_bin)
    distinct = df.where(x.isNotNull()).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    g = F.col("point").cast("double") * F.lit(step) + F.lit(lo)
    contrib = (distinct.select("v", "c", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point"))
               .select("point", (F.col("c") * F.exp(F.lit(-0.5) * F.pow((g - F.col("v")) / F.lit(bw), 2))).alias("k")))
    dens = contrib.groupBy("point").agg(F.sum("k").alias("s"))
    norm = 1.0 / (n * bw * math.sqrt(2 * math.pi))
    return dens.select("point", (F.col("point").cast("double") * F.lit(step) + F.lit(lo)).alias("x"),
                       (F.col("s") * F.lit(norm)).alias("density"))


def category_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, level, count) for every categorical column in one pass."""
    cols = cols or categorical_columns(df, exclude=("row_id",))
    long = df.select(F.inline(stack([(c, F.col(c).cast("string")) for c in cols], "column", "level")))
    return long.where(F.col("level").isNotNull()).groupBy("column", "level").agg(F.count(F.lit(1)).alias("count"))


def box_stats(df: DataFrame, group: str, value: str, approx: bool = False) -> DataFrame:
    """Per group: q1, median, q3, whiskers (extreme data inside 1.5·IQR) and the
    number of points beyond them.  Quartiles are exact per group without a
    per-group task (``grouped_exact_quantiles``), or sketches with ``approx``."""
    from stratum.operators.quantiles import grouped_exact_quantiles

    x = F.col(value).cast("double")
    if approx:
        q = (df.where(x.isNotNull()).groupBy(group)
             .agg(_quantiles(value, (0.25, 0.5, 0.75), True).alias("_q"))
             .select(group, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")))
    else:
        q = grouped_exact_quantiles(df, group, value, [0.25, 0.5, 0.75]).select(
            group, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    # rows meet their group's quartiles as counts per (group, value): a hot group is combined map-side first
    counts = df.where(x.isNotNull()).groupBy(group, x.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    j = counts.join(q, group)
    inside = (F.col("_v") >= lo) & (F.col("_v") <= hi)
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("_v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_c"))), F.lit(0)).alias("n_outliers"))
