"""C. Cleaning: duplicates, nulls, imputation, capping and filters.

Fit-style operators compute all their parameters in ONE aggregation over the
data (one job), collect that single parameter row, and apply them as literal
expressions in a single projection — no per-column jobs, no joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.exprs import INF, categorical_columns, numeric_columns


def _fit(df: DataFrame, aggs) -> dict:
    return df.agg(*aggs).first().asDict()


def drop_duplicates(df: DataFrame, exclude: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Whole-row distinct over the non-key columns (hash aggregate, partial + final)."""
    return df.drop(*[c for c in exclude if c in df.columns]).dropDuplicates()


def drop_na(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=subset)


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """Text → double; unparsable values become NULL (``try_cast``, ANSI-safe)."""
    return df.select(*[F.col(c).cast("string").try_cast("double").alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def _medians(df: DataFrame, cols: list[str]) -> dict:
    from stratum.operators.quantiles import exact_quantiles

    q = exact_quantiles(df, cols, [0.5])
    return {c: (q[c][0] if q[c] else None) for c in cols}


def impute_policy(df: DataFrame, cols: list[str] | None = None, key: str = "row_id",
                  knn_limit: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Per numeric column: 0 < null share < ``knn_limit`` → mean (the single-column
    nearest-neighbour imputer degenerates to the column mean); share ≥ limit →
    median; no nulls → untouched.  Returns (imputed frame, policy table)."""
    cols = cols or numeric_columns(df, exclude=(key,))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"k{i}"), F.avg(F.col(c).cast("double")).alias(f"m{i}")]
    p = _fit(df, aggs)
    n = p["_n"] or 1
    need_median = [c for i, c in enumerate(cols) if (n - p[f"k{i}"]) / n >= knn_limit]
    med = _medians(df, need_median) if need_median else {}
    for i, c in enumerate(cols):
        p[f"q{i}"] = med.get(c)
    policy, exprs = [], {}
    for i, c in enumerate(cols):
        share = (n - p[f"k{i}"]) / n
        if share == 0:
            continue
        how, val = ("mean", p[f"m{i}"]) if share < knn_limit else ("median", p[f"q{i}"])
        policy.append((c, float(share), how, None if val is None else float(val)))
        exprs[c] = F.coalesce(F.col(c).cast("double"), F.lit(val)).alias(c)
    out = df.select(*[exprs.get(c, F.col(c)) for c in df.columns])
    spark = df.sparkSession
    pol = spark.createDataFrame(policy, "column string, missing_share double, strategy string, fill_value double")
    return out, pol


def impute_mean(df: DataFrame, cols: list[str] | None = None, key: str = "row_id") -> DataFrame:
    cols = cols or numeric_columns(df, exclude=(key,))
    p = _fit(df, [F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    ex = {c: F.coalesce(F.col(c).cast("double"), F.lit(p[f"m{i}"])).alias(c) for i, c in enumerate(cols)}
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


def impute_mode(df: DataFrame, cols: list[str] | None = None, key: str = "row_id") -> DataFrame:
    """Categorical fill with the most frequent level; ties → smallest level."""
    cols = cols or categorical_columns(df, exclude=(key,))
    # levels are counted by group (a row per level, on any number of tasks), then the best is taken
    long = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])))
    n = long.where("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("i").agg(F.min(F.struct(-F.col("n"), "v")).alias("b")).select("i", F.col("b.v").alias("v"))
    p = {r["i"]: r["v"] for r in best.collect()}  # one row per column
    ex = {c: F.coalesce(F.col(c), F.lit(p.get(i))).alias(c) for i, c in enumerate(cols)}
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


def iqr_bounds(df: DataFrame, cols: list[str], k: float = 1.5, approx: bool = False) -> dict:
    from stratum.operators.quantiles import exact_quantiles

    if approx:
        p = _fit(df, [F.percentile_approx(F.col(c).cast("double"), [0.25, 0.75], 100000).alias(c) for c in cols])
    else:
        p = exact_quantiles(df, cols, [0.25, 0.75])
    out = {}
    for i, c in enumerate(cols):
        q = p[c]
        if q is None or q[0] is None:
            continue
        iqr = q[1] - q[0]
        out[c] = (q[0] - k * iqr, q[1] + k * iqr)
    return out


def clip_iqr(df: DataFrame, cols: list[str] | None = None, key: str = "row_id",
             approx: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cap every numeric column to [Q1 − 1.5·IQR, Q3 + 1.5·IQR]; NULL stays NULL.
    Returns (capped frame, report (column, lower, upper, n_outliers))."""
    cols = cols or numeric_columns(df, exclude=(key,))
    b = iqr_bounds(df, cols, approx=approx)
    ex = {}
    for c, (lo, hi) in b.items():
        x = F.col(c).cast("double")
        ex[c] = F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).alias(c)
    capped = df.select(*[ex.get(c, F.col(c)) for c in df.columns])
    counts = df.agg(*[F.sum(((F.col(c) < lo) | (F.col(c) > hi)).cast("long")).alias(c) for c, (lo, hi) in b.items()]) \
        if b else None
    rows = []
    if counts is not None:
        r = counts.first().asDict()
        rows = [(c, float(lo), float(hi), int(r[c] or 0)) for c, (lo, hi) in b.items()]
    rep = df.sparkSession.createDataFrame(rows, "column string, lower double, upper double, n_outliers long")
    return capped, rep


def filter_zscore(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """Keep rows with |z| < threshold in every listed column (population std).
    Zero-variance columns are skipped (their z is undefined)."""
    p = _fit(df, [a for i, c in enumerate(cols)
                  for a in (F.avg(F.col(c).cast("double")).alias(f"m{i}"),
                            F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}"))])
    cond = F.lit(True)
    for i, c in enumerate(cols):
        m, s = p[f"m{i}"], p[f"s{i}"]
        if s is None or s == 0:
            continue
        z = F.abs((F.col(c).cast("double") - F.lit(m)) / F.lit(s))
        cond = cond & F.coalesce(z < F.lit(threshold), F.lit(False))
    return df.where(cond)


def null_out_inf(df: DataFrame, cols: list[str], pairwise: bool = True) -> DataFrame:
    """±inf and NaN → NULL, then (optionally) keep rows complete in ``cols``."""
    ex = {}
    for c in cols:
        x = F.col(c).cast("double")
        ex[c] = F.when(F.isnan(x) | (F.abs(x) == F.lit(INF)), F.lit(None).cast("double")).otherwise(x).alias(c)
    out = df.select(*[ex.get(c, F.col(c)) for c in df.columns])
    return out.na.drop("any", subset=cols) if pairwise else out


def align_on_index(a: DataFrame, b: DataFrame, key: str = "row_id", how: str = "inner") -> DataFrame:
    """Pair two differently filtered frames of the same table by key (equi-join;
    both sides hash-partitioned on the key, or one broadcast by AQE when small)."""
    return a.join(b, key, how)


def dedup_keep_first(df: DataFrame, key: str = "row_id") -> DataFrame:
    """Whole-row distinct over the non-key columns keeping the smallest key
    (deterministic, unlike an arbitrary surviving row); one hash aggregation."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(*rest).agg(F.min(key).alias(key)).select(*df.columns)


def clean_data(df: DataFrame, key: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """dedup → numeric imputation policy → categorical mode → IQR capping (every
    numeric column, the target included, as in the reference)."""
    d = dedup_keep_first(df, key)
    d, _ = impute_policy(d, key=key)
    cats = categorical_columns(d, exclude=(key,))
    if cats:
        d = impute_mode(d, cats, key=key)
    return clip_iqr(d, key=key)
