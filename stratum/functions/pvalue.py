"""Upper-tail probabilities of the F and t distributions as native expressions.

Spark SQL has no incomplete-beta function.  With x = sin²φ the F survival
function becomes a ratio of two integrals of cos^(d2-1)φ · sin^(d1-1)φ:

    P(F > f) = ∫_{φ0}^{π/2} g(φ) dφ / ∫_0^{π/2} g(φ) dφ,  φ0 = atan(sqrt(d1 f / d2))

evaluated with composite Simpson on ``N`` intervals through the
``aggregate(sequence(...))`` higher-order function.  For large d2 the
integrand vanishes far before π/2, so the upper limit is capped at
(sqrt(d1) + 40) / sqrt(d2) (the neglected mass is below exp(-800)).  The
cost is per *result* row (a feature or a group), never per data row.
The identical formula is emitted as DuckDB SQL for the oracle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

N_INTERVALS = 4000


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(float(x))


def _simpson(a: Column, b: Column, d1: Column, d2: Column, n: int) -> Column:
    h = (b - a) / F.lit(float(n))

    def step(acc, i):
        w = F.when((i == 0) | (i == n), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
        phi = a + i.cast("double") * h
        return acc + w * F.pow(F.cos(phi), d2 - 1.0) * F.pow(F.sin(phi), d1 - 1.0)

    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), F.lit(0.0), step) * h / F.lit(3.0)


def f_sf(f, d1, d2, n: int = N_INTERVALS) -> Column:
    """P(F(d1, d2) > f); NULL when an input is NULL or d2 <= 0 / d1 <= 0."""
    f, d1, d2 = _c(f).cast("double"), _c(d1).cast("double"), _c(d2).cast("double")
    phi0 = F.atan(F.sqrt(F.try_divide(d1 * f, d2)))
    cap = F.least(F.lit(math.pi / 2), F.try_divide(F.sqrt(d1) + F.lit(40.0), F.sqrt(d2)))
    num = _simpson(phi0, cap, d1, d2, n)
    den = _simpson(F.lit(0.0), cap, d1, d2, n)
    valid = f.isNotNull() & d1.isNotNull() & d2.isNotNull() & (d1 > 0) & (d2 > 0) & ~F.isnan(f)
    return (F.when(~valid, F.lit(None).cast("double"))
            .when(phi0 >= cap, F.lit(0.0))
            .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), num / den))))


def t_sf2(t, df, n: int = N_INTERVALS) -> Column:
    """Two-sided p-value of a t statistic: P(|T_df| > |t|) = P(F(1, df) > t²)."""
    t = _c(t).cast("double")
    return f_sf(t * t, F.lit(1.0), df, n)


# ---------------------------------------------------------------- DuckDB text

def _simpson_sql(a: str, b: str, d1: str, d2: str, n: int) -> str:
    # A correlated subquery over range() (DuckDB decorrelates it into a join);
    # list lambdas capturing outer columns are avoided on purpose.
    h = f"((({b}) - ({a})) / {float(n)})"
    return (f"((SELECT sum((CASE WHEN g.i = 0 OR g.i = {n} THEN 1.0 WHEN g.i % 2 = 1 THEN 4.0 ELSE 2.0 END) * "
            f"pow(cos(({a}) + g.i * {h}), ({d2}) - 1.0) * pow(sin(({a}) + g.i * {h}), ({d1}) - 1.0)) "
            f"FROM range(0, {n + 1}) AS g(i)) * {h} / 3.0)")


def f_sf_sql(f: str, d1: str, d2: str, n: int = N_INTERVALS) -> str:
    f, d1, d2 = f"CAST({f} AS DOUBLE)", f"CAST({d1} AS DOUBLE)", f"CAST({d2} AS DOUBLE)"
    phi0 = f"atan(sqrt(({d1}) * ({f}) / nullif({d2}, 0)))"
    cap = f"least(pi() / 2, (sqrt({d1}) + 40.0) / sqrt(nullif({d2}, 0)))"
    num = _simpson_sql(phi0, cap, d1, d2, n)
    den = _simpson_sql("0.0", cap, d1, d2, n)
    return (f"(CASE WHEN {f} IS NULL OR {d1} IS NULL OR {d2} IS NULL OR {d1} <= 0 OR {d2} <= 0 OR isnan({f}) "
            f"THEN NULL WHEN {phi0} >= {cap} THEN 0.0 "
            f"ELSE least(1.0, greatest(0.0, {num} / {den})) END)")


def t_sf2_sql(t: str, df: str, n: int = N_INTERVALS) -> str:
    return f_sf_sql(f"(({t}) * ({t}))", "1.0", df, n)


def with_f_sf(df, keys: list[str], f, d1, d2, out: str = "p_value", n: int = N_INTERVALS):
    """DataFrame form of ``f_sf`` for result tables with many rows: each row is
    exploded into its Simpson nodes (one node when no integral is needed),
    weighted terms are computed in one codegen'd projection and summed per key;
    the row's other columns ride along (``first``), so the input is evaluated
    once and never joined back.  ``keys`` must identify the rows of ``df``."""
    cols = [c for c in df.columns if c not in keys]
    fc, d1c, d2c = _c(f).cast("double"), _c(d1).cast("double"), _c(d2).cast("double")
    g = df.select("*", fc.alias("__pk_f"), d1c.alias("__pk_d1"), d2c.alias("__pk_d2"))
    phi0 = F.atan(F.sqrt(F.try_divide(F.col("__pk_d1") * F.col("__pk_f"), F.col("__pk_d2"))))
    cap = F.least(F.lit(math.pi / 2), F.try_divide(F.sqrt("__pk_d1") + F.lit(40.0), F.sqrt("__pk_d2")))
    ok = (F.col("__pk_f").isNotNull() & F.col("__pk_d1").isNotNull() & F.col("__pk_d2").isNotNull() & (F.col("__pk_d1") > 0)
          & (F.col("__pk_d2") > 0) & ~F.isnan("__pk_f"))
    g = g.select("*", ok.alias("__pk_ok"), phi0.alias("__pk_a"), cap.alias("__pk_cap"))
    live = F.coalesce(F.col("__pk_ok") & (F.col("__pk_a") < F.col("__pk_cap")), F.lit(False))
    nodes = F.when(live, F.sequence(F.lit(0), F.lit(n))).otherwise(F.array(F.lit(0)))
    e = g.select("*", F.explode(nodes).alias("__pk_i"))
    i = F.col("__pk_i")
    w = F.when((i == 0) | (i == n), F.lit(1.0)).when(i % 2 == 1, F.lit(4.0)).otherwise(F.lit(2.0))
    hn = (F.col("__pk_cap") - F.col("__pk_a")) / F.lit(float(n))
    hd = F.col("__pk_cap") / F.lit(float(n))
    pn = F.col("__pk_a") + i.cast("double") * hn
    pd = i.cast("double") * hd
    tn = w * F.pow(F.cos(pn), F.col("__pk_d2") - 1.0) * F.pow(F.sin(pn), F.col("__pk_d1") - 1.0)
    td = w * F.pow(F.cos(pd), F.col("__pk_d2") - 1.0) * F.pow(F.sin(pd), F.col("__pk_d1") - 1.0)
    s = e.groupBy(*keys).agg(*[F.first(c).alias(c) for c in cols],
                             F.first("__pk_ok").alias("__pk_ok"), F.first("__pk_a").alias("__pk_a"), F.first("__pk_cap").alias("__pk_cap"),
                             (F.sum(tn) * F.first(hn) / (F.sum(td) * F.first(hd))).alias("__pk_p"))
    p = (F.when(~F.coalesce(F.col("__pk_ok"), F.lit(False)), F.lit(None).cast("double"))
         .when(F.col("__pk_a") >= F.col("__pk_cap"), F.lit(0.0))
         .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__pk_p")))))
    return s.select(*keys, *cols, p.alias(out))


def with_t_sf2(df, keys: list[str], t, dfree, out: str = "p_value", n: int = N_INTERVALS):
    tc = _c(t).cast("double")
    return with_f_sf(df, keys, tc * tc, F.lit(1.0), dfree, out, n)
