"""Exact quantiles (linear interpolation, as pandas / DuckDB ``quantile_cont``)
without holding a column's distinct values in one task.

Spark's exact ``percentile`` keeps a value→count map that is merged in a single
task: fine for few distinct values, fatal for 10¹¹.  ``exact_quantiles`` takes
one path at every size:

1. one aggregation for all columns counts values and brackets every needed rank
   with ``percentile_approx`` (GK sketch, mergeable);
2. one aggregation counts rows below / inside each bracket; a bracket with one
   distinct value is done, a missed one is widened;
3. brackets of up to ``small`` rows are sorted inside the aggregation and the
   rank is read off there; larger ones are histogrammed into ``bins`` equal
   widths (targets × bins cells) and narrowed to the bin of their rank, until
   none is left.

Only bracket statistics and histograms reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _interp(lo_v, hi_v, pos):
    lo = math.floor(pos)
    if hi_v == lo_v or pos == lo:
        return float(lo_v)
    return float((math.ceil(pos) - pos) * lo_v + (pos - lo) * hi_v)


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], accuracy: int = 10000, bins: int = 1024,
                    small: int = 10_000) -> dict[str, list[float | None]]:
    """{column: [quantile for each prob]} (None for an all-null column)."""
    x = {c: F.col(c).cast("double") for c in cols}
    around = [q for p in probs for q in (max(0.0, p - 3.0 / accuracy), min(1.0, p + 3.0 / accuracy))]
    head = df.agg(*[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(cols)],
                  *[F.percentile_approx(x[c], around, accuracy).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    n_of = {c: head[f"n{i}"] for i, c in enumerate(cols)}
    # (column, rank) pairs that the interpolation needs, each with its bracket
    bracket: dict[tuple, list[float]] = {}
    for i, c in enumerate(cols):
        for j, p in enumerate(probs):
            pos = (n_of[c] - 1) * p
            for rank in {math.floor(pos), math.ceil(pos)} if n_of[c] else ():
                bracket.setdefault((c, rank), [float(v) for v in head[f"a{i}"][2 * j:2 * j + 2]])
    value: dict[tuple, float] = {}
    while open_t := [t for t in bracket if t not in value]:
        inside = {t: (x[t[0]] >= F.lit(bracket[t][0])) & (x[t[0]] <= F.lit(bracket[t][1])) for t in open_t}
        aggs = []
        for k, t in enumerate(open_t):
            v = x[t[0]]
            aggs += [F.count(F.when(v < F.lit(bracket[t][0]), 1)).alias(f"b{k}"), F.count(F.when(inside[t], 1)).alias(f"i{k}"),
                     F.min(F.when(inside[t], v)).alias(f"mn{k}"), F.max(F.when(inside[t], v)).alias(f"mx{k}")]
        st = df.agg(*aggs).first()
        few, many = [], []
        for k, t in enumerate(open_t):
            below, count, mn, mx = st[f"b{k}"], st[f"i{k}"], st[f"mn{k}"], st[f"mx{k}"]
            if below > t[1]:                       # bracket too high: widen down
                bracket[t][0] = -math.inf
            elif below + count <= t[1]:            # bracket too low: widen up
                bracket[t][1] = math.inf
            elif mn == mx:
                value[t] = float(mn)
            elif count <= small:
                few.append((k, t, below))
            else:
                many.append((k, t, below, mn, mx))
        if few:
            got = df.agg(*[F.element_at(F.sort_array(F.collect_list(F.when(inside[t], x[t[0]]))), int(t[1] - below + 1)).alias(f"v{k}")
                           for k, t, below in few]).first()
            value.update({t: float(got[f"v{k}"]) for k, t, _ in few})
        if many:
            cells = []
            for k, t, _, mn, mx in many:
                b = F.least(F.floor((x[t[0]] - F.lit(mn)) / F.lit((mx - mn) / bins)), F.lit(bins - 1)).cast("int")
                cells.append(F.when((x[t[0]] >= F.lit(mn)) & (x[t[0]] <= F.lit(mx)), F.struct(F.lit(k).alias("t"), b.alias("bin"))))
            counts: dict[int, dict[int, int]] = {}
            for r in (df.select(F.explode(F.filter(F.array(*cells), lambda s: s.isNotNull())).alias("s"))
                      .groupBy("s.t", "s.bin").agg(F.count(F.lit(1)).alias("c")).collect()):  # at most targets × bins rows
                counts.setdefault(r["t"], {})[r["bin"]] = r["c"]
            for k, t, below, mn, mx in many:
                width, acc = (mx - mn) / bins, below
                for bi in range(bins):
                    here = counts.get(k, {}).get(bi, 0)
                    if acc + here > t[1]:
                        # float edges: keep the bracket closed and slightly generous
                        bracket[t] = [max(mn, math.nextafter(mn + bi * width, -math.inf)),
                                      mx if bi == bins - 1 else min(mx, math.nextafter(mn + (bi + 1) * width, math.inf))]
                        break
                    acc += here
    out: dict[str, list] = {}
    for c in cols:
        pos = [(n_of[c] - 1) * p for p in probs]
        out[c] = [_interp(value[(c, math.floor(q))], value[(c, math.ceil(q))], q) if n_of[c] else None for q in pos]
    return out


def grouped_exact_quantiles(df: DataFrame, group: str, value: str, probs: list[float],
                            n_ranges: int | None = None) -> DataFrame:
    """(group, q0, q1, …) exact per-group quantiles without a per-group task.

    Rows collapse to (group, value, count) with a partial aggregation (a hot
    value costs one row); running counts per group come from
    ``running_totals`` (value ranges split a hot group over many tasks); the
    value covering rank r is the one with cum − count ≤ r < cum.  Only the
    ≤ 2·len(probs) covering rows per group are aggregated at the end."""
    from stratum.operators.windows import running_totals

    x = F.col(value).cast("double")
    g = df.where(x.isNotNull() & F.col(group).isNotNull()).groupBy(group, x.alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    c = running_totals(g, "_v", ["_c"], by=[group], n_ranges=n_ranges)
    n = c.groupBy(group).agg(F.max("cum__c").alias("_n"))
    c = c.join(n, group)
    lo_prev = F.col("cum__c") - F.col("_c")
    aggs = []
    for k, p in enumerate(probs):
        pos = (F.col("_n") - 1) * F.lit(float(p))
        rlo, rhi = F.floor(pos), F.ceil(pos)
        cov = lambda r: (lo_prev <= r) & (r < F.col("cum__c"))
        aggs += [F.max(F.when(cov(rlo), F.col("_v"))).alias(f"_lo{k}"), F.max(F.when(cov(rhi), F.col("_v"))).alias(f"_hi{k}"),
                 F.first(pos).alias(f"_pos{k}")]
    cond = F.lit(False)
    for p in probs:
        pos = (F.col("_n") - 1) * F.lit(float(p))
        for r in (F.floor(pos), F.ceil(pos)):
            cond = cond | ((lo_prev <= r) & (r < F.col("cum__c")))
    s = c.where(cond).groupBy(group).agg(*aggs)
    outs = []
    for k, _ in enumerate(probs):
        lo_v, hi_v, pos = F.col(f"_lo{k}"), F.col(f"_hi{k}"), F.col(f"_pos{k}")
        q = F.when((lo_v == hi_v) | (pos == F.floor(pos)), lo_v).otherwise(
            (F.ceil(pos) - pos) * lo_v + (pos - F.floor(pos)) * hi_v)
        outs.append(q.alias(f"q{k}"))
    return s.select(group, *outs)
