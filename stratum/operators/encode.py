"""D. Encoders and targets.

Label and frequency encoding join a grouped level table (any number of levels;
AQE broadcasts a small one and splits a hot level).  Where levels become columns
(one-hot) or literals (adaptive), the fit is one aggregation whose level lists
are bounded by ``max_levels``, checked by sketch before they are collected.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.exprs import categorical_columns, numeric_columns
from stratum.operators.form import ORDINAL_MAPS, SCALE_0_5

MAX_LEVELS = 10000


def _lit_map(d: dict) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in d.items()))


def fit_levels(df: DataFrame, cols: list[str], max_levels: int = MAX_LEVELS) -> dict[str, list]:
    """Sorted distinct non-null levels per column; refuses unbounded columns (by a
    mergeable sketch, with room for its error, so no exact distinct runs first)."""
    nd = df.agg(*[F.approx_count_distinct(c, 0.02).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    too_many = [c for i, c in enumerate(cols) if nd[f"d{i}"] > 1.1 * max_levels]
    if too_many:
        raise ValueError(f"columns {too_many} exceed {max_levels} levels; use frequency_encode")
    row = df.agg(*[F.sort_array(F.collect_set(c)).alias(f"l{i}") for i, c in enumerate(cols)]).first()
    return {c: list(row[f"l{i}"]) for i, c in enumerate(cols)}


def _by_level(df: DataFrame, codes: dict[str, DataFrame]) -> DataFrame:
    """Replace each column by its code, from (level, code) tables of distinct levels."""
    t = df
    for i, (c, table) in enumerate(codes.items()):
        lv = table.select(F.col(table.columns[0]).alias(f"_l{i}"), F.col(table.columns[1]).alias(f"_e{i}"))
        t = t.join(lv, F.col(c) == F.col(f"_l{i}"), "left")
    at = {c: F.col(f"_e{i}").alias(c) for i, c in enumerate(codes)}
    return t.select(*[at.get(c, F.col(c)) for c in df.columns])


def label_encode(df: DataFrame, cols: list[str] | None = None, key: str = "row_id") -> DataFrame:
    """level → 0-based rank among the sorted distinct levels, however many."""
    from stratum.operators.windows import distinct_rank

    cols = cols or categorical_columns(df, exclude=(key,))
    return _by_level(df, {c: distinct_rank(df, c) for c in cols})


def ordinal_map(df: DataFrame, maps: dict[str, dict] | None = None) -> DataFrame:
    """Fixed ordinal maps; an unmapped value becomes NULL."""
    maps = maps or ORDINAL_MAPS
    ex = {c: F.try_element_at(_lit_map(m), F.col(c)).alias(c) for c, m in maps.items() if c in df.columns}
    return df.select(*[ex.get(c, F.col(c)) for c in df.columns])


def frequency_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """level → relative frequency among non-null values."""
    n = df.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    return _by_level(df, {c: df.where(F.col(c).isNotNull()).groupBy(c).agg((F.count(F.lit(1)) / F.lit(float(n[i] or 1))).alias("f"))
                          for i, c in enumerate(cols)})


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = False, levels: dict[str, list] | None = None,
            keep_source: bool = False) -> DataFrame:
    """``{col}_{level}`` 0/1 columns over sorted levels (stored ``levels`` make a
    scoring frame produce the training columns); NULL → all zeros."""
    levels = levels or fit_levels(df, cols)
    new = []
    for c in cols:
        lv = levels[c][1:] if drop_first else levels[c]
        new += [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in lv]
    base = [F.col(c) for c in df.columns if keep_source or c not in cols]
    return df.select(*base, *new)


def adaptive_encode(df: DataFrame, cols: list[str] | None = None, key: str = "row_id") -> DataFrame:
    """2 levels → 0/1 by first appearance (smaller min(key) → 0); ≤ 5 levels →
    sorted ordinal; more → one-hot with the first sorted level dropped."""
    cols = cols or categorical_columns(df, exclude=(key,))
    lv = fit_levels(df, cols)
    two = [c for c in cols if len(lv[c]) == 2]
    first = {}
    if two:
        r = df.agg(*[F.min_by(F.col(c), F.col(key)).alias(f"f{i}") for i, c in enumerate(two)]).first()
        first = {c: r[f"f{i}"] for i, c in enumerate(two)}
    ex, hot = {}, []
    for c in cols:
        levels = lv[c]
        if len(levels) == 2:
            a = first[c]
            b = [v for v in levels if v != a][0]
            ex[c] = F.try_element_at(_lit_map({a: 0, b: 1}), F.col(c)).alias(c)
        elif len(levels) <= 5:
            ex[c] = F.try_element_at(_lit_map({v: i for i, v in enumerate(levels)}), F.col(c)).alias(c)
        else:
            hot.append(c)
    base = [ex.get(c, F.col(c)) for c in df.columns if c not in hot]
    dummies = [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}") for c in hot
               for v in lv[c][1:]]
    return df.select(*base, *dummies)


def binarize_target(df: DataFrame, col: str, mode: str = "split3", out: str = "target") -> DataFrame:
    """split3: value ≥ 3 → 1 (the {0,1,2}/{3,4,5} replace map); threshold: ≥ 3 unless
    max ≤ 1 (then unchanged); median: > median when more than 2 levels, else unchanged."""
    x = F.col(col)
    if mode == "split3":
        return df.withColumn(out, F.when(x.isNull(), None).otherwise((x >= 3).cast("int")))
    if mode == "threshold":
        mx = df.agg(F.max(x)).first()[0]
        return df.withColumn(out, x.cast("int") if mx is not None and mx <= 1 else (x >= 3).cast("int"))
    if mode == "median":
        from stratum.operators.quantiles import exact_quantiles

        # "more than 2 levels?" needs at most 3 distinct values back (distributed distinct + limit)
        if df.select(x).where(x.isNotNull()).distinct().limit(3).count() > 2:
            m = exact_quantiles(df, [col], [0.5])[col][0]
            return df.withColumn(out, F.coalesce((x > F.lit(m)).cast("int"), F.lit(0)))
        return df.withColumn(out, x.cast("int"))
    raise ValueError(mode)


def derived_target(df: DataFrame, cols: list[str] | None = None, key: str = "row_id", out: str = "target") -> DataFrame:
    """Row mean of the first ≤ 4 numeric columns (nulls skipped) > median of the row means."""
    cols = (cols or numeric_columns(df, exclude=(key,)))[:4]
    vals = [F.col(c).cast("double") for c in cols]
    s = sum((F.coalesce(v, F.lit(0.0)) for v in vals), F.lit(0.0))
    k = sum((v.isNotNull().cast("int") for v in vals), F.lit(0))
    rm = F.try_divide(s, k.cast("double"))
    from stratum.operators.quantiles import exact_quantiles

    t = df.withColumn("_rm", rm)
    med = exact_quantiles(t, ["_rm"], [0.5])["_rm"][0]
    return t.withColumn(out, F.coalesce((F.col("_rm") > F.lit(med)).cast("int"), F.lit(0))).drop("_rm")


def scaled_answer(c) -> Column:
    """'3 (Moderate)' → 3 via the fixed answer map; unknown or missing → 0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.try_element_at(_lit_map({v: i for i, v in enumerate(SCALE_0_5)}), c), F.lit(0))


def leading_int(c) -> Column:
    """The first run without whitespace as an integer ('3 (Moderate)' → 3); else NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^\s*(\S+)", 1).try_cast("int")
