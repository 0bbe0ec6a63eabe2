"""Distributed ordered computations without a single-partition window.

``running_totals`` gives, for every row of a (possibly large) table, the
inclusive cumulative sums of some columns in the order of one key.  Rows are
split into ~``n_ranges`` value ranges with approximate equi-depth splits (the
splits only affect balance, never the result); per-range totals (a table of
at most ``n_ranges`` rows — a proven bound, broadcast) give each range its
offset; within a range an ordinary window partitioned by the range id runs in
parallel.

``hash_rank`` gives the exact 0-based rank of each row inside its group in a
seeded pseudo-random order (md5 of key|seed).  The hash is uniform, so the
rows of one group are split evenly over ``n_buckets`` hash ranges even when a
single group holds a third of all rows; bucket counts (groups × buckets rows)
give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform
from stratum.session import cut_lineage


def ranges(df: DataFrame, least: int = 64) -> int:
    """Number of ranges or buckets: as many as the session's shuffles have
    partitions (what a cluster sizes to its data), ``least`` at least."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _range_id(order_col: str, splits: list[float], descending: bool):
    c = F.col(order_col)
    arr = F.array(*[F.lit(float(s)) for s in splits])
    if descending:
        return F.size(F.filter(arr, lambda s: s > c))
    return F.size(F.filter(arr, lambda s: s < c))


def running_totals(df: DataFrame, order_col: str, sum_cols: list[str], descending: bool = False,
                   by: list[str] | None = None, n_ranges: int | None = None) -> DataFrame:
    """Adds ``cum_<c>`` (inclusive) for every c in sum_cols, ordered by order_col
    (ties must already be collapsed: one row per (by, order_col))."""
    by = by or []
    n_ranges = n_ranges or ranges(df, 256)
    probs = [i / n_ranges for i in range(1, n_ranges)]
    splits = df.agg(F.percentile_approx(F.col(order_col).cast("double"), probs, 10000).alias("s")).first()["s"] or []
    splits = sorted(set(float(s) for s in splits))
    rid = _range_id(order_col, splits, descending).alias("_rid")
    t = df.withColumn("_rid", rid)
    tot = t.groupBy(*by, "_rid").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    wpre = Window.partitionBy(*by).orderBy("_rid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*by, "_rid", *[F.coalesce(F.sum(f"_t_{c}").over(wpre), F.lit(0)).alias(f"_o_{c}")
                                    for c in sum_cols])
    # without groups the offset table has ≤ n_ranges rows: a proven broadcast bound;
    # with groups it has |groups| × n_ranges rows and AQE chooses the join at run time
    t = t.join(F.broadcast(off) if not by else off, [*by, "_rid"])
    o = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w = Window.partitionBy(*by, "_rid").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
    return t.select(*[c for c in t.columns if not c.startswith("_o_") and c != "_rid"],
                    *[(F.sum(c).over(w) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sum_cols])


def hash_rank(df: DataFrame, key: str, seed, group: list[str] | None = None, n_buckets: int | None = None,
              rank_col: str = "rank", draw: str = "order") -> DataFrame:
    """Exact 0-based rank inside ``group`` in order of (hash_uniform(key, seed), key)."""
    group = group or []
    n_buckets = n_buckets or ranges(df)
    u = hash_uniform(key, seed, draw)
    t = df.withColumn("_u", u).withColumn("_hb", F.least(F.floor(F.col("_u") * n_buckets), F.lit(n_buckets - 1)))
    cnt = t.groupBy(*group, "_hb").agg(F.count(F.lit(1)).alias("_c"))
    wpre = Window.partitionBy(*group).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    # groups × n_buckets rows; no broadcast hint: AQE knows the size when it runs
    off = cnt.select(*group, "_hb", F.coalesce(F.sum("_c").over(wpre), F.lit(0)).alias("_off"))
    t = t.join(off if group else F.broadcast(off), [*group, "_hb"])
    w = Window.partitionBy(*group, "_hb").orderBy("_u", key)
    return t.withColumn(rank_col, (F.row_number().over(w) - 1 + F.col("_off")).cast("bigint")).drop("_u", "_hb", "_off")


def distinct_rank(df: DataFrame, col: str) -> DataFrame:
    """(level, rank): 0-based ranks of the distinct non-null values in their order.

    Distinct values are dealt to value ranges, fixed by a checkpoint; totals per
    range (one row each) give the offsets, so any number of levels is ranked."""
    n = ranges(df)
    t = cut_lineage(df.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct()
                    .repartitionByRange(n, "level").withColumn("_r", F.spark_partition_id()))
    tot = t.groupBy("_r").agg(F.count(F.lit(1)).alias("_c"))  # at most n rows
    ahead = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_r", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("_r").orderBy("level")
    return t.join(F.broadcast(off), "_r").select("level", (F.row_number().over(inside) - 1 + F.col("_o")).cast("int").alias("rank"))
