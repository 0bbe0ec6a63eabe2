"""J. Grouped descriptive analytics (hash aggregation with map-side partial
aggregates; shares computed inside each key's partition)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def group_means(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(F.col(v).cast("double")).alias(f"mean_{v}") for v in values])


def group_distribution(df: DataFrame, key: str, level: str) -> DataFrame:
    """Share of each level inside each key: (key, level, count, share)."""
    g = df.where(F.col(key).isNotNull() & F.col(level).isNotNull()).groupBy(key, level).agg(
        F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy(key)
    return g.withColumn("share", F.col("count") / F.sum("count").over(w))


def filtered_group_means(df: DataFrame, value_text: str, threshold: float, keys: list[str],
                         target: str) -> DataFrame:
    """Coerce ``value_text`` to double (bad → null), drop nulls, keep value < threshold,
    then mean of ``target`` per key combination, sorted by keys."""
    v = F.col(value_text).cast("string").try_cast("double")
    return (df.where(v.isNotNull() & (v < F.lit(threshold)))
            .groupBy(*keys).agg(F.avg(F.col(target).cast("double")).alias(f"mean_{target}"))
            .orderBy(*keys))


def usage_by_group(df: DataFrame, group: str, usage: str) -> DataFrame:
    return group_distribution(df, group, usage)
