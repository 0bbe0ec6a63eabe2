"""Connected components of an edge table by alternating large-star and small-star
rounds (Kiveris et al. 2014): every round is a grouped minimum and a join, a hot
node's neighbours are never gathered in one task, and the number of rounds grows
with the square of the logarithm of the number of nodes at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): the smallest node that each node is connected to."""
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        # large star: every larger neighbour of a node, and the node, to its smallest neighbour (itself included)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: the node and its smaller neighbours to the smallest of them
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), "m")
        small = (large.join(low, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select(F.col("n").alias("u"), F.col("m").alias("v"))))
        e = cut_lineage(small.where("u <> v").distinct())
        # the edges are stars when they no longer change; a sum of hashes tells
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
