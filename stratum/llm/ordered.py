"""Running sums and positions in a global order, without a single-task window.

Rows are dealt to value ranges of the order (``repartitionByRange``), and the
ranges are fixed by a checkpoint, so that every later reading, and every retry
after a lost executor, sees the same ones.  Totals per range give each range
its offset; inside a range an ordinary window does the rest.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.session import cut_lineage, scratch_path

#: what splits words: ASCII blank, tab, line feed, vertical tab, form feed, carriage return
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, order: list[str], sums: list[str], group: str | None = None) -> DataFrame:
    """``df`` with ``before_<c>`` for each c in ``sums`` and ``index`` (0-based): sums
    over, and number of, the rows in front of a row in ``order``, inside its group.

    ``group`` and ``sums`` must not be null.  Rows that are equal in ``order``
    are taken in the order of the input's partitions; one order value may hold
    any share of the rows, since that tie-break is part of the ranges.
    """
    keys = [group] if group else []
    t = df.withColumn("_tie", F.monotonically_increasing_id())
    t = cut_lineage(t.repartitionByRange(partitions(df), *keys, *order, "_tie")
                    .withColumn("_range", F.spark_partition_id()))
    totals = t.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_t_index"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    # one row for each range (and group that it holds): this window is over totals only
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = ["index", *sums]
    offsets = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(ahead), F.lit(0)).alias(f"_o_{c}") for c in names])
    # without groups there are at most as many rows as ranges: a proven bound
    t = t.join(offsets if group else F.broadcast(offsets), [*keys, "_range"])
    inside = Window.partitionBy(*keys, "_range").orderBy(*order, "_tie")
    to_here = inside.rowsBetween(Window.unboundedPreceding, 0)
    return t.select(*df.columns,
                    *[(F.sum(c).over(to_here) - F.col(c) + F.col(f"_o_{c}")).alias(f"before_{c}") for c in sums],
                    (F.row_number().over(inside) - 1 + F.col("_o_index")).cast("long").alias("index"))


def numbered(docs: DataFrame, **own: Column) -> DataFrame:
    """One row for each of ``docs``: _row (a name that no other row has), the columns
    ``own``, and _doc, all columns of ``docs`` in one struct, so that no name can clash
    (``select("_doc.*")`` gives them back).

    Every reading, and every retry after a lost executor, gives a row the same name: in
    a Parquet table, its file and its place there; anything else is written once, as a
    table in the shared folder, with numbers (of types that Parquet can hold).  Joins by
    _row are joins by a unique key: rows that are equal in id and text are spread like
    any others."""
    spark = docs.sparkSession
    more = [*[c.alias(n) for n, c in own.items()], whole(docs)]
    if _is_table(docs):
        return docs.select(_name(F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")), *more)
    t = docs.select(_name(F.lit(0).cast("long"), F.monotonically_increasing_id()), *more)
    path = scratch_path(spark, "rows")
    t.write.parquet(path)
    return spark.read.schema(t.schema).parquet(path)


def _name(file: Column, place: Column) -> Column:
    return F.struct(file.alias("file"), place.alias("place")).alias("_row")


def _is_table(docs: DataFrame) -> bool:
    """Whether ``docs`` is a Parquet table as read, each of whose rows is one of a file."""
    if "_metadata" in (c.lower() for c in docs.columns) or not hasattr(docs, "_jdf"):
        return False
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return False
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:  # a format whose rows have no place
        return False
    return True


def whole(docs: DataFrame) -> Column:
    """_doc: all columns of ``docs`` in one struct."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")


def text_digest(text: Column) -> Column:
    """128 bits (MD5) that tell texts apart; null text: of the empty one."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
