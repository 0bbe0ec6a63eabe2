"""Sharding: contiguous shards of near-equal bytes.

Documents are put in the order of their id (null first; equal ids by the
text's CRC-32, then size).  Global prefix sums of their sizes come from totals
of ordered ranges; a document belongs to the shard in whose equal share of all
bytes its middle byte falls.  Shards are contiguous in that order, no shard's
bytes differ from the target by more than the largest document, and a
document's slot is its place in the shard.

A size is the text's UTF-8 bytes (null: none) plus ``overhead``.  Edge cases:
an empty table gives no rows; with fewer documents than shards some shards stay
empty; repeated rows are separate documents with slots of their own; extra
columns pass through ``shard_documents`` (input columns called like a result
column are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.ordered import numbered, running, text_crc
from stratum.session import cut_lineage

LAW = "bytes"


def _assign(rows: DataFrame, n_shards: int) -> DataFrame:
    """rows (_id, _crc, _size, more) with shard and slot."""
    t = running(rows, ["_id", "_crc", "_size"], ["_size"])
    total = rows.agg(F.sum("_size")).first()[0] or 0
    # twice the middle byte, so that all is in whole numbers; decimals keep the product exact
    middle = (F.col("before__size") * 2 + F.col("_size")).cast("decimal(20,0)")
    shard = F.floor(middle * n_shards / F.lit(2 * max(total, 1)).cast("decimal(20,0)")).cast("int")
    t = t.withColumn("shard", F.least(F.lit(n_shards - 1), shard))
    first = t.groupBy("shard").agg(F.min("index").alias("_first"))  # at most n_shards rows
    return (t.join(F.broadcast(first), "shard")
            .withColumn("slot", F.col("index") - F.col("_first")).drop("index", "before__size", "_first"))


def assign_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                  overhead: int = 16) -> DataFrame:
    """Per document: id, size, text_crc32, law, shard, slot, grown_shard (null: the
    law ``bytes`` promises nothing about one more shard).  No text is shuffled."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_crc(text).alias("_crc"),
                       (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("_size"))
    return _assign(cut_lineage(rows), n_shards).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text",
                    overhead: int = 16) -> DataFrame:
    """``docs`` with size, shard and slot; the text is shuffled once, to meet its plan row."""
    docs = docs.drop("size", "shard", "slot")
    text = F.col(f"`{text_col}`").cast("string")
    rows = numbered(docs, _id=F.col(f"`{id_col}`"), _crc=text_crc(text),
                    _size=(F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long"))
    plan = _assign(cut_lineage(rows.drop("_doc")), n_shards).select("_row", F.col("_size").alias("size"), "shard", "slot")
    return rows.select("_row", "_doc").join(plan, "_row").select("_doc.*", "size", "shard", "slot")
