"""Mixing sources to target weights.

Size is a document's number of words (runs of anything but ASCII blanks; null
text: 0).  Sources in code point order, null last, have the weights 3, 1, 2,
repeating, and share ``share`` times the size of all documents.  A source's
target stops at ``max_epochs`` times its size; what it leaves is shared again
by weight among the rest until no target is above (water filling: all targets
below their stop are one level times their weight).

Inside a source, documents are ordered by a random key, a hash of id and seed;
prefix sums of sizes come from totals of sorted ranges.  A source whose target
is q of its sizes and a rest takes every document q times, and once more those
in front of the rest; in ``plan_mix`` the document that the cut falls into gives its
first words only, so a source's words are its target's whole part exactly.
``mix_documents`` keeps texts whole: that document is taken once more if at least
half of its words are in front of the cut, else not, so a source's words are off by
half of one document at most.

Edge cases: documents without words are taken 0 words; a source without words
has target 0; an empty table gives no rows; repeated rows are documents of
their own, one after another in the order; extra columns, whatever their names, pass
through ``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.ordered import numbered, running, text_crc, text_digest, word_count
from stratum.session import cut_lineage

WEIGHTS = (3, 1, 2)
SEED = 17


def random_key(id_col, seed: int):
    """60 random bits of an id, the same in any engine that has MD5."""
    h = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("null")), F.lit(f":{seed}")).cast("binary"))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """rows (_source, _null, _size) -> per source: _g, _total, _target.

    One row for each source; each round of water filling is one aggregation
    that sends three sums to the driver, and there is a round only if the last
    one stopped a further source."""
    stats = rows.groupBy("_null", "_source", "_g").agg(F.sum("_size").alias("_total"))
    stats = running(stats, ["_null", "_source"], ["_total"])
    w = F.lit(weights[-1])
    for k, x in enumerate(weights[:-1]):
        w = F.when(F.col("index") % len(weights) == k, F.lit(x)).otherwise(w)
    stats = cut_lineage(stats.select("_g", "_total", w.cast("double").alias("_w"),
                                     (F.col("_total") * F.lit(float(max_epochs))).alias("_stop")))
    all_words = stats.agg(F.sum("_total")).first()[0] or 0
    level, stopped = 0.0, -1
    want = float(share) * all_words
    while all_words:
        at = F.col("_stop") <= F.col("_w") * level if stopped >= 0 else F.lit(False)
        n, full, left = stats.agg(F.count(F.when(at, 1)), F.coalesce(F.sum(F.when(at, F.col("_stop"))), F.lit(0.0)),
                                  F.coalesce(F.sum(F.when(~at, F.col("_w"))), F.lit(0.0))).first()
        if n == stopped or left == 0:
            break
        level, stopped = (want - full) / left, n
    return stats.select("_g", "_total", F.least(F.col("_stop"), F.col("_w") * F.lit(level)).alias("_target"))


def _plan(rows: DataFrame, seed: int, weights, share: float, max_epochs: float) -> DataFrame:
    """rows (_id, _mark: tells texts of one id apart, _source, _size, more) with _total,
    _target, _taken."""
    rows = (rows.withColumn("_null", F.col("_source").isNull().cast("int"))
            .withColumn("_g", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")))
            .withColumn("_key", random_key(F.col("_id"), seed)))
    goal = targets(rows, weights, share, max_epochs)
    t = running(rows, ["_key", "_id", "_mark", "_size"], ["_size"], group="_g").join(goal, "_g")
    budget = F.floor("_target")
    epochs = F.when(F.col("_total") > 0, F.floor(budget / F.col("_total"))).otherwise(F.lit(0))
    t = t.withColumn("_epochs", epochs.cast("long")).withColumn("_rest", budget - F.col("_epochs") * F.col("_total"))
    once_more = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("before__size")))
    return t.withColumn("_taken", (F.col("_epochs") * F.col("_size") + once_more).cast("long"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """Per document: id, size, source_size, target (its source's), taken.  No text is shuffled."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_crc(text).alias("_mark"),
                       F.col(f"`{source_col}`").cast("string").alias("_source"), word_count(text).alias("_size"))
    return _plan(cut_lineage(rows), seed, weights, share, max_epochs).select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"),
        F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                  weights=WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each document, whole, as often as it is taken.  One shuffle of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = numbered(docs, _id=F.col(f"`{id_col}`"), _mark=text_digest(text),
                    _source=F.col(f"`{source_col}`").cast("string"), _size=word_count(text))
    plan = _plan(cut_lineage(rows.drop("_doc")), seed, weights, share, max_epochs).where("_taken > 0")
    # half a document or more counts as one; in whole numbers
    copies = F.expr("(2 * _taken + _size) div (2 * _size)").cast("int")
    plan = plan.select("_row", copies.alias("_copies")).where("_copies > 0")
    again = F.explode(F.array_repeat(F.lit(0), F.col("_copies")))
    return rows.select("_row", "_doc").join(plan, "_row").select("_doc", again.alias("_again")).select("_doc.*")
