"""Benchmark decontamination by SimHash of item-sized windows (DataFrame functions only).

Words are runs of letters and digits, lower-cased; shingles are ``SHINGLE`` words,
a window has as many words as a benchmark item (a shorter document is one window).

1. Seeds.  A window of similarity t to an item of m shingles shares at least
   t/(1+t) * (their shingles together) of them.  Positions of documents whose
   shingle occurs in an item are found by an equi-join; a document and an item
   with too few of them, or none dense enough for any window, cannot match.  Every
   window that begins at such a position (or is the document's last) and holds
   enough of them is looked at.
2. SimHash.  Windows and items get 64-bit fingerprints: the sign, bit by bit,
   of their shingles' hashes; a shingle's k-th occurrence is hashed with k, as one
   of its own, so that a repeated shingle has no more pull than as many others.
3. Multi-index.  Fingerprints are cut into ``radius + 1`` blocks; two within
   ``radius`` bits agree in one block at least, so an equi-join on (words, block
   number, block value) meets every pair within the radius; each is kept at its
   first common block, if its Hamming distance is within the radius.
4. Verification.  Weighted shingle similarity, the sum of the smaller over the
   sum of the larger counts, of at least ``similarity``.

Weighted similarity is then that of two sets: at 0.8 or more their vectors have a
cosine of 8/9 or more whatever repeats, so a bit differs with probability 0.15 at
most: 9.7 of 64 on average, standard deviation 2.9; ``radius`` 20 is 3.6 deviations
away.

The benchmark's shingles and the few surviving windows are broadcast if counted
to be few, joined otherwise.  Edge cases: null and empty texts and items of
fewer than ``SHINGLE`` words match nothing; repeated rows (equal id and text)
count once; items with equal ids are each compared; null ids are kept as such;
an empty table gives no rows; extra columns are unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.ordered import text_digest, whole
from stratum.session import cut_lineage

SHINGLE = 5
BITS = 64


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's own variable is, while a
    column named in a lambda may be computed anew for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shingles(words: Column) -> Column:
    """Hashes of all shingles in order; none if there are too few words."""
    none = F.array().cast("array<bigint>")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(
        F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (SHINGLE - 1), F.lit(1))),
                                          lambda i: F.xxhash64(F.slice(h, i, SHINGLE)))).otherwise(none))


def _id_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (cheap to count), marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _simhash(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _h, _c: shingle and its count) -> (keys, _fp)."""
    each = df.select(*keys, F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("_c")), lambda k: F.xxhash64("_h", k))).alias("_h"))
    ones = [F.sum(F.shiftrightunsigned("_h", b).bitwiseAND(F.lit(1))).alias(f"_b{b}") for b in range(BITS)]
    sums = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("_all"), *ones)
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        bit = (1 << b) - (1 << 64 if b == 63 else 0)
        fp = fp.bitwiseOR(F.when(F.col(f"_b{b}") * 2 > F.col("_all"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, fp.alias("_fp"))


def _blocks(fp: Column, radius: int) -> list[Column]:
    """radius + 1 blocks of near-equal width."""
    cuts = [round(k * BITS / (radius + 1)) for k in range(radius + 2)]
    return [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1).cast("long"))
            for a, b in zip(cuts, cuts[1:])]


def _by_block(df: DataFrame, radius: int) -> DataFrame:
    blocks = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in enumerate(_blocks(F.col("_fp"), radius))])
    t = df.withColumn("_block", F.explode(blocks))
    return t.select(*df.columns, F.col("_block.k").alias("_k"), F.col("_block.v").alias("_v"))


def items_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(_item, _iid, _words, _n, _m, _sh): one row for each different item that has a shingle."""
    t = benchmark.select(F.col(f"`{item_col}`").alias("_iid"), _words(F.col(f"`{text_col}`")).alias("_w"))
    t = t.where(F.size("_w") >= SHINGLE).withColumn("_item", F.sha1(F.concat_ws(" ", _id_key(F.col("_iid")), "_w")))
    t = t.dropDuplicates(["_item"])
    return t.select("_item", "_iid", F.size("_w").alias("_n"), _shingles(F.col("_w")).alias("_sh")).withColumn("_m", F.size("_sh"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 20, id_col: str = "doc_id",
               text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
               broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row for each document and item it holds: _id, _digest (of the text), _iid and the best
    window's _start (0-based word), _words, _hamming and _similarity."""
    items = cut_lineage(items_table(benchmark, item_col, item_text_col))
    item_sh = items.select("_item", "_n", "_m", F.explode("_sh").alias("_h")).groupBy("_item", "_n", "_m", "_h").agg(
        F.count(F.lit(1)).alias("_ic"))
    item_sh = cut_lineage(item_sh)
    need = lambda m: F.ceil(F.lit(similarity / (1 + similarity)) * m - F.lit(1e-9)).cast("int")  # noqa: E731  of both sides' shingles

    text = F.col(f"`{text_col}`").cast("string")
    base = docs.select(_id_key(F.col(f"`{id_col}`")).alias("_id"), text_digest(text).alias("_digest"), text.alias("_text"))
    # 1. seeds: positions of shingles that items have, then the dense places
    seeds = (base.select("_id", "_digest", F.posexplode(_shingles(_words(F.col("_text")))).alias("_p", "_h"))
             .join(_few(item_sh.select("_h", "_item", "_n", "_m"), broadcast_rows), "_h"))
    # a document that is repeated in full gives each position several times: a set counts it once
    held = (seeds.groupBy("_id", "_digest", "_item", "_n", "_m").agg(F.sort_array(F.collect_set("_p")).alias("_at")))
    # a document shorter than the item is caught by its own size below, so the bound here allows for it
    held = cut_lineage(held.where(F.size("_at") >= need(F.col("_m"))))
    same = (F.col("_id") == F.col("_hid")) & (F.col("_digest") == F.col("_hdigest"))
    sizes = base.join(_few(held.select(F.col("_id").alias("_hid"), F.col("_digest").alias("_hdigest")).distinct(), broadcast_rows), same, "left_semi")
    texts = (sizes.dropDuplicates(["_id", "_digest"]).select("_id", "_digest", _words(F.col("_text")).alias("_w"))
             .select("_id", "_digest", F.size("_w").alias("_len"), _shingles(F.col("_w")).alias("_dsh")))
    h = held.select(F.col("_id").alias("_hid"), F.col("_digest").alias("_hdigest"), "_item", "_n", "_m", "_at")
    places = texts.join(h, same).drop("_hid", "_hdigest")
    places = places.withColumn("_span", F.least("_m", F.size("_dsh"))).withColumn("_need", need(F.col("_m") + F.col("_span")))
    # windows that begin at a seed (or are the last one) and hold enough of them: moving a
    # window's start to its first seed loses none
    last = F.size("_dsh") - F.col("_span")
    reach = F.transform("_at", lambda p, i: F.struct(F.least(p, last).alias("s"), F.get("_at", i + F.col("_need") - 1).alias("e")))
    starts = F.array_distinct(F.transform(F.filter(reach, lambda x: x["e"] < x["s"] + F.col("_span")), lambda x: x["s"]))
    windows = cut_lineage(places.withColumn("_start", F.explode(starts)).select(
        "_id", "_digest", "_start", "_n", F.slice("_dsh", F.col("_start") + 1, F.col("_span")).alias("_wsh")).distinct())

    # 2. fingerprints
    key = ["_id", "_digest", "_start", "_n"]
    weigh = windows.select(*key, F.explode("_wsh").alias("_h")).groupBy(*key, "_h").agg(F.count(F.lit(1)).alias("_c"))
    fps = _simhash(weigh, key)
    item_fps = _simhash(item_sh.select("_item", "_n", "_h", F.col("_ic").alias("_c")), ["_item", "_n"])
    # 3. multi-index blocks
    a = _by_block(cut_lineage(fps), radius)
    b = _by_block(cut_lineage(item_fps), radius).select("_item", F.col("_n").alias("_in"), F.col("_fp").alias("_ifp"), F.col("_k").alias("_ik"), F.col("_v").alias("_iv"))
    first = F.lit(True)
    for k, (x, y) in enumerate(zip(_blocks(F.col("_fp"), radius), _blocks(F.col("_ifp"), radius))):
        first = first & ((F.col("_k") <= k) | (x != y))
    hamming = F.bit_count(F.col("_fp").bitwiseXOR(F.col("_ifp")))
    pairs = a.join(_few(b, broadcast_rows), (F.col("_n") == F.col("_in")) & (F.col("_k") == F.col("_ik")) & (F.col("_v") == F.col("_iv"))
                   & first & (hamming <= radius)).select(*key, "_item", hamming.alias("_hamming"))
    # 4. exact weighted similarity
    total = windows.select(*key, F.size("_wsh").alias("_wm"))
    both = (pairs.join(weigh, key).join(_few(item_sh.select("_item", "_h", "_ic"), broadcast_rows), ["_item", "_h"])
            .groupBy(*key, "_item", "_hamming").agg(F.sum(F.least("_c", "_ic")).alias("_common")))
    scored = (both.join(total, key).join(_few(items.select("_item", "_iid", "_m"), broadcast_rows), "_item")
              .withColumn("_similarity", F.col("_common") / (F.col("_wm") + F.col("_m") - F.col("_common")))
              .where(F.col("_similarity") >= similarity))
    best = scored.groupBy("_id", "_digest", "_item", "_iid").agg(
        F.max_by(F.struct("_start", F.col("_n").alias("_words"), "_hamming", "_similarity"), F.struct("_similarity", -F.col("_start"))).alias("_b"))
    ident = F.when(F.col("_id") != "n", F.substring("_id", 2, 1 << 30)).cast(docs.schema[id_col].dataType)
    return best.select(ident.alias("_id"), "_digest", "_iid", F.col("_b._start").alias("_start"), F.col("_b._words").alias("_words"),
                       F.col("_b._hamming").alias("_hamming"), F.col("_b._similarity").alias("_similarity"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 1_000_000,
               **more) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    leaks = cut_lineage(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, broadcast_rows=broadcast_rows, **more)
                        .select(_id_key(F.col("_id")).alias("_lid"), F.col("_digest").alias("_ldigest")).distinct())
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(whole(docs), _id_key(ident).alias("_lid"), text_digest(text).alias("_ldigest"))
    return keyed.join(_few(leaks, broadcast_rows), ["_lid", "_ldigest"], "left_anti").select("_doc.*")
