"""SimHash near-duplicates: byte-position inverted index with count filtering.

Fingerprint (64 bits): the text with A-Z lower-cased, its words (runs of
anything but ASCII blanks), their ``shingle``-word shingles with repeats, joined
by single blanks; a bit is set if it is set in over half of the shingles'
XXH64 (UTF-8, seed 42).  Fewer words than that: the whole sequence is one
shingle; none: fingerprint zero, linked like any other.

Two fingerprints within 3 bits differ in at most 3 of their 8 bytes, so they
share at least 5 positional bytes.  A pair is looked for where it must meet:
5 of 8 positions put at least 3 into the front or the back half, so the
posting lists of the 8 three-byte combinations inside the halves hold every
such pair.  A pair is kept at the first list it shares only; its shared
positional bytes are tallied, pairs below the minimum go, the rest are verified
by the bits that differ.

Copies are folded first: lists hold distinct fingerprints.  Lists longer than
``list_limit`` are not paired up; their fingerprints meet at common neighbours
instead (two fingerprints within 3 bits are within 1 and 2 bits of some value),
each linked to the smallest of the 1-bit side: linear in the list, and no link
between components is lost, since all so linked are within the distance.

Edge cases: null text counts as empty; a null id belongs to its component but
never names it (a component of null ids only is named null); repeated rows give
repeated rows; empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.components import components
from stratum.llm.ordered import numbered, text_digest
from stratum.session import cut_lineage

BYTES = 8
SEED = 42
#: three positions inside one half of the eight
TRIPLES = [t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]


def simhash(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255  # blocks whose sums fit a byte
    count = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > len(bits), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 carry: tuple[str, ...] = ()) -> DataFrame:
    """(_id, carry, _fp): the id, columns to carry along and the fingerprint as a signed long."""
    text = F.col(f"`{text_col}`").cast("string")
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), *carry, text.alias("_text"))
    names = ["_id", *carry, "_fp"]

    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                fp = np.array([simhash(t, shingle) for t in part.column("_text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names[:-1]], pa.array(fp.view(np.int64))], names=names)

    kinds = [f"{c} {slim.schema[c].dataType.simpleString()}" for c in names[:-1]]
    return slim.mapInArrow(run, ", ".join([*kinds, "_fp long"]))


def _byte(c, k: int):
    return F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))


def links(distinct: DataFrame, max_bits: int = 3, list_limit: int = 256) -> DataFrame:
    """distinct (_fp) -> (a, b): pairs within ``max_bits`` (at most 3) bits; from
    long lists, enough of them to connect what is connected."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the posting lists guarantee pairs within 3 bits only")
    fp = F.col("_fp")

    def list_key(c, k):
        x, y, z = TRIPLES[k]
        return (F.lit(k) * (1 << 24) + _byte(c, x) * (1 << 16) + _byte(c, y) * (1 << 8) + _byte(c, z)).cast("long")

    postings = distinct.select("_fp", F.explode(F.array(*[list_key(fp, k) for k in range(len(TRIPLES))])).alias("_list"))
    sizes = postings.groupBy("_list").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    # only lists of two and more go on
    met = cut_lineage(postings.join(sizes, "_list"))
    short = met.where(F.col("_n") <= list_limit).select("_list", "_fp")
    a, b = F.col("a"), F.col("b")
    same = [_byte(a, k) == _byte(b, k) for k in range(BYTES)]
    first = F.lit(len(TRIPLES))
    for k in reversed(range(len(TRIPLES))):
        x, y, z = TRIPLES[k]
        first = F.when(same[x] & same[y] & same[z], F.lit(k)).otherwise(first)
    tally = sum(s.cast("int") for s in same)
    pairs = (short.select("_list", F.col("_fp").alias("a")).join(short.select("_list", F.col("_fp").alias("b")), "_list")
             .where(a < b).where(F.shiftright(F.col("_list"), 24) == first)
             .where(tally >= BYTES - max_bits).where(F.bit_count(a.bitwiseXOR(b)) <= max_bits).select("a", "b"))
    long = met.where(F.col("_n") > list_limit).select("_fp").distinct()
    if not met.where(F.col("_n") > list_limit).limit(1).count():
        return pairs
    return pairs.union(_by_neighbours(cut_lineage(long), max_bits))


def masks(bits: int) -> list[int]:
    out = [0] + [sum(1 << k for k in c) for n in range(1, bits + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _by_neighbours(fps: DataFrame, max_bits: int) -> DataFrame:
    near, far = (max_bits // 2), max_bits - max_bits // 2
    around = lambda n: F.explode(F.transform(F.lit(masks(n)).cast("array<long>"), lambda m: F.col("_fp").bitwiseXOR(m)))
    hubs = fps.select("_fp", around(near).alias("_at")).groupBy("_at").agg(F.min("_fp").alias("a"))
    return (fps.select(F.col("_fp").alias("b"), around(far).alias("_at")).join(hubs, "_at")
            .where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _rooted(fps: DataFrame, max_bits: int, list_limit: int) -> DataFrame:
    """fps (checkpointed) with _root: the component's least (none, id, fp), where none
    says that no document of the fingerprint has an id.

    Nodes are fingerprints in the order of their least ids, so a component's root
    names it: nothing is grouped or joined by component, whatever its size."""
    least = fps.groupBy("_fp").agg(F.min("_id").alias("_least"))
    node = F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("_fp").alias("fp"))
    folded = cut_lineage(least.select("_fp", node.alias("_node")))
    named = lambda c: folded.select(F.col("_fp").alias(c), F.col("_node").alias(f"n{c}"))
    edges = links(folded.select("_fp"), max_bits, list_limit).join(named("a"), "a").join(named("b"), "b")
    roots = components(edges.select(F.col("na").alias("a"), F.col("nb").alias("b"))).where("node <> root")
    of = (folded.join(roots, folded["_node"] == roots["node"], "left")
          .select("_fp", F.coalesce("root", "_node").alias("_root")))
    return fps.join(of, "_fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, list_limit: int = 256) -> DataFrame:
    """Per document: id, fingerprint (16 lowercase hex digits), component_id (the
    smallest id that links lead to, its own included)."""
    fps = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    return _rooted(fps, max_bits, list_limit).select(
        F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_root.id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 3, list_limit: int = 256) -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id (null
    last; of rows with that id, the smallest MD5 of the text; of equal ones, any).  The
    text is shuffled once, to meet the numbers of what stays."""
    rows = numbered(docs, _digest=text_digest(F.col(f"`{text_col}`").cast("string")))
    doc = F.col("_doc")
    slim = rows.select("_row", "_digest", doc[id_col].alias("_id"), doc[text_col].alias("_text"))
    fps = cut_lineage(fingerprints(slim, "_id", "_text", shingle, ("_row", "_digest")))
    stays = (_rooted(fps, max_bits, list_limit)
             .where(F.col("_id").eqNullSafe(F.col("_root.id")) & (F.col("_fp") == F.col("_root.fp")))
             .groupBy("_root").agg(F.min(F.struct("_digest", "_row")).alias("_first")).select(F.col("_first._row").alias("_row")))
    return rows.join(stays, "_row", "left_semi").select("_doc.*")
