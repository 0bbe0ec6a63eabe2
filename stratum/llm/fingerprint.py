"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's words are runs of anything but ASCII blanks, lower-cased; its shingles
are ``SHINGLE`` words long (fewer words: the whole sequence; none: no shingle).
The sketch is the ``K`` smallest distinct 64-bit hashes of the shingles, written
in ascending order as big-endian bytes in base64.  Hence

  merge         the K smallest of both sketches: the sketch of the union of parts
  distinct      the number of hashes if below K, else (K - 1) / (K-th hash / 2**64)
  resemblance   the share of hashes in both among the K smallest of the union
  containment   resemblance turned into common over own shingles by the counts

Two empty sketches resemble each other with 1, an empty and another with 0.

Neighbours in the order of ids are found without one task seeing all rows: ids
are cut into ranges at quantiles, the first document of each range is also sent
to the range in front of it (that of the first range to the last one), and each
range is read in order.  The text is shuffled once.

Edge cases: null text counts as empty; null ids come first; equal ids are
ordered by their texts' CRC-32; a single document is its own next; repeated rows
are documents of their own; empty tables give no rows; extra columns are unread.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.ordered import partitions, text_crc
from stratum.llm.terms import UNBLANK, Terms, distinct, lowered, mix

K = 128
SHINGLE = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Sketcher:
    def __init__(self, k: int = K, shingle: int = SHINGLE):
        self.k, self.shingle, self.terms = k, shingle, Terms(1, inside=UNBLANK)

    def sketch(self, text: str) -> np.ndarray:
        w = self.terms.hashes(lowered(text))
        if not len(w):
            return np.empty(0, np.uint64)
        n = min(self.shingle, len(w))
        h = np.zeros(len(w) - n + 1, np.uint64)
        for j in range(n):
            h = h * _MUL + w[j:j + len(h)]
        return distinct(mix(h))[:self.k]


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), ">u8").astype(np.uint64)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return distinct(np.concatenate([a, b]))[:k]


def distinct_shingles(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0 ** 64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    union = both[~twice][:k]
    return float((twice & (both <= union[-1])).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return min(1.0, common / distinct_shingles(a, k))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                          shingle: int = SHINGLE) -> DataFrame:
    """Per document: id, fingerprint, shingles (estimated distinct number).  One map."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        s = Sketcher(k, shingle)
        for b in batches:
            got = [s.sketch(t or "") for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array([encode(x) for x in got], pa.string()),
                                              pa.array([distinct_shingles(x, k) for x in got], pa.float64())],
                                             names=["_id", "fingerprint", "shingles"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, fingerprint string, shingles double").withColumnRenamed("_id", id_col)


def merge_fingerprints(prints: DataFrame, part_col: str, fp_col: str = "fingerprint", k: int = K, salts: int = 64) -> DataFrame:
    """One fingerprint for each part (null is a part): first each task's rows, then
    ``salts`` pieces of a part, then those, so that no task holds a whole hot part."""
    part = F.col(f"`{part_col}`")
    kind = prints.schema[part_col].dataType.simpleString()
    slim = prints.select(part.alias("_part"), F.col(f"`{fp_col}`").alias("_fp")).where("_fp IS NOT NULL")

    def fold(pdf: pd.DataFrame) -> np.ndarray:
        out = np.empty(0, np.uint64)
        for x in pdf["_fp"]:
            out = merge(out, decode(x), k)
        return out

    def local(batches):
        for b in batches:
            pdf = b.to_pandas()
            got = [(p, encode(fold(g))) for p, g in pdf.groupby("_part", dropna=False)]
            yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(p) else p for p, _ in got], b.schema.field("_part").type),
                                              pa.array([x for _, x in got], pa.string())], names=["_part", "_fp"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"_part": pdf["_part"].iloc[:1], "_fp": [encode(fold(pdf))]})

    t = slim.mapInArrow(local, f"_part {kind}, _fp string")
    t = t.withColumn("_salt", F.pmod(F.xxhash64("_fp"), F.lit(salts)))
    t = t.groupBy("_part", "_salt").applyInPandas(lambda pdf: whole(pdf), f"_part {kind}, _fp string")
    t = t.groupBy("_part").applyInPandas(lambda pdf: whole(pdf), f"_part {kind}, _fp string")
    return t.select(F.col("_part").alias(part_col), F.col("_fp").alias(fp_col))


def _range_of(ident, cuts: list[int]):
    """Number of cuts at or below an id, by two short scans instead of one long one."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[a:a + step] for a in range(0, len(cuts), step)]
    heads, table = F.lit([b[0] for b in blocks]).cast("array<long>"), F.array(*[F.lit(b).cast("array<long>") for b in blocks])
    block = F.size(F.filter(heads, lambda x: x <= ident))
    inside = F.size(F.filter(F.element_at(table, F.greatest(block, F.lit(1))), lambda x: x <= ident))
    return F.when(ident.isNull() | (block == 0), F.lit(0)).otherwise((block - 1) * step + inside)


def edit_and_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                         shingle: int = SHINGLE, ranges: int | None = None) -> DataFrame:
    """Per document, with its text and its edited text (the last quarter of the code
    points, rounded down, replaced by as many first ones of the next document):
    id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Ids must be whole numbers."""
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    slim = docs.select(ident.alias("_id"), text.alias("_text"), text_crc(text).alias("_crc"))
    n = ranges or 4 * partitions(docs)
    cuts = docs.agg(F.percentile_approx(ident.cast("long"), [x / n for x in range(1, n)], 10_000)).first()[0] or []
    slim = slim.withColumn("_range", _range_of(F.col("_id").cast("long"), sorted(set(cuts))))
    # the first document of each range: at most one row for each of the n ranges
    rank = F.struct(F.col("_id").isNotNull().alias("known"), F.col("_id").alias("id"), F.col("_crc").alias("crc"))
    first = sorted((r["_range"], r["_f"]["id"], r["_f"]["crc"]) for r in slim.groupBy("_range").agg(F.min(rank).alias("_f"))
                   .collect()) if cuts or docs.limit(1).count() else []
    if not first:
        first = [(0, None, -1)]
    heads = docs.sparkSession.createDataFrame([(first[j][0], first[j][1], first[j][2], first[j - 1][0]) for j in range(len(first))],
                                              "_r int, _fid long, _fcrc long, _front int")
    t = slim.join(F.broadcast(heads), F.col("_range") == F.col("_r"))
    is_head = F.col("_id").cast("long").eqNullSafe(F.col("_fid")) & (F.col("_crc") == F.col("_fcrc"))
    own = F.struct(F.col("_range").cast("int").alias("to"), F.lit(0).alias("tail"))
    ahead = F.struct(F.col("_front").alias("to"), F.lit(1).alias("tail"))
    t = t.select("_id", "_crc", "_text", F.explode(F.when(is_head, F.array(own, ahead)).otherwise(F.array(own))).alias("_at"))
    t = (t.select("_id", "_crc", "_text", F.col("_at.to").alias("_to"), F.col("_at.tail").alias("_tail"))
         .repartition(partitions(docs), "_to")
         .sortWithinPartitions("_to", "_tail", F.col("_id").asc_nulls_first(), "_crc")
         .select("_to", "_tail", "_id", "_text"))
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches):
        s, last = Sketcher(k, shingle), None  # last: (range, id, text, sketch) that waits for its next document
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part, out = b.slice(a, 256), []
                for to, tail, ident, text in zip(*[part.column(c).to_pylist() for c in ("_to", "_tail", "_id", "_text")]):
                    sk = s.sketch(text)
                    if last is not None and last[0] == to:
                        _, i, old, mine = last
                        quarter = len(old) // 4
                        edited = old[:len(old) - quarter] + text[:quarter]
                        es = s.sketch(edited) if quarter else mine
                        out.append((i, len(old), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), encode(mine),
                                    encode(es), resemblance(mine, es, k), resemblance(mine, sk, k)))
                    last = None if tail else (to, ident, text, sk)
                if out:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(cols[0], part.schema.field("_id").type), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.string()) for c in cols[2:5]],
                        pa.array(cols[5], pa.float64()), pa.array(cols[6], pa.float64())], names=names)

    names = ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return t.mapInArrow(run, f"_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                        "near_edited double, near_next double").withColumnRenamed("_id", id_col)
