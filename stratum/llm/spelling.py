"""Spelling variants: Bloom-guided neighbourhoods of a corpus vocabulary.

Words.  Every maximal run of ``[A-Za-z]`` and U+00C0 to U+00FF in the whole
texts, A-Z lower-cased; a run whose ``<doc_id>:<run>`` has a CRC-32 divisible by
``typo_every`` loses the code point at CRC % length (a planted typo).  Results of
at least ``min_length`` code points that occur ``min_count`` times in the corpus
are the vocabulary.

Neighbours.  Two words are near if one inserted, deleted or replaced code point
turns one into the other.  Each word generates its deletions (which reach every
insertion from the other side) and its replacements by the vocabulary's own
symbols, as hashes: a polynomial of the code points is edited in place by array
operations, no string is built.  They probe blocked Bloom filters (a 64-bit block
and ``BITS`` bits in it per word), sharded by length, so that an edit is looked
for among words of its own length only.  Filters are built by a grouped bit_or and
broadcast in passes of ``filter_blocks`` blocks at most, whatever the vocabulary:
a pass holds the words of one residue of the hash and probes the edits of that
residue.  Only positives are shuffled, as (hash, word's number), to an exact join
with the vocabulary's hashes; an edit distance of exactly one is verified on the
strings that meet.

Forms.  A word's form is its near word with the largest count (ties: the
smallest in code point order) if that count is ``ratio`` times its own at least;
its root follows forms to the last by pointer doubling (counts grow by ``ratio``
with each step, so chains are as long as a logarithm).

Edge cases: null and empty texts hold no word; a null id reads ``null`` in the
CRC; repeated rows count again; an empty table gives no rows; extra columns are
not read.  Words of any length are handled: probes are made in pieces of
``_PIECE`` array cells and positives carry no text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.terms import mix
from stratum.session import cut_lineage

_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
#: distinct words that a task holds before it hands its counts on; cells of a probing step
_HELD, _PIECE = 200_000, 1 << 20
BITS = 6          # bits of a word in its block
PER_BLOCK = 3     # words to a block on average
LONG = 40         # words of this length and above share a shard (the hash still tells lengths apart)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                typo_every: int = 199) -> DataFrame:
    """(word, n) of all words of at least ``min_length`` code points.

    A document's runs are counted first: equal runs share their CRC, which
    continues that of the id.  A run that is too short stays too short."""
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length)
    slim = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("_id"),
                       F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        held: dict[str, int] = {}

        def rows():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, text in zip(b.column("_id"), b.column("_text")):
                # bytes are lower-cased in A-Z only
                found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                start = zlib.crc32(f"{i.as_py()}:".encode())
                for w, n in found.items():
                    h = zlib.crc32(w.encode(), start)
                    if h % typo_every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1:]
                        if len(w) < min_length:
                            continue
                    held[w] = held.get(w, 0) + n
                if len(held) > _HELD:
                    yield rows()
        yield rows()

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Hashes:
    """Polynomial hashes (modulo 2**64) of words of one length as a matrix of code points."""

    def __init__(self):
        self.power = np.ones(1, np.uint64)

    def powers(self, n: int) -> np.ndarray:
        if len(self.power) < n:
            p = np.full(1 << n.bit_length(), np.uint64(_R), np.uint64)
            p[0] = 1
            self.power = np.multiply.accumulate(p)
        return self.power[:n]

    def terms(self, points: np.ndarray) -> np.ndarray:
        """(words, length): what each code point adds to its word's sum."""
        return spread(points) * self.powers(points.shape[1])

    def words(self, points: np.ndarray) -> np.ndarray:
        return seal(self.terms(points).sum(axis=1, dtype=np.uint64), points.shape[1])


def spread(points: np.ndarray) -> np.ndarray:
    """A 64-bit value for each code point."""
    return mix(points.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)) | np.uint64(1)


def seal(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + np.uint64(length))


def matrices(words: list[str]):
    """(positions in ``words``, code point matrix) for each length."""
    by: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        by.setdefault(len(w), []).append(k)
    for n, at in by.items():
        for a in range(0, len(at), step := max(1, _PIECE // n)):
            part = at[a:a + step]
            yield np.array(part), np.frombuffer("".join(words[k] for k in part).encode("utf-32-le"), np.uint32).reshape(-1, n)


def edits(h: Hashes, points: np.ndarray, symbols: np.ndarray):
    """(row of ``points``, length, hashes) of all deletions and of all replacements by
    one of ``symbols``, a piece at a time.  A replacement of a symbol by itself is
    left out; deletions in a run of equal symbols are made once."""
    m, n = points.shape
    terms = h.terms(points)
    front = np.cumsum(terms, axis=1, dtype=np.uint64)
    total = front[:, -1]
    power, code = h.powers(n), spread(symbols)
    for a in range(0, n, step := max(1, _PIECE // max(1, m))):  # deletions
        z = slice(a, a + step)
        before = front[:, z] - terms[:, z]
        after = (total[:, None] - front[:, z]) * np.uint64(_RINV)
        first = np.ones((m, before.shape[1]), bool)
        lag = points[:, max(a - 1, 0):a + before.shape[1] - 1]
        first[:, 1 if a == 0 else 0:] = points[:, max(a, 1):a + before.shape[1]] != lag
        r, c = np.nonzero(first)
        yield r, n - 1, seal((before + after)[r, c], n - 1)
    for a in range(0, n, step := max(1, _PIECE // max(1, m * len(symbols)))):  # replacements
        z = slice(a, a + step)
        new = (total[:, None] - terms[:, z])[:, :, None] + code[None, None, :] * power[None, z, None]
        r, c, s = np.nonzero(points[:, z, None] != symbols[None, None, :])
        yield r, n, seal(new[r, c, s], n)


def shard(length):
    return np.minimum(length, LONG)


def place(hashes: np.ndarray, blocks) -> tuple[np.ndarray, np.ndarray]:
    """Block inside the shard and the bits in it."""
    block = ((hashes >> np.uint64(32)) % np.asarray(blocks, np.uint64)).astype(np.int64)
    bits, x = np.zeros(len(hashes), np.uint64), hashes
    for _ in range(BITS):
        x = mix(x + np.uint64(_RINV))
        bits |= np.uint64(1) << (x >> np.uint64(58))
    return block, bits


def _residue(hashes: np.ndarray, passes: int) -> np.ndarray:
    return (mix(hashes) % np.uint64(passes)).astype(np.int64)


def _filter_rows(vocabulary: DataFrame) -> DataFrame:
    """(_id, _h, _length): a vocabulary's hashes."""
    def run(batches):
        h = Hashes()
        for b in batches:
            words, ids = b.column("word").to_pylist(), b.column("_id").to_numpy()
            for at, points in matrices(words):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(h.words(points).view(np.int64)),
                                                  pa.array(np.full(len(at), points.shape[1], np.int64))], names=["_id", "_h", "_length"])

    return vocabulary.select("_id", "word").mapInArrow(run, "_id long, _h long, _length long")


def _blocks(hashed: DataFrame, blocks: dict[int, int], passes: int, k: int) -> DataFrame:
    """(shard, block, bits) of the words of residue ``k``: one row for each block in use."""
    def run(batches):
        for b in batches:
            h = b.column("_h").to_numpy().view(np.uint64)
            mine = np.flatnonzero(_residue(h, passes) == k)
            s = shard(b.column("_length").to_numpy()[mine])
            block, bits = place(h[mine], np.array([blocks[x] for x in s.tolist()], np.uint64)) if len(mine) else (s, h[mine])
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(block), pa.array(bits.view(np.int64))], names=["s", "block", "bits"])

    return hashed.select("_h", "_length").mapInArrow(run, "s long, block long, bits long").groupBy("s", "block").agg(F.bit_or("bits").alias("bits"))


def near_pairs(vocabulary: DataFrame, filter_blocks: int = 4_000_000) -> DataFrame:
    """vocabulary (_id, word, n; checkpointed) -> (a, b), the numbers of near words, both ways."""
    sc = vocabulary.sparkSession.sparkContext
    hashed = cut_lineage(_filter_rows(vocabulary))
    sizes = {r["s"]: r["n"] for r in hashed.groupBy(F.least("_length", F.lit(LONG)).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    symbols = np.array(sorted(ord(r["c"]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
                              .where("c <> ''").distinct().collect()), np.uint32)  # at most the runs' 90 symbols
    passes = max(1, -(-sum(sizes.values()) // (PER_BLOCK * filter_blocks)))
    blocks = {int(s): n // (PER_BLOCK * passes) + 1 for s, n in sizes.items()}
    pairs = None
    for k in range(passes):
        filters = {s: np.zeros(n, np.uint64) for s, n in blocks.items()}
        got = _blocks(hashed, blocks, passes, k).toArrow()  # blocks in use: bounded by filter_blocks
        s, block, bits = (got[c].to_numpy() for c in ("s", "block", "bits"))
        for x in filters:
            filters[x][block[s == x]] = bits[s == x].view(np.uint64)
        shared = sc.broadcast(filters)

        def probe(batches, shared=shared, k=k):
            h = Hashes()
            for b in batches:
                words, ids = b.column("word").to_pylist(), b.column("_id").to_numpy()
                for at, points in matrices(words):
                    for r, length, edit in edits(h, points, symbols):
                        table = shared.value.get(int(shard(length)))
                        if table is None or not len(edit):
                            continue
                        if passes > 1:
                            mine = _residue(edit, passes) == k
                            r, edit = r[mine], edit[mine]
                        block, bits = place(edit, len(table))
                        hit = np.flatnonzero((table[block] & bits) == bits)
                        if len(hit):
                            yield pa.RecordBatch.from_arrays([pa.array(ids[at[r[hit]]]), pa.array(edit[hit].view(np.int64))], names=["a", "_h"])

        positives = vocabulary.select("_id", "word").repartition(_tasks(vocabulary), "_id").mapInArrow(probe, "a long, _h long")
        met = positives.join(hashed.select("_h", F.col("_id").alias("b")), "_h").select("a", "b").where("a <> b")
        met = cut_lineage(met)  # the filter of a pass is done with before the next is made
        pairs = met if pairs is None else pairs.union(met)
        shared.destroy()
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    named = lambda c: vocabulary.select(F.col("_id").alias(c), F.col("word").alias(f"_w{c}"))
    # exact: what met by hash is one edit apart as strings
    return (both.join(named("a"), "a").join(named("b"), "b")
            .where(F.levenshtein("_wa", "_wb", 1) == 1).select("a", "b"))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _roots(forms: DataFrame) -> DataFrame:
    """forms (a, b) -> (a, root): the end of each chain, by pointer doubling."""
    at = cut_lineage(forms.select("a", F.col("b").alias("root")))
    while True:
        step = at.select(F.col("a").alias("root"), F.col("root").alias("_next"))
        moved = at.join(step, "root", "left").select("a", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = cut_lineage(moved)
        if not moved.where("_moved").limit(1).count():
            return moved.select("a", "root")
        at = moved.select("a", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6,
                      min_count: int = 5, typo_every: int = 199, ratio: int = 5, filter_blocks: int = 4_000_000) -> DataFrame:
    """Per vocabulary word: word, n, n_near, form, form_n, root."""
    counts = word_counts(docs, id_col, text_col, min_length, typo_every).where(F.col("n") >= min_count)
    # a number for each word, fixed by the checkpoint
    vocabulary = cut_lineage(counts.withColumn("_id", F.monotonically_increasing_id()))
    pairs = near_pairs(vocabulary, filter_blocks)
    other = vocabulary.select(F.col("_id").alias("b"), F.col("word").alias("_w"), F.col("n").alias("_n"))
    best = (pairs.join(other, "b").groupBy("a")
            .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_n")).alias("m"), "_w", "b")).alias("f")))
    best = cut_lineage(vocabulary.join(best, vocabulary["_id"] == best["a"], "left")
                       .withColumn("_has", F.coalesce(-F.col("f.m") >= F.col("n") * ratio, F.lit(False)))
                       .select("_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(F.col("_has"), F.col("f._w")).alias("form"), F.when(F.col("_has"), -F.col("f.m")).alias("form_n"),
                               F.when(F.col("_has"), F.col("f.b")).alias("_form")))
    roots = _roots(best.where("_form is not null").select(F.col("_id").alias("a"), F.col("_form").alias("b")))
    ends = vocabulary.select(F.col("_id").alias("root"), F.col("word").alias("_root"))
    named = roots.join(ends, "root").select(F.col("a").alias("_id"), "_root")
    return best.join(named, "_id", "left").select("word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
