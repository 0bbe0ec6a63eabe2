"""Exact removal of repeated byte strings, by prefix-free parsing.

Contract: a byte goes if it is covered by a string of ``length`` bytes that also
starts earlier in the corpus (smaller id, or same document and earlier start);
strings are judged on the input, overlaps count, none crosses documents.

Parse.  A rolling hash of ``gram`` bytes triggers at its minimum (the leftmost)
among the grams of every window of ``length`` bytes.  Triggers depend on content
alone, so equal strings hold the same trigger at the same place.  A phrase is all
windows that share a trigger occurrence, with all their bytes: neighbouring
phrases overlap by length - 1 bytes, no phrase is a prefix of the next step's,
and a document is the sequence of its phrases (``where``, ``count``, ``offset`` of
the trigger).

Dictionary.  Equal phrases are one entry, owned by its first occurrence in
corpus order; all windows of later occurrences are repeats at once.  That settles
highly repetitive text with a row per phrase (about length/2 bytes), and copies
inside a task with a row per run of phrases.

Suffixes.  Windows of two different entries can be equal only if their trigger
grams are.  Just the entries whose trigger occurs in another entry are refined:
first into blocks of ``BLOCK`` suffixes, keyed by what all of them contain, then,
where such a key still has several blocks, into single suffixes cut at
``length`` bytes.  Each class of equal suffixes is again owned by its first
position in corpus order.  (A suffix array would also put the classes into
lexicographic order; the contract needs equality and corpus order alone, so
classes are found by fingerprints, 96 bits beside the trigger's 32, and ordered
by position.)

Every step is a shuffle of short rows by the trigger's fingerprint.  A task
keeps one row for equal phrases before the shuffle, so a phrase that fills a
third of the corpus arrives once per map task.  Texts are shuffled once, by
document, and read three times from that shuffle.

Edge cases: null and short texts have nothing removed; repeated rows with an
equal id are ordered by their text's MD5, then arbitrarily (they are equal);
null ids come first; extra columns are unread; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.llm.ordered import numbered, partitions, running, text_digest
from stratum.llm.terms import mix
from stratum.session import cut_lineage

BLOCK = 8
_CHUNK = 1 << 19
#: u1 and u2 are 96 bits of a piece, g 32 bits of what it must share to be compared
_ROW = "g int, u1 long, u2 int, ord long, at long, old boolean"


class Rolling:
    """Fingerprints of substrings from two running polynomial sums (modulo 2**64)."""

    def __init__(self):
        rng = np.random.default_rng(11)
        self.tables = [rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)]
        self.base = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
        self.power = [np.ones(1, np.uint64)] * 2
        self.inverse = [np.ones(1, np.uint64)] * 2

    def _grow(self, n: int):
        if len(self.power[0]) < n:
            n = 1 << n.bit_length()
            for k, r in enumerate(self.base):
                for out, x in ((self.power, r), (self.inverse, pow(r, -1, 1 << 64))):
                    a = np.full(n, np.uint64(x), np.uint64)
                    a[0] = 1
                    out[k] = np.multiply.accumulate(a)

    def load(self, data: np.ndarray):
        self._grow(len(data) + 1)
        self.sums = []
        for k in range(2):
            p = np.empty(len(data) + 1, np.uint64)
            p[0] = 0
            np.cumsum(self.tables[k][data] * self.power[k][:len(data)], out=p[1:])
            self.sums.append(p)

    def of(self, start: np.ndarray, end: np.ndarray, k: int = 0, salt=0) -> np.ndarray:
        p = self.sums[k]
        h = (p[end] - p[start]) * self.inverse[k][start]
        return mix(h + (np.asarray(end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + np.asarray(salt).astype(np.uint64))


def pack(where, count, offset):
    """Start, number of windows and the trigger's offset from the first in one long."""
    return (where.astype(np.int64) << 32) | (count.astype(np.int64) << 8) | np.asarray(offset).astype(np.int64)


def unpack(at):
    return at >> 32, (at >> 8) & 0xFFFFFF, at & 0xFF


def phrases(r: Rolling, n: int, length: int, gram: int):
    """(where, count, offset) of the phrases of the loaded text of n >= length bytes."""
    width = length - gram + 1
    starts = np.arange(n - gram + 1)
    bits = np.uint64(int(n).bit_length())
    h = r.of(starts, starts + gram)
    low = ((h >> bits) << bits) | starts.astype(np.uint64)  # the position breaks ties: leftmost
    step = 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[:len(low) - (width - step)], low[width - step:])
    trigger = (low & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    first = np.ones(len(trigger), bool)
    np.not_equal(trigger[1:], trigger[:-1], out=first[1:])
    where = np.flatnonzero(first)
    count = np.diff(np.append(where, len(trigger)))
    return where, count, trigger[where] - where


def level_rows(r: Rolling, level: int, where, count, offset, length: int, gram: int):
    """(g, u1, u2, at) of phrases (0), or of the blocks (1) or windows (2) inside the given pieces."""
    trigger = where + offset
    if level:
        # one entry per window, then joined into blocks of equal piece and offset // BLOCK
        piece = np.repeat(np.arange(len(where)), count)
        start = where[piece] + (np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count))
        off = trigger[piece] - start
        new = np.ones(len(piece), bool)
        if level == 1:
            block = off // BLOCK
            np.logical_or(piece[1:] != piece[:-1], block[1:] != block[:-1], out=new[1:])
        at = np.flatnonzero(new)
        where, count, offset, trigger = start[at], np.diff(np.append(at, len(piece))), off[at], trigger[piece[at]]
    end = where + count - 1 + length
    u1, u2 = r.of(where, end, 0, offset), r.of(where, end, 1, offset)
    if level == 0:
        g = r.of(trigger, trigger + gram, 1, 1)
    elif level == 1:
        core = trigger - offset // BLOCK * BLOCK
        g = r.of(core, core + (length - BLOCK + 1), 1, 2 + offset // BLOCK)
    else:
        g = mix(u1 + u2)
    return _high(g), u1.view(np.int64), _high(u2), pack(where, count, offset)


def _high(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _fold(parts: list) -> pa.RecordBatch:
    """Rows of a chunk: equal ones but the first are known repeats (``old``); runs of
    those in a document become one row, spread by a hash of their own."""
    g, u1, u2, order, at = (np.concatenate(x) for x in zip(*parts))
    by = np.lexsort((at, order, g, u2, u1))
    g, u1, u2, order, at = g[by], u1[by], u2[by], order[by], at[by]
    old = np.zeros(len(g), bool)
    old[1:] = (u1[1:] == u1[:-1]) & (u2[1:] == u2[:-1]) & (g[1:] == g[:-1])
    o, a = order[old], at[old]
    by = np.lexsort((a, o))
    o, (where, count, _) = o[by], unpack(a[by])
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (where[1:] != where[:-1] + count[:-1])
    heads = np.flatnonzero(new)
    total = np.add.reduceat(count, heads) if len(heads) else count
    run = pack(where[heads], np.minimum(total, 0xFFFFFF), np.zeros(len(heads)))
    more = []  # a run too long for its field goes on in further rows
    for k in np.flatnonzero(total > 0xFFFFFF):
        for s in range(0xFFFFFF, int(total[k]), 0xFFFFFF):
            more.append((int(o[heads[k]]), (int(where[heads[k]]) + s) << 32 | min(0xFFFFFF, int(total[k]) - s) << 8))
    oo = np.concatenate([o[heads], np.array([x for x, _ in more], np.int64)])
    run = np.concatenate([run, np.array([x for _, x in more], np.int64)])
    spread = _high(mix(oo.view(np.uint64) + run.view(np.uint64)))
    nil = np.zeros(len(oo), np.int64)
    new = ~old
    cols = [np.concatenate([g[new], spread]), np.concatenate([u1[new], nil]), np.concatenate([u2[new], nil.astype(np.int32)]),
            np.concatenate([order[new], oo]), np.concatenate([at[new], run]), np.concatenate([np.zeros(new.sum(), bool), np.ones(len(oo), bool)])]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["g", "u1", "u2", "ord", "at", "old"])


def _emit(rows, level: int, length: int, gram: int):
    """rows: (ord, text, pieces or None) -> folded record batches."""
    r, parts, held = Rolling(), [], 0
    for order, text, pieces in rows:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        if len(data) < length:
            continue
        r.load(data)
        if level == 0:
            where, count, offset = phrases(r, len(data), length, gram)
        else:
            where, count, offset = unpack(np.sort(pieces))
        g, u1, u2, at = level_rows(r, level, where, count, offset, length, gram)
        parts.append((g, u1, u2, np.full(len(g), order, np.int64), at))
        held += len(g)
        if held >= _CHUNK:
            yield _fold(parts)
            parts, held = [], 0
    if parts:
        yield _fold(parts)


def _settle(rows: DataFrame, n: int, last: bool) -> DataFrame:
    """rows -> per document: repeats (pieces whose windows all start earlier too) and
    open (first occurrences that share their key with other pieces)."""
    owner = Window.partitionBy("g", "u1", "u2", "old").orderBy("ord", "at")
    t = rows.repartition(n, "g").withColumn("_first", (~F.col("old") & (F.row_number().over(owner) == 1)).cast("int"))
    t = t.withColumn("_open", F.lit(False) if last else (F.col("_first") == 1) & (F.sum("_first").over(Window.partitionBy("g")) > 1))
    t = t.where((F.col("_first") == 0) | F.col("_open"))
    return t.groupBy("ord").agg(F.collect_list(F.when(~F.col("_open"), F.col("at"))).alias("repeats"),
                                F.collect_list(F.when(F.col("_open"), F.col("at"))).alias("open"))


def _ordered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(_ord, _text) and, unless _ord is the id itself, (_o, _id): the id serves if all
    are there and unique whole numbers, else a position in corpus order does."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("_text"))
    whole = dict(slim.dtypes)["_id"] in ("tinyint", "smallint", "int", "bigint")
    if whole and not slim.groupBy("_id").count().where("_id IS NULL OR count > 1").limit(1).count():
        return slim.select(F.coalesce(F.col("_id").cast("long"), F.lit(0)).alias("_ord"), "_text"), None
    rows = numbered(slim, _id=F.col("_id"), _digest=text_digest(F.col("_text")))
    place = cut_lineage(running(rows.drop("_doc"), ["_id", "_digest"], []))
    texts = rows.select("_row", F.col("_doc._text").alias("_text")).join(place.select("_row", F.col("index").alias("_ord")), "_row")
    return texts.select(F.coalesce("_ord", F.lit(0)).alias("_ord"), "_text"), place.select(F.col("index").alias("_o"), "_id")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, gram: int = 24,
                   kept_text: bool = False) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for,
    ``kept`` (binary: what is left; cuts may fall inside a character)."""
    if not BLOCK <= gram <= length - BLOCK or length - gram > 255 - BLOCK:
        raise ValueError("gram must be 8 bytes or more, and between 8 and 247 bytes below length")
    n = partitions(docs)
    base, ids = _ordered(docs, id_col, text_col)
    texts = base.repartition(n, "_ord")  # the one shuffle of the texts: every use has the same columns

    def first(batches):
        yield from _emit(((o, t, None) for b in batches for o, t in zip(b.column("_ord").to_pylist(), b.column("_text").to_pylist())),
                         0, length, gram)

    def finer(level):
        def run(batches):
            yield from _emit(((o, t, p) for b in batches for o, t, p in zip(
                b.column("_ord").to_pylist(), b.column("_text").to_pylist(),
                (x.values.to_numpy() for x in b.column("open")))), level, length, gram)

        return run

    settled = [_settle(base.mapInArrow(first, _ROW), n, False)]
    for level in (1, 2):
        pieces = settled[-1].where(F.size("open") > 0).select(F.col("ord"), "open")
        met = texts.join(pieces, F.col("_ord") == F.col("ord")).select("_ord", "_text", "open")
        settled.append(_settle(met.mapInArrow(finer(level), _ROW), n, level == 2))
    out = texts
    for k, s in enumerate(settled):
        s = s.select(F.col("ord").alias(f"_o{k}"), F.col("repeats").alias(f"_r{k}"))
        out = out.join(s, F.col("_ord") == F.col(f"_o{k}"), "left")
    none = F.array().cast("array<bigint>")
    out = out.select("_ord", "_text", F.concat(*[F.coalesce(f"_r{k}", none) for k in range(len(settled))]).alias("_runs"))

    def cut(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part, got = b.slice(a, 256), []
                for text, runs in zip(part.column("_text").to_pylist(), part.column("_runs")):
                    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
                    where, count, _ = unpack(runs.values.to_numpy())
                    change = np.zeros(len(data) + 1, np.int32)
                    np.add.at(change, where, 1)
                    np.add.at(change, where + count - 1 + length, -1)
                    gone = np.cumsum(change[:-1]) > 0
                    spans = int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = data[~gone].tobytes()
                    got.append((len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if kept_text else None))
                cols = list(zip(*got))
                arrays = [part.column("_ord"), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string())]
                names = ["_ord", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if kept_text:
                    arrays, names = [*arrays, pa.array(cols[4], pa.binary())], [*names, "kept"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    shape = "_ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_text
    out = out.mapInArrow(cut, shape)
    if ids is None:
        ident = F.col("_ord").cast(docs.schema[id_col].dataType)
    else:
        out, ident = out.join(ids, F.col("_ord") == F.col("_o")), F.col("_id")
    return out.select(ident.alias(id_col), *shape.replace(",", "").split()[2::2])
