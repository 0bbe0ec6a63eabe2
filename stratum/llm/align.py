"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline.

Every text is encoded without special tokens by a byte-level BPE (A: blank +
text) and by a piece BPE with byte fallback (B: the text, to which it adds the
blank itself).  Token lists are flattened with their parent indices; cumulative
sums of token bytes, less the bytes of the documents in front, give each
token's end inside its document.  One full outer Acero hash join on
(document, end) meets the two sides:

* ends that both sides have cut a document into groups;
* in the order of the ends, each row is one stretch of bytes that lies in one A
  token and one B token.  The tokens of the next end of their side cover it, so
  filling nulls backwards gives all pairs of overlapping occurrences (links),
  each once: two overlapping tokens share one such stretch.

``Table.group_by`` counts id pairs inside a task, Spark merges the counts.  What
a document's links add up to is looked up in the merged counts, which are
broadcast in parts of ``pairs_per_pass`` pairs at most: the tokenizers run once,
links stay compressed in a written table in the shared folder, and a further
part costs one more reading of that table.

A's pre-tokenizer cuts a text into pieces that are encoded on their own, and no
piece of B reaches across the begin of a run of blanks; each distinct part is
encoded by its tokenizer once and remembered for a while.

Edge cases: null and empty texts, and texts whose joined A or B token bytes are
not blank + text (say, U+2581, which B cannot tell from a blank), have no
tokens: zeros and the empty string.  Strings of special tokens are plain text.
Repeated rows, repeated and null ids are rows of their own; an empty table gives
no rows; extra columns are not read.  A text is encoded whole, whatever its
length; slices of ``SLICE`` bytes bound what is flattened at once, and a longer
text is a slice of its own.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.session import cut_lineage, scratch_path

TOKENIZERS = "/opt/tokenizers"
BYTE_BPE = f"{TOKENIZERS}/byte_bpe_50k.json"
PIECE_BPE = f"{TOKENIZERS}/piece_bpe_32k.model"
SLICE = 1 << 20
#: distinct pairs that a task holds before it hands its partial counts on, and pairs in a row of them
HELD, ROW = 1 << 20, 1 << 16


def byte_symbols() -> dict[str, int]:
    """Symbol -> byte of byte-level BPE: visible Latin-1 characters stand for their
    own byte, the other bytes follow from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Aligned:
    """A slice of texts: per text counts and groups, per link its text and id pair (a << 32 | b)."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: pa.Array
    doc: pa.Array
    pair: pa.Array


#: pieces that byte-level BPE encodes on their own (the pattern of its pre-tokenizer; fixed value)
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: texts of these code points only are cut by that pattern alike in every library and Unicode version
PLAIN = "[\t\n\r -~\u00a1-\u00ac\u00ae-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*"


#: parts of blank + text that the piece BPE encodes on their own, if no piece has a blank behind another symbol
PART = r" +[^ ]*"


class Remembered:
    """Encodes each distinct part of the texts once, as long as it is remembered: parts
    used since the last ``most`` new ones are.  ``cut`` gives a text's parts, or None
    for a text to be encoded whole; ``encode`` gives the ids of several."""

    def __init__(self, cut, encode, most: int = 1 << 19):
        self.cut, self.encode, self.most, self.young, self.old = cut, encode, most, {}, {}

    def _bytes(self, texts: list[str], whole: bool) -> list[bytes]:
        return [np.array(ids, np.int32).tobytes() for ids in self.encode(texts, whole)] if texts else []

    def __call__(self, texts: list[str]) -> pa.ListArray:
        cut = [self.cut(t) for t in texts]
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        need = set(chain.from_iterable(c for c in cut if c is not None)).difference(self.young)
        again = need.intersection(self.old)
        self.young.update((p, self.old[p]) for p in again)
        new = list(need - again)
        self.young.update(zip(new, self._bytes(new, False)))
        whole = iter(self._bytes([t for t, c in zip(texts, cut) if c is None], True))
        ids = [next(whole) if c is None else b"".join(map(self.young.__getitem__, c)) for c in cut]
        ends = np.cumsum([0, *map(len, ids)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))


class Aligner:
    def __init__(self, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        import regex

        cut_a, plain = regex.compile(PIECE).findall, re.compile(PLAIN).fullmatch
        self.ids_a = Remembered(lambda t: cut_a(t) if plain(t) else None, self._encode_a)
        # a piece with a blank behind another symbol could join two parts
        apart = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        cut_b = re.compile(PART).findall
        self.ids_b = Remembered(lambda t: cut_b(t) if apart and "▁" not in t else None, self._encode_b)
        symbols, vocabulary = byte_symbols(), self.a.get_vocab(with_added_tokens=False)
        a = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for entry, i in vocabulary.items():
            # an entry with other symbols cannot come out of the byte-level encoder
            a[i] = bytes(symbols[c] for c in entry) if all(c in symbols for c in entry) else b""
        b = [bytes([int(self.b.id_to_piece(i)[1:-1], 16)]) if self.b.is_byte(i)
             else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        self.bytes_a, self.bytes_b = pa.array(a, pa.binary()), pa.array(b, pa.binary())
        self.name_a, self.name_b = (pa.array([str(i) for i in range(len(x))]) for x in (a, b))

    def _encode_a(self, texts: list[str], whole: bool) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_b(self, texts: list[str], whole: bool) -> list[list[int]]:
        """Texts and parts begin with a blank; B adds it itself (though not to nothing)."""
        blank = [self.b.piece_to_id("▁")]
        ids = self.b.encode([t[1:] for t in texts], num_threads=1)
        return [i if t != " " else blank for t, i in zip(texts, ids)]

    def __call__(self, texts: list[str | None]) -> Aligned:
        n = len(texts)
        at = np.array([k for k, t in enumerate(texts) if t], np.int64)
        some = [" " + texts[k] for k in at]
        a, b = self.ids_a(some), self.ids_b(some)
        want = pa.array([t.encode() for t in some], pa.binary())
        same = pc.and_(pc.equal(_joined(a, self.bytes_a), want), pc.equal(_joined(b, self.bytes_b), want))
        a, b, want, at = a.filter(same), b.filter(same), want.filter(same), at[same.to_numpy(zero_copy_only=False)]
        size = pc.binary_length(want).cast(pa.int64())
        front = pc.subtract(pc.cumulative_sum(size), size)
        left, right = (_ends(x, table, front, name) for x, table, name in ((a, self.bytes_a, "a"), (b, self.bytes_b, "b")))
        met = left.join(right, ["doc", "end"], join_type="full outer", use_threads=False).combine_chunks()
        met = met.take(pc.sort_indices(pc.add(met["end"], front.take(met["doc"]))))  # ends in the slice's bytes: one key
        both = np.flatnonzero(pc.and_(met["a"].is_valid(), met["b"].is_valid()).to_numpy(zero_copy_only=False))
        ga, gb = (pc.binary_join(pa.ListArray.from_arrays(_offsets(met[c].is_valid(), both), names.take(pc.list_flatten(x))), ",")
                  for c, names, x in (("a", self.name_a, a), ("b", self.name_b, b)))
        doc = at[met["doc"].to_numpy()]
        n_groups = np.bincount(doc[both], minlength=n)
        cut = pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype(np.int32))
        groups = pc.binary_join(pa.ListArray.from_arrays(cut, pc.binary_join_element_wise(ga, gb, "|")), ";")
        ids = [pc.fill_null_backward(met[c]).combine_chunks().cast(pa.int64()) for c in ("a", "b")]
        pair = pc.bit_wise_or(pc.shift_left(ids[0], pa.scalar(32, pa.int64())), ids[1])
        counts = [np.zeros(n, np.int64) for _ in range(2)]
        for c, x in zip(counts, (a, b)):
            c[at] = pc.list_value_length(x).to_numpy(zero_copy_only=False)
        return Aligned(*counts, n_groups, groups, pa.array(doc), pair)


@lru_cache(maxsize=2)
def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    return Aligner(byte_bpe, piece_bpe)


def _joined(lists: pa.ListArray, table: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, table.take(lists.values)), b"")


def _ends(lists: pa.ListArray, table: pa.Array, front: pa.Array, name: str) -> pa.Table:
    """(doc, end, id) of every token: cumulative sums that begin anew with each document."""
    ids, doc = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int32())
    total = pc.cumulative_sum(pc.binary_length(table).cast(pa.int64()).take(ids))
    return pa.table({"doc": doc, "end": pc.subtract(total, front.take(doc)), name: ids})


def _offsets(has: pa.ChunkedArray, both: np.ndarray) -> pa.Array:
    """Where groups end among a side's tokens."""
    return pa.array(np.concatenate([[0], np.cumsum(has.to_numpy())[both]]).astype(np.int32))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list]]:
    texts, a, size = batch.column("_text").to_pylist(), 0, 0
    for k, t in enumerate(texts):
        size += len(t or "")
        if size > SLICE or k == len(texts) - 1:
            yield batch.slice(a, k + 1 - a), texts[a:k + 1]
            a, size = k + 1, 0


class _Counts:
    """A task's pair counts: ``add`` tables of pairs, ``rows`` hands them on, ROW in each."""

    def __init__(self):
        self.tables, self.size = [], 0

    def add(self, pair: pa.Array):
        t = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")])
        self.tables.append(t.rename_columns(["pair", "n"]))
        self.size += len(t)
        if self.size > 4 * HELD:
            self._merge()

    def _merge(self):
        t = pa.concat_tables(self.tables).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        self.tables, self.size = [t.rename_columns(["pair", "n"])], len(t)

    def rows(self, least: int) -> Iterator[tuple[list, list]]:
        """What is held, if more than ``least`` distinct pairs are."""
        if not self.size > least:
            return
        self._merge()
        if self.size > least:
            t = self.tables[0]
            for a in range(0, len(t), ROW):
                yield t["pair"].slice(a, ROW).to_numpy(), t["n"].slice(a, ROW).to_numpy()
            self.tables, self.size = [], 0


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))


def align_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                    piece_bpe: str = PIECE_BPE) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2``).  One map."""
    slim = _slim(docs, id_col, text_col)

    def run(batches):
        align = aligner(byte_bpe, piece_bpe)
        for b in batches:
            for part, texts in _slices(b):
                x = align(texts)
                yield pa.RecordBatch.from_arrays([part.column("_id"), *map(pa.array, (x.n_a, x.n_b, x.n_groups)), x.groups],
                                                 names=["_id", "n_a", "n_b", "n_groups", "groups"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, n_a long, n_b long, n_groups long, groups string").withColumnRenamed("_id", id_col)


def write_links(docs: DataFrame, id_col: str, text_col: str, byte_bpe: str, piece_bpe: str) -> DataFrame:
    """The written table: a row per document (_row, _id, counts, sha256 of its groups, its
    links as compressed pairs), and rows of partial counts (_pairs, _counts; _row is null)."""
    from pyspark import TaskContext

    slim = _slim(docs, id_col, text_col)
    kind = slim.schema["_id"].dataType.simpleString()

    def run(batches):
        align, counts, codec = aligner(byte_bpe, piece_bpe), _Counts(), pa.Codec("zstd")
        row, names = TaskContext.get().partitionId() << 40, ["_row", "_id", "_na", "_nb", "_groups", "_sha", "_links", "_pairs", "_counts"]
        longs, id_type = pa.list_(pa.int64()), None

        def held(least):
            for p, n in counts.rows(least):
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(1, pa.int64()), pa.nulls(1, id_type), *[pa.nulls(1, pa.int64())] * 3, pa.nulls(1, pa.string()),
                    pa.nulls(1, pa.binary()), pa.array([p], longs), pa.array([n], longs)], names=names)

        for b in batches:
            id_type = b.column("_id").type
            for part, texts in _slices(b):
                x, n = align(texts), len(texts)
                counts.add(x.pair)
                ends = np.searchsorted(x.doc.to_numpy(), np.arange(n), side="right")
                pair = x.pair.to_numpy()
                links = [codec.compress(pair[s:e].tobytes(), asbytes=True) if e > s else None for s, e in zip([0, *ends[:-1]], ends)]
                sha = [hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for k, g in zip(x.n_groups, x.groups)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(row + np.arange(n)), part.column("_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.n_groups),
                    pa.array(sha), pa.array(links, pa.binary()), pa.nulls(n, longs), pa.nulls(n, longs)], names=names)
                row += n
                yield from held(HELD)
        yield from held(0)

    path = scratch_path(docs.sparkSession, "links")
    (slim.mapInArrow(run, f"_row long, _id {kind}, _na long, _nb long, _groups long, _sha string, _links binary, "
                          "_pairs array<long>, _counts array<long>").write.parquet(path))
    return docs.sparkSession.read.parquet(path)


def merged_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): the corpus-wide links of each id pair, and whether they are its
    B id's most.  A window's group holds the A ids of one B id: A's vocabulary at most."""
    n = (links.where("_row is null").select(F.explode(F.arrays_zip("_pairs", "_counts")).alias("x"))
         .groupBy(F.col("x._pairs").alias("pair")).agg(F.sum("x._counts").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    return n.withColumn("_b", b).select("pair", "n", (F.col("n") == F.max("n").over(Window.partitionBy("_b"))).alias("best"))


def pair_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                piece_bpe: str = PIECE_BPE) -> DataFrame:
    """(a, b, n, best) over the corpus: how often the A and the B id overlap."""
    return merged_counts(write_links(docs, id_col, text_col, byte_bpe, piece_bpe)).select(
        F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", "best")


def _looked_up(rows: DataFrame, counts: pa.Table) -> DataFrame:
    """rows with _best and _sum: over a document's links, those that are their B id's
    most, and the sum of their counts, as far as ``counts`` has them."""
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast(tuple(counts[c].to_numpy() for c in ("pair", "n", "best")))
    columns = [c for c in rows.columns if c != "_links"]

    def run(batches):
        pair, n, best = shared.value
        key, n, best = pa.array(pair), pa.array(np.append(n, 0)), pa.array(np.append(best, False).astype(np.int64))
        codec = pa.Codec("zstd")

        def of(part, raw):
            lens = np.array([len(r) // 8 for r in raw])
            at = pc.fill_null(pc.index_in(pa.array(np.frombuffer(b"".join(raw), np.int64)), value_set=key), len(pair))
            sums = (pa.table({"doc": np.repeat(np.arange(len(raw)), lens), "best": best.take(at), "sum": n.take(at)})
                    .group_by("doc", use_threads=False).aggregate([("best", "sum"), ("sum", "sum")]))
            out = np.zeros((2, len(raw)), np.int64)
            out[:, sums["doc"].to_numpy()] = sums["best_sum"].to_numpy(), sums["sum_sum"].to_numpy()
            return pa.RecordBatch.from_arrays([*[part.column(c) for c in columns], *map(pa.array, out)], names=[*columns, "_best", "_sum"])

        for b in batches:
            links, a, raw, size = b.column("_links"), 0, [], 0
            left = b.column("_na").to_numpy() + b.column("_nb").to_numpy() - b.column("_groups").to_numpy()
            for k, (x, m) in enumerate(zip(links, left)):
                raw.append(codec.decompress(x.as_buffer(), int(m) * 8, asbytes=True) if m else b"")
                size += m
                if size > SLICE or k == b.num_rows - 1:
                    yield of(b.slice(a, k + 1 - a), raw)
                    a, raw, size = k + 1, [], 0

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    return rows.mapInArrow(run, f"{fields}, _best long, _sum long")


def alignment_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_bpe: str = BYTE_BPE,
                      piece_bpe: str = PIECE_BPE, pairs_per_pass: int = 4_000_000) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    links = write_links(docs, id_col, text_col, byte_bpe, piece_bpe)
    counts = cut_lineage(merged_counts(links))
    passes = max(1, -(-counts.count() // pairs_per_pass))
    rows = links.where("_row is not null").select("_row", "_id", "_na", "_nb", "_groups", "_sha", "_links")
    if passes == 1:
        out = _looked_up(rows, counts.toArrow())
    else:
        slim, sums = rows.select("_row", "_na", "_nb", "_groups", "_links"), None
        for k in range(passes):
            part = counts.where(F.pmod(F.xxhash64("pair"), F.lit(passes)) == k).toArrow()
            one = cut_lineage(_looked_up(slim, part).select("_row", "_best", "_sum"))
            sums = one if sums is None else sums.union(one)
        out = rows.join(sums.groupBy("_row").agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum")), "_row")
    return out.select(F.col("_id").alias(id_col), F.col("_na").alias("n_a"), F.col("_nb").alias("n_b"),
                      F.col("_groups").alias("n_groups"), (F.col("_na") + F.col("_nb") - F.col("_groups")).alias("n_links"),
                      F.col("_best").alias("n_best"), F.col("_sum").alias("count_sum"), F.col("_sha").alias("groups_sha256"))
