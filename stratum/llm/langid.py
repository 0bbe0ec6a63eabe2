"""Language identification with bit-sliced Bloom filters of character n-grams.

Learning counts the letter trigrams (lower case, one blank around each word) of
all documents that may be learned from; the ``top`` most frequent trigrams of a
language are its set.  All sets share one filter: ``slots`` bit masks with a bit
for each language, each trigram written at ``hashes`` slots.  The AND of a
trigram's masks names all languages whose set holds it.

A document's trigrams give one popcount for each language.  A filter with fill
rate f answers wrongly with probability f**hashes, so the count is corrected to
(hits - n * p) / (1 - p); the largest wins, ties go to the language with more
documents learned, then by name.  The score is that corrected count over n.

Counts cover every document allowed; what reaches the driver is ``top`` rows
for each language (more than ``max_languages`` distinct labels are refused: such
a column holds no languages).  Prediction is one map.

How much of a running text the ``top`` trigrams cover depends on the language's
alphabet, so ``keep_identified`` measures it: each document learned from is scored
with its own language's set, without the trigrams that no other document gave
(its count is theirs).  The language's low mark is the share that all but
``LOW`` of its learned trigrams stand in documents of.

Edge cases: null texts and texts without a letter are ``und`` with score 0, as
is everything when nothing could be learned; null labels are not learned from;
null ids are not held out; repeated rows count again.  Extra columns are unread.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNDETERMINED = "und"
LOW, _BINS = 0.01, 4096
_CHUNK = 1 << 22
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9),
        np.uint64(0x27D4EB2F165667C5), np.uint64(0x85EBCA77C2B2AE63))


def held_out(col, of: int = 5, which: int = 0):
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % of == which, F.lit(False))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Is this code point a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Packed trigrams (three code points of 21 bits), empty if there is no letter."""
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[cp]
    if not letter.any():
        return np.empty(0, np.uint64)
    c = np.full(len(cp) + 2, 32, np.uint64)
    c[1:-1] = np.where(letter, cp, 32)
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c, blank = c[keep], blank[keep]
    grams = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    return grams[~blank[1:-1]]


def count_trigrams(docs: DataFrame) -> DataFrame:
    """docs (_lang, _text) -> (_lang, _gram, _n), summed up as far as one task goes."""
    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n)],
                                                 names=["_lang", "_gram", "_n"])

        for b in batches:
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist()):
                g = trigrams(text)
                if len(g):
                    held.setdefault(lang, []).append(g)
                    size += len(g)
                if size >= _CHUNK:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return docs.mapInArrow(run, "_lang string, _gram long, _n long")


class Filter:
    """Masks of shape (words, slots): 64 languages to a word."""

    def __init__(self, langs: list[str], masks: np.ndarray, hashes: int):
        self.langs, self.masks, self.hashes = langs, masks, hashes
        self.shift = np.uint64(64 - (masks.shape[1].bit_length() - 1))
        fill = np.array([((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(langs))])
        self.wrong = fill ** hashes if len(langs) else fill

    @classmethod
    def build(cls, langs: list[str], grams: dict[str, np.ndarray], slots: int, hashes: int) -> Filter:
        masks = np.zeros(((len(langs) + 63) // 64, slots), np.uint64)
        f = cls(langs, masks, hashes)
        for k, lang in enumerate(langs):
            for h in range(hashes):
                masks[k // 64, f._slot(grams[lang], h)] |= np.uint64(1) << np.uint64(k % 64)
        return cls(langs, masks, hashes)

    def _slot(self, grams: np.ndarray, h: int) -> np.ndarray:
        x = grams * _MIX[h]
        x ^= x >> np.uint64(29)
        return (x * _MIX[(h + 1) % len(_MIX)]) >> self.shift

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and number of trigrams."""
        g = trigrams(text)
        if not len(g) or not self.langs:
            return UNDETERMINED, 0.0, len(g)
        at = [self._slot(g, h) for h in range(self.hashes)]
        hits = []
        for word in self.masks:
            found = word[at[0]]
            for a in at[1:]:
                found &= word[a]
            left = len(self.langs) - len(hits)
            hits += [int(np.count_nonzero(found & (np.uint64(1) << np.uint64(k)))) for k in range(min(64, left))]
        share = np.maximum((np.array(hits) / len(g) - self.wrong) / np.maximum(1 - self.wrong, 1e-9), 0)
        best = int(np.argmax(share))  # the first of equals: langs stand in the order of ties
        return self.langs[best], float(min(1.0, share[best])), len(g)


def _known(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.col(f"`{lang_col}`").cast("string").alias("_lang"),
                       F.col(f"`{text_col}`").cast("string").alias("_text")).where("_lang IS NOT NULL")


def learn(docs: DataFrame, text_col: str, lang_col: str, top: int, slots: int, hashes: int,
          max_languages: int) -> tuple[Filter, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The filter, and each language's set as sorted trigrams with their counts."""
    known = _known(docs, text_col, lang_col)
    counts = known.groupBy("_lang").agg(F.count(F.lit(1)).alias("_docs")).orderBy(F.desc("_docs"), "_lang").limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} distinct values in {lang_col}")
    langs = [r["_lang"] for r in counts]
    w = Window.partitionBy("_lang").orderBy(F.desc("_n"), "_gram")  # rows: a language's distinct trigrams
    rows = (count_trigrams(known).groupBy("_lang", "_gram").agg(F.sum("_n").alias("_n"))
            .withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= top).select("_lang", "_gram", "_n").collect())
    grams: dict[str, list[tuple[int, int]]] = {x: [] for x in langs}
    for r in rows:
        grams[r["_lang"]].append((r["_gram"], r["_n"]))
    langs = [x for x in langs if grams[x]]
    sets = {x: tuple(np.array(v, np.int64) for v in zip(*sorted(grams[x]))) for x in langs}
    return Filter.build(langs, {x: sets[x][0].view(np.uint64) for x in langs}, slots, hashes), sets


def low_marks(docs: DataFrame, sets: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict[str, float]:
    """docs (_lang, _text) -> per language its low mark, from shares in steps of 1/``_BINS``."""
    shared = docs.sparkSession.sparkContext.broadcast(sets)

    def run(batches):
        held = {}
        for b in batches:
            for lang, text in zip(b.column("_lang").to_pylist(), b.column("_text").to_pylist()):
                g = trigrams(text)
                if len(g) and lang in shared.value:
                    grams, total = shared.value[lang]
                    own, n = np.unique(g.view(np.int64), return_counts=True)
                    at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
                    share = n[(grams[at] == own) & (total[at] > n)].sum() / len(g)
                    key = lang, int(share * _BINS)
                    held[key] = held.get(key, 0) + len(g)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([s for _, s in held], pa.int64()),
                                          pa.array(list(held.values()), pa.int64())], names=["_lang", "_share", "_n"])

    steps = docs.mapInArrow(run, "_lang string, _share long, _n long").groupBy("_lang", "_share").agg(F.sum("_n").alias("_n"))
    w = Window.partitionBy("_lang")  # rows: a language's steps
    t = steps.select("_lang", "_share", F.sum("_n").over(w.orderBy("_share")).alias("_to"), F.sum("_n").over(w).alias("_all"))
    low = t.where(F.col("_to") > LOW * F.col("_all")).groupBy("_lang").agg(F.min("_share").alias("_low"))
    return {r["_lang"]: r["_low"] / _BINS for r in low.collect()}


def _predict(docs: DataFrame, carry: list[str], text_col: str, lang_col: str, id_col: str, top: int, slots: int,
             hashes: int, max_languages: int, marks: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """The columns ``carry`` as _c0, _c1, ... (so that no name can clash) with _lang, _score
    and _n (trigrams); the languages' low marks, if asked for."""
    seen = docs.where(~held_out(F.col(f"`{id_col}`")))
    f, sets = learn(seen, text_col, lang_col, top, slots, hashes, max_languages)
    low = low_marks(_known(seen, text_col, lang_col), sets) if marks and sets else {}
    shared = docs.sparkSession.sparkContext.broadcast((f.langs, f.masks, f.hashes))
    names = [f"_c{k}" for k in range(len(carry))]
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])
    text = f"_c{carry.index(text_col)}" if text_col in carry and dict(docs.dtypes)[text_col] == "string" else "_text"
    if text == "_text":
        slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)],
                           F.col(f"`{text_col}`").cast("string").alias("_text"))

    def run(batches):
        own = Filter(*shared.value)
        for b in batches:
            for a in range(0, b.num_rows, 512):
                part = b.slice(a, 512)
                got = [own.predict(t) for t in part.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array([x for x, _, _ in got], pa.string()),
                                                  pa.array([s for _, s, _ in got], pa.float64()),
                                                  pa.array([n for _, _, n in got], pa.int64())], names=[*names, "_lang", "_score", "_n"])

    kinds = "".join(f"{c} {slim.schema[c].dataType.simpleString()}, " for c in names)
    return slim.mapInArrow(run, f"{kinds}_lang string, _score double, _n long"), low


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             top: int = 400, slots: int = 1 << 16, hashes: int = 3, max_languages: int = 1024) -> DataFrame:
    """Per document: id, held_out, lang_pred, score."""
    out, _ = _predict(docs, [id_col], text_col, lang_col, id_col, top, slots, hashes, max_languages)
    return out.select(F.col("_c0").alias(id_col), held_out(F.col("_c0")).alias("held_out"),
                      F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.2, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang", top: int = 400, slots: int = 1 << 16, hashes: int = 3,
                    max_languages: int = 1024) -> DataFrame:
    """``docs`` without those that are no text in a known language: ``und``, or with a
    share of trigrams in the best language's set far below what its own documents have.
    Far below is half its low mark, ``min_score`` at most; a short text must miss that by
    two standard deviations of a count, so one of few trigrams is not judged by chance."""
    out, low = _predict(docs, docs.columns, text_col, lang_col, id_col, top, slots, hashes, max_languages, marks=True)
    floors = {x: min(min_score, s / 2) for x, s in low.items()}
    floor = F.lit(0.0)
    if floors:
        floor = F.coalesce(F.create_map(*[F.lit(v) for pair in floors.items() for v in pair])[F.col("_lang")], floor)
    want = F.col("_n") * floor
    return (out.where((F.col("_lang") != UNDETERMINED) & (F.col("_score") * F.col("_n") >= want - 2 * F.sqrt(want)))
            .select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)]))
