"""Quality classifier: a factorisation machine over hashed words, structure
statistics and metadata.

Features of a document
  words      every distinct lower-cased word, hashed; value 4/sqrt(distinct), 1 at most
  structure  binned statistics of the whole text (shares of symbols, digits,
             capitals, blanks; word lengths; repeated words and lines; stray
             separators), one slot per (statistic, bin), value 1
  metadata   the columns in ``meta`` (numbers by power of two, others by value)

Labels, language, source and id are never features.  The low-rank pair terms
let, say, "many symbols" weigh differently with "long words" than alone.

Edge cases: a null or empty text has its empty-text slot only and is scored like
any other; a null metadata value is its own slot; an empty label table (or one
class) gives the base rate (0.5 without labels) to every document; repeated
rows are scored alike; ids are passed through, null ids included (held_out
false).  Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.fm import FMConfig, fit_sample, labelled_sample, score_documents
from stratum.llm.terms import Terms, distinct, lowered

CONFIG = FMConfig(additive=2048, epochs=6, rate=0.1, l2_pair=0.5, pair_rate=1.0)
HELD_OUT_OF, HELD_OUT = 4, 2
#: byte classes: 0 letter or part of one, 1 capital, 2 digit, 3 blank, 4 line end, 5 stop, 6 comma, 7 other symbol
_CLASS = np.zeros(256, np.uint8)
_CLASS[:128] = 7
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[32, 9, 13]], _CLASS[10], _CLASS[46], _CLASS[44] = 3, 4, 5, 6
#: symbols counted on their own
_SYMBOLS = np.zeros(256, np.uint8)
for _k, _c in enumerate("|!#%&*$<>{}=/@;:\"'-_()[]", 1):
    _SYMBOLS[ord(_c)] = _k


def held_out(col):
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % HELD_OUT_OF == HELD_OUT, F.lit(False))


def _share(a, b) -> int:
    return min(20, int(20 * a / b)) if b else 0


def _log(x) -> int:
    return int(math.log2(x + 1))


def structure(text: str, raw: np.ndarray, words: int, distinct: int, word_bytes: int) -> list[str]:
    """Binned statistics of a whole text as feature names."""
    n = len(raw)
    if n == 0:
        return ["empty"]
    c = np.bincount(_CLASS[raw], minlength=8)
    sym = np.bincount(_SYMBOLS[raw], minlength=25)
    lines = [x for x in text.split("\n") if x.strip()]
    return [f"symbols={_share(c[7] * 2, n)}", f"digits={_share(c[2] * 2, n)}", f"upper={_share(c[1], c[0] + c[1])}",
            f"blank={_share(c[3] + c[4], n)}", f"wordlen={min(15, word_bytes // words) if words else 0}",
            f"words={_log(words)}", f"bytes={_log(n)}", f"distinct={_share(distinct, words)}",
            f"lines={_log(len(lines))}", f"lineuniq={_share(len(set(lines)), len(lines))}",
            f"linelen={_log(n // max(1, len(lines)))}", f"stops={_log(c[5] * 1000 // n)}",
            f"commas={_log(c[6] * 1000 // n)}",
            *[f"sym{k}={_log(int(sym[k]) * 1000 // n)}" for k in np.flatnonzero(sym[1:]) + 1]]


def meta_name(k: int, x) -> str:
    if x is None:
        return f"m{k}:null"
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        return f"m{k}:{'-' if x < 0 else ''}{_log(abs(x))}" if math.isfinite(x) else f"m{k}:odd"
    return f"m{k}:={x}"


def make_featurizer(bits: int = CONFIG.bits):
    terms, known = Terms(bits), {}

    def slot(name: str) -> int:
        if name not in known:
            if len(known) > 50_000:
                known.clear()
            known[name] = terms.name(name)
        return known[name]

    def featurize(text, meta):
        text = text or ""
        s, e, full, _ = terms.words(lowered(text))
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        slots = distinct(full)
        names = structure(text, raw, len(full), len(slots), int((e - s).sum()))
        fixed = np.array(sorted({slot(x) for x in names + [meta_name(k, x) for k, x in enumerate(meta)]}), np.int32)
        slots = slots[fixed[np.searchsorted(fixed, slots).clip(0, len(fixed) - 1)] != slots]
        val = np.ones(len(fixed) + len(slots), np.float32)
        val[len(fixed):] = 4.0 / math.sqrt(max(16, len(slots)))
        return np.concatenate([fixed, slots]), val

    return featurize


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                  text_col: str = "text", meta: tuple[str, ...] = ("n_chars",), cfg: FMConfig = CONFIG,
                  threshold: float = 0.7) -> DataFrame:
    """Per document: id, held_out, score (probability of label 1), predicted."""
    meta = [c for c in meta if c in docs.columns]
    bits = cfg.bits
    make = lambda: make_featurizer(bits)
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, meta, cfg, lambda c: ~held_out(c))
    model = fit_sample(sample, make, cfg, [f"_m{k}" for k in range(len(meta))])
    out = score_documents(docs, model, make, meta, id_col, text_col)
    return out.select(id_col, held_out(F.col(f"`{id_col}`")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
