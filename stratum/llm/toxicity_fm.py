"""Toxicity: a factorisation machine over hashed terms.

Terms are the distinct lower-cased words of the whole text and their leading
``PREFIXES`` bytes, so that an inflected insult shares a term with its stem.
The rank-k factors learn which terms are toxic together (an insult and whom it
is aimed at) although neither is alone.  A term's value is 1 up to ``FLAT``
distinct terms and falls with the fourth root beyond, so that one insult in a
very long text keeps its weight while the pair term, quadratic in the values,
stays bounded.

Edge cases are those of ``quality_fm``: null and empty texts hold no term and
get the intercept's score; without labels (or with one class) everything gets
the base rate.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.fm import FMConfig, fit_sample, labelled_sample, score_documents
from stratum.llm.quality_fm import held_out
from stratum.llm.terms import Terms, distinct, lowered

CONFIG = FMConfig(additive=1024, epochs=6, rate=0.1, l2_pair=1.0, pair_rate=0.3)
FLAT = 16
PREFIXES = (4, 5, 6, 7, 9)


def make_featurizer(bits: int = CONFIG.bits):
    terms = Terms(bits, PREFIXES)

    def featurize(text, meta):
        _, _, full, cut = terms.words(lowered(text or ""))
        slots = distinct(np.concatenate([full, *cut]))
        return slots, np.full(len(slots), min(1.0, (FLAT / max(1, len(slots))) ** 0.25), np.float32)

    return featurize


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                   text_col: str = "text", cfg: FMConfig = CONFIG, threshold: float = 0.3) -> DataFrame:
    """Per document: id, held_out, score (probability of label 1), predicted."""
    bits = cfg.bits
    make = lambda: make_featurizer(bits)
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, [], cfg, lambda c: ~held_out(c))
    model = fit_sample(sample, make, cfg, [])
    out = score_documents(docs, model, make, [], id_col, text_col)
    return out.select(id_col, held_out(F.col(f"`{id_col}`")).alias("held_out"), "score",
                      (F.col("score") >= threshold).cast("int").alias("predicted"))
