"""Second-order factorisation machine on hashed sparse features.

    score(x) = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pair term is never enumerated.  With s_f = sum_i v_if x_i it equals
``0.5 * sum_f (s_f**2 - sum_i (v_if x_i)**2)`` (Rendle 2010), so a document with
m features costs O(m * rank).

Fitting is bounded by ``fit_rows`` labelled rows: those with the smallest hashes
of their id, one row for each id, so the choice does not depend on partitioning.
Executors count in how many rows of each class a slot occurs.  Every slot of at
least ``min_rows`` rows gets factors, whether or not it tells the classes apart
alone, so that a pair of terms can be learned whose terms are neutral; additive
weights are for the ``additive`` slots with the largest chi-square only (a term
that is independent of the label has nothing to add alone, and thousands of such
weights fit noise).  The sample's features (bounded) are then fitted by one task
with mini-batch Adagrad.  Scoring is one map over the documents; no text but the
bounded sample's is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.session import cut_lineage

#: (text or None, metadata values) -> distinct slots (int32), their values (float32)
Featurizer = Callable[[str | None, tuple], tuple[np.ndarray, np.ndarray]]
_SAMPLE_TASKS = 16


@dataclass(frozen=True)
class FMConfig:
    bits: int = 18          # 2**bits hashed slots
    additive: int = 1024    # slots with additive weights
    rank: int = 8           # factors per slot
    fit_rows: int = 16_000  # bound on the labelled rows used for fitting
    epochs: int = 6
    batch: int = 64
    rate: float = 0.1
    l2: float = 1e-4
    l2_pair: float = 1.0
    spread: float = 0.01    # standard deviation of the factors at the start
    pair_rate: float = 0.3  # learning rate of the factors, as a share of ``rate``
    min_rows: int = 5       # rows of the sample that a slot with factors occurs in
    seed: int = 7


class FM:
    """w0, w, v over the kept slots; ``where`` maps a slot to its row in w and v (0: none)."""

    def __init__(self, where: np.ndarray, w0: float, w: np.ndarray, v: np.ndarray):
        self.where, self.w0, self.w, self.v = where, w0, w, v

    @staticmethod
    def raw(w0, w, v, starts, idx, val):
        """Margins of the rows that begin at ``starts`` (no row is empty)."""
        vx = v[idx] * val[:, None]
        s = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), starts)
        linear = np.add.reduceat(w[idx] * val, starts)
        return w0 + linear + 0.5 * (np.einsum("ij,ij->i", s, s) - squares), vx, s

    def predict(self, lens, idx, val) -> np.ndarray:
        z, _, _ = self.raw(self.w0, self.w, self.v, np.cumsum(lens) - lens, idx, val)
        return 1.0 / (1.0 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def choose_slots(n0: np.ndarray, n1: np.ndarray, rows0: int, rows1: int, cfg: FMConfig) -> tuple[np.ndarray, np.ndarray]:
    """(slot -> 1.. for slots of at least ``min_rows`` rows, 0 for the rest; of those
    numbers, which have additive weights)."""
    where = np.zeros(1 << cfg.bits, np.int32)
    n, total = (n0 + n1).astype(float), rows0 + rows1
    if not (rows0 and rows1):
        return where, np.zeros(1, bool)
    has = np.flatnonzero(n >= cfg.min_rows)
    where[has] = np.arange(1, len(has) + 1)
    n, n1 = n[has], n1[has]
    chi = (n1 - n * rows1 / total) ** 2 * total / np.maximum(n * (total - n), 1.0)
    additive = np.zeros(len(has) + 1, bool)
    additive[1 + np.argsort(-chi, kind="stable")[:cfg.additive]] = True
    return where, additive


def compact(where: np.ndarray, idx: np.ndarray, val: np.ndarray):
    """Kept features of a row; entry 0 (no parameters) stands in front so that none is empty."""
    at = where[idx]
    has = at > 0
    return (np.concatenate([np.zeros(1, np.int32), at[has]]),
            np.concatenate([np.zeros(1, np.float32), val[has]]))


def fit(where: np.ndarray, lens, idx, val, y, cfg: FMConfig, additive: np.ndarray) -> FM:
    """Mini-batch Adagrad on the logistic loss; deterministic for equal input."""
    rng = np.random.default_rng(cfg.seed)
    size = int(where.max(initial=0)) + 1
    w = np.zeros(size, np.float32)
    v = (rng.standard_normal((size, cfg.rank)) * cfg.spread).astype(np.float32)
    v[0] = 0
    base = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    w0 = float(np.log(base / (1 - base)))
    if len(y) == 0 or y.min() == y.max():
        return FM(where, w0, w, v * 0)
    gw, gv = np.full(size, 1e-2, np.float32), np.full((size, cfg.rank), 1e-2, np.float32)
    ends = np.cumsum(lens)
    begins = ends - lens
    for _ in range(cfg.epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), cfg.batch):
            pick = order[a:a + cfg.batch]
            take = np.concatenate([np.arange(begins[r], ends[r]) for r in pick])
            i, x, n = idx[take], val[take], lens[pick]
            z, vx, s = FM.raw(w0, w, v, np.cumsum(n) - n, i, x)
            g = ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y[pick]).astype(np.float32)
            gx = np.repeat(g, n) * x
            by = np.argsort(i, kind="stable")
            slots, first = np.unique(i[by], return_index=True)
            dw = np.add.reduceat(gx[by], first) + cfg.l2 * w[slots]
            dv = np.add.reduceat((gx[:, None] * (np.repeat(s, n, axis=0) - vx))[by], first, axis=0) + cfg.l2_pair * v[slots]
            dw *= additive[slots]
            gw[slots] += dw * dw
            gv[slots] += dv * dv
            w[slots] -= cfg.rate * dw / np.sqrt(gw[slots])
            v[slots] -= cfg.pair_rate * cfg.rate * dv / np.sqrt(gv[slots])
            w0 -= 0.05 * cfg.rate * float(g.mean())
    return FM(where, w0, w, v)


def _rows(batch: pa.RecordBatch, meta: list[str]):
    metas = list(zip(*[batch.column(c).to_pylist() for c in meta])) if meta else [()] * batch.num_rows
    return zip(batch.column("_text").to_pylist(), metas)


def _pieces(batches, rows: int = 256):
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)


def fit_sample(sample: DataFrame, make: Callable[[], Featurizer], cfg: FMConfig, meta: list[str]) -> FM:
    """``sample``: _text, _label (0/1), _order and the ``meta`` columns, at most cfg.fit_rows rows."""
    sample = cut_lineage(sample.select("_text", "_label", "_order", *meta).repartition(_SAMPLE_TASKS, "_order"))
    sc = sample.sparkSession.sparkContext

    def count(batches):
        f, n = make(), np.zeros((2, 1 << cfg.bits), np.int32)
        rows = [0, 0]
        for b in _pieces(batches):
            for (text, m), y in zip(_rows(b, meta), b.column("_label").to_pylist()):
                n[y, f(text, m)[0]] += 1
                rows[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()]), pa.array([rows[0]]), pa.array([rows[1]])],
                                         names=["n", "r0", "r1"])

    n, r0, r1 = np.zeros((2, 1 << cfg.bits), np.int64), 0, 0
    for row in sample.mapInArrow(count, "n binary, r0 long, r1 long").toLocalIterator():  # <= _SAMPLE_TASKS rows
        n, r0, r1 = n + np.frombuffer(row["n"], np.int32).reshape(2, -1), r0 + row["r0"], r1 + row["r1"]
    where, additive = choose_slots(n[0], n[1], r0, r1, cfg)
    shared, has_weight = sc.broadcast(where), sc.broadcast(additive)

    def features(batches):
        f = make()
        for b in _pieces(batches):
            got = [compact(shared.value, *f(text, m)) for text, m in _rows(b, meta)]
            yield pa.RecordBatch.from_arrays([
                b.column("_order"), b.column("_label").cast(pa.int32()),
                pa.array([i.astype("<i4").tobytes() for i, _ in got], pa.binary()),
                pa.array([x.astype("<f4").tobytes() for _, x in got], pa.binary())],
                names=["_order", "_label", "_idx", "_val"])

    def train(batches):
        rows = sorted((o, i, x, y) for b in batches for o, i, x, y in zip(
            *[b.column(c).to_pylist() for c in ("_order", "_idx", "_val", "_label")]))
        idx = [np.frombuffer(r[1], "<i4") for r in rows]
        lens = np.array([len(i) for i in idx], np.int64)
        m = fit(shared.value, lens, np.concatenate(idx) if rows else np.empty(0, np.int32),
                np.concatenate([np.frombuffer(r[2], "<f4") for r in rows]) if rows else np.empty(0, np.float32),
                np.array([r[3] for r in rows], np.float32), cfg, has_weight.value)
        yield pa.RecordBatch.from_arrays([pa.array([m.w0]), pa.array([m.w.tobytes()]), pa.array([m.v.tobytes()])],
                                         names=["w0", "w", "v"])

    got = (sample.mapInArrow(features, "_order long, _label int, _idx binary, _val binary")
           .repartition(1).mapInArrow(train, "w0 double, w binary, v binary").collect())
    if not got:  # an empty sample may have no partition at all
        return fit(where, *[np.empty(0, np.float32)] * 4, cfg, additive)
    one = got[0]
    return FM(where, one["w0"], np.frombuffer(one["w"], np.float32),
              np.frombuffer(one["v"], np.float32).reshape(-1, cfg.rank))


def score_documents(docs: DataFrame, model: FM, make: Callable[[], Featurizer], meta: list[str],
                    id_col: str, text_col: str) -> DataFrame:
    """(id, score): one map over the documents."""
    shared = docs.sparkSession.sparkContext.broadcast((model.where, model.w0, model.w, model.v))
    names = [f"_m{k}" for k in range(len(meta))]
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"),
                       *[F.col(f"`{c}`").alias(n) for c, n in zip(meta, names)])

    def run(batches):
        m, f = FM(*shared.value), make()
        for b in _pieces(batches):
            got = [compact(m.where, *f(text, x)) for text, x in _rows(b, names)]
            lens = np.array([len(i) for i, _ in got], np.int64)
            p = m.predict(lens, np.concatenate([i for i, _ in got]), np.concatenate([x for _, x in got]))
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(p)], names=["_id", "score"])

    kind = slim.schema["_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"_id {kind}, score double").withColumnRenamed("_id", id_col)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str,
                    meta: list[str], cfg: FMConfig, learn_from) -> DataFrame:
    """At most cfg.fit_rows labelled documents with the smallest hash of their id.

    Ids are chosen on the slim label table alone; the chosen ids (bounded by
    fit_rows, hence broadcast) then pick their texts in one scan.  Labels other
    than 0/1 and rows without an id are ignored; of several label rows of one id
    the larger label counts, of several documents the smallest text.
    """
    ids = (labels.select(F.col(f"`{id_col}`").alias("_lid"), F.col(f"`{label_col}`").cast("int").alias("_label"))
           .where(F.col("_lid").isNotNull() & F.col("_label").isin(0, 1))
           .where(learn_from(F.col("_lid")))
           .groupBy("_lid").agg(F.max("_label").alias("_label"))
           .withColumn("_order", F.xxhash64(F.col("_lid").cast("string")))
           .orderBy("_order", "_lid").limit(cfg.fit_rows))
    slim = docs.select(F.col(f"`{id_col}`").alias("_lid"), F.col(f"`{text_col}`").cast("string").alias("_text"),
                       *[F.col(f"`{c}`").alias(f"_m{k}") for k, c in enumerate(meta)])
    metas = [f"_m{k}" for k in range(len(meta))]
    one = slim.join(F.broadcast(ids), "_lid").groupBy("_lid", "_label", "_order").agg(F.min(F.struct("_text", *metas)).alias("_d"))
    return one.select("_label", "_order", *[F.col(f"_d.{c}").alias(c) for c in ("_text", *metas)])
