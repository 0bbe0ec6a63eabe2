"""Viterbi decoding of sequences of any length (a key may hold a third of all
rows) by the associative max-plus formulation.

With V_0 = e_start (log-space: 0 for the start row, −inf elsewhere) and
M_t[i][j] = log T[i][j] + log E[j](o_t), the Viterbi scores are
V_T = V_0 ⊗ M_1 ⊗ … ⊗ M_T in the (max, +) semiring, and ⊗ is associative:

1. events are range-partitioned on (key, order…) and sorted within partitions
   (a hot key spans many partitions) and the layout is checkpointed;
2. a run of one key that lies inside one partition and has ``SEGMENT`` events at
   most is decoded where it is, with the others of its batch; no shuffle;
3. other runs (longer ones, and the first and last of each partition, which may go
   on in the next) are cut into segments of ``SEGMENT`` events; a segment is reduced
   to its transfer matrix, a partition's segments of a key to theirs;
4. scores are passed through in order, first over a key's partitions, then over
   the segments inside each: the scores with which each segment begins;
5. every segment, from those, gets the back-pointers of the sequential recursion,
   hence for each possible exit state its path and its entry state;
6. entry states are followed backwards in the same two steps, which fixes each
   segment's exit state.

A task holds one Arrow batch and one segment at a time; a group of step 4 or 6 holds
one row per segment of a key in a partition, or one per partition.  Ties go to the
lexicographically largest state; in runs of step 3 scores that are equal but for
rounding may count as different.  A null key is a key; events that are equal in
``order`` are taken in the order of their symbols.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import form as FX
from stratum.session import cut_lineage

#: events of a segment: what a task holds beside a batch, and the steps of its recursion
SEGMENT = 4096
_PID = 33  # a segment's number is its partition's, shifted, plus its first row's position there


def _runs(t: pa.Table, by: str) -> np.ndarray:
    """Start positions of the runs of equal values (nulls and NaNs are equal) of ``by``."""
    if not t.num_rows:
        return np.zeros(0, int)
    codes = t.column(by).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])


def _whole(batches, by: str):
    """Tables that end where a run of ``by`` ends, with the starts of their runs."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        starts = _runs(t, by)
        if len(starts):
            held = t.slice(starts[-1])
            if len(starts) > 1:
                yield t.slice(0, starts[-1]), starts[:-1]
    if held is not None and held.num_rows:
        yield held, np.zeros(1, int)


def _reduce(m: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Max-plus product of each run's matrices, halving all runs at once."""
    while True:
        start = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        place = np.arange(len(run)) - np.repeat(start, np.diff(np.r_[start, len(run)]))
        if not place.any():
            return m
        first = np.flatnonzero(place % 2 == 0)
        pair = np.flatnonzero(place % 2 == 1)
        out = m[first].copy()
        at = np.searchsorted(first, pair - 1)
        out[at] = np.max(m[pair - 1][:, :, :, None] + m[pair][:, None, :, :], axis=2)
        m, run = out, run[first]


def _segments(starts: np.ndarray, enter: np.ndarray, emit: np.ndarray, lt: np.ndarray):
    """(state per event and exit state, entry state and score per segment and exit state)."""
    n, total = lt.shape[0], len(emit)
    lens = np.diff(np.r_[starts, total])
    by = np.argsort(-lens, kind="stable")  # active segments are always a prefix
    starts, lens, v = starts[by], lens[by], enter[by].copy()
    back = np.zeros((total, n), np.int8)
    active = np.searchsorted(-lens, -np.arange(1, lens[0] + 1), side="right") if len(lens) else []
    for t, a in enumerate(active):
        cand = v[:a, :, None] + lt[None]
        at = starts[:a] + t
        back[at] = cand.argmax(axis=1)
        v[:a] = cand.max(axis=1) + emit[at]
    path = np.zeros((total, n), np.int8)
    now = np.tile(np.arange(n), (len(starts), 1))
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = starts[:a] + t
        path[at] = now[:a]
        now[:a] = np.take_along_axis(back[at], now[:a], axis=1)
    entry = np.empty_like(now)
    entry[by] = now
    score = np.empty_like(v)
    score[by] = v
    return path, entry, score


def _scan(pdf: pd.DataFrame, by: str, u: np.ndarray, n: int):
    """Rows in the order of ``by``, the scores in front of each row's matrix, and those behind the last."""
    pdf = pdf.sort_values(by)
    seen = []
    for m in pdf[[f"m{i}" for i in range(n * n)]].to_numpy().reshape(-1, n, n):
        seen.append(u)
        u = np.max(u[:, None] + m, axis=0)
    return pdf, pd.DataFrame(np.array(seen), columns=[f"u{i}" for i in range(n)]), u


def _follow(pdf: pd.DataFrame, by: str, at: int, n: int) -> tuple[pd.DataFrame, list[int]]:
    """Rows from the last to the first, and each row's exit state, if the last one's is ``at``."""
    pdf = pdf.sort_values(by, ascending=False)
    exits = []
    for row in pdf[[f"_e{j}" for j in range(n)]].to_numpy():
        exits.append(at)
        at = int(row[at])
    return pdf, exits


def viterbi_states(obs: DataFrame, key: str, order: list[str], symbol: str, states=FX.STATES, trans=FX.TRANSITIONS,
                   emis=None, initial_from: str = "Low", unknown: float = FX.UNKNOWN_EMISSION,
                   n_partitions: int | None = None, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(key, order…, state) with one row per event, and (key, log_prob, n_obs) with one per key."""
    from stratum.operators.scoring import EVENT_EMISSIONS

    emis = emis or EVENT_EMISSIONS
    names = sorted(states, reverse=True)  # argmax takes the first of equals: the largest name
    n = len(names)
    lt = np.array([[math.log(trans[a][b]) for b in names] for a in names])
    le = {s: {o: math.log(p) for o, p in emis[s].items()} for s in names}
    lunk, start = math.log(unknown), names.index(initial_from)
    begin = np.where(np.arange(n) == start, 0.0, -np.inf)

    def emissions(symbols: pa.ChunkedArray):
        d = symbols.combine_chunks().dictionary_encode(null_encoding="encode")
        table = np.array([[le[s].get(str(o), lunk) for s in names] for o in d.dictionary.to_pylist()]).reshape(-1, n)
        return table[d.indices.to_numpy(zero_copy_only=False)]

    parts = n_partitions or int(obs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ev = cut_lineage(obs.select(key, *order, symbol).repartitionByRange(parts, key, *order)
                     .sortWithinPartitions(key, *order, symbol).withColumn("_pid", F.spark_partition_id().cast("long")))

    def shape(*cols):
        return ", ".join(f"{c} {ev.schema[c].dataType.simpleString()}" for c in cols)

    mcols, ucols = [f"m{i}" for i in range(n * n)], [f"u{i}" for i in range(n)]
    ccols, ecols = [f"_c{j}" for j in range(n)], [f"_e{j}" for j in range(n)]

    def short(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """Whole sequences, decoded; the last event of each carries its score and length."""
        path, _, score = _segments(starts, np.tile(begin, (len(starts), 1)), emissions(t.column(symbol)), lt)
        lens = np.diff(np.r_[starts, t.num_rows])
        state = path[np.arange(t.num_rows), np.repeat(score.argmax(axis=1), lens)]
        prob, count = np.full(t.num_rows, np.nan), np.zeros(t.num_rows, np.int64)
        prob[starts + lens - 1], count[starts + lens - 1] = score.max(axis=1), lens
        return batch(t, pa.nulls(t.num_rows, pa.int64()), pa.array(state, pa.int32()),
                     pa.array(prob, from_pandas=True), pa.array(count))

    def batch(t: pa.Table, seg, state=None, prob=None, count=None) -> pa.RecordBatch:
        none = t.num_rows
        cols = [*[t.column(c).combine_chunks() for c in (key, *order, symbol)], seg,
                pa.nulls(none, pa.int32()) if state is None else state,
                pa.nulls(none, pa.float64()) if prob is None else prob, pa.array(np.zeros(none, np.int64)) if count is None else count]
        return pa.RecordBatch.from_arrays(cols, names=[key, *order, symbol, "_seg", "_state", "log_prob", "n_obs"])

    def place(batches):
        """Short runs decoded, long ones with the number of the segment that each event is in."""
        held = None       # rows of the open run, if it is not known to be long
        last = None       # the last row seen, if it belongs to a long run
        at = run = 0      # positions in the partition: of the next row to emit, of the open long run's first row

        def long(t):
            nonlocal at
            pos = at + np.arange(t.num_rows)
            at += t.num_rows
            pid = t.column("_pid")[0].as_py()
            return batch(t, pa.array((pid << _PID) + run + (pos - run) // segment * segment))

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if last is not None or at == 0 and held is None:
                # a long run goes on, or the partition's first run begins
                ends = _runs(t if last is None else pa.concat_tables([last, t]), key)
                ends = ends - (last is not None)
                end = int(ends[1]) if len(ends) > 1 else t.num_rows
                if end:
                    yield long(t.slice(0, end))
                last = t.slice(t.num_rows - 1) if end == t.num_rows else None
                t = t.slice(end)
                if not t.num_rows:
                    continue
            t = t if held is None else pa.concat_tables([held, t])
            starts = _runs(t, key)
            size = np.diff(np.r_[starts, t.num_rows])
            held = t.slice(starts[-1])
            # whole runs, short ones together, between the long ones
            begun = 0
            for k in [*np.flatnonzero(size[:-1] > segment), len(starts) - 1]:
                if k > begun:
                    yield short(t.slice(starts[begun], starts[k] - starts[begun]), starts[begun:k] - starts[begun])
                    at += int(starts[k] - starts[begun])
                if k < len(starts) - 1:
                    run = at
                    yield long(t.slice(starts[k], size[k]))
                begun = k + 1
            if held.num_rows > segment:
                run, last = at, held.slice(held.num_rows - 1)
                yield long(held)
                held = None
        if held is not None and held.num_rows:  # the last run may go on in the next partition
            run = at
            yield long(held)

    ev = cut_lineage(ev.mapInArrow(place, f"{shape(key, *order, symbol)}, _seg long, _state int, log_prob double, n_obs long"))

    def named(i):
        return F.element_at(F.array(*[F.lit(s) for s in names]), i + 1)

    done = ev.where("_seg IS NULL")
    done, scores = (done.select(key, *order, named(F.col("_state")).alias("state")),
                    done.where("n_obs > 0").select(key, "log_prob", "n_obs"))

    # ---- runs of more than a segment, or at a partition's ends
    open_ = ev.where("_seg IS NOT NULL").select(key, *order, symbol, "_seg")
    open_ = open_.withColumn("_g", F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n")))

    def transfer(batches):
        for t, starts in _whole(batches, "_seg"):
            lens = np.diff(np.r_[starts, t.num_rows])
            m = _reduce(lt[None] + emissions(t.column(symbol))[:, None, :], np.repeat(np.arange(len(starts)), lens)).reshape(-1, n * n)
            heads = t.select(["_g", "_seg"]).take(pa.array(starts))
            yield pa.RecordBatch.from_arrays([heads.column(0).combine_chunks(), heads.column(1).combine_chunks(), pa.array(lens),
                                              *[pa.array(m[:, i]) for i in range(n * n)]], names=["_g", "_seg", "_n", *mcols])

    def doubles(cols):
        return ", ".join(f"{c} double" for c in cols)

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.sort_values("_seg")[mcols].to_numpy().reshape(-1, n, n)
        one = _reduce(m, np.zeros(len(m), int))[0].ravel()
        return pd.DataFrame([[pdf["_g"].iloc[0], pdf["_pid"].iloc[0], int(pdf["_n"].sum()), *one]], columns=["_g", "_pid", "_n", *mcols])

    def over_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, u, v = _scan(pdf, "_pid", begin, n)
        return u.assign(_g=pdf["_g"].to_numpy(), _pid=pdf["_pid"].to_numpy(), _last=int(np.argmax(v)), log_prob=float(np.max(v)),
                        n_obs=int(pdf["_n"].sum()))

    def over_segments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, u, _ = _scan(pdf, "_seg", pdf[ucols].to_numpy()[0], n)
        return u.assign(_g=pdf["_g"].to_numpy(), _seg=pdf["_seg"].to_numpy())

    segs = cut_lineage(open_.mapInArrow(transfer, f"_g string, _seg long, _n long, {doubles(mcols)}")
                       .withColumn("_pid", F.shiftright("_seg", _PID)))
    plan = cut_lineage(segs.groupBy("_g", "_pid").applyInPandas(product, f"_g string, _pid long, _n long, {doubles(mcols)}")
                       .groupBy("_g").applyInPandas(over_parts, f"_g string, _pid long, {doubles(ucols)}, _last int, log_prob double, n_obs long"))
    enter = (segs.join(plan.select("_g", "_pid", *ucols), ["_g", "_pid"]).groupBy("_g", "_pid")
             .applyInPandas(over_segments, f"_g string, _seg long, {doubles(ucols)}"))
    met = open_.join(enter, ["_g", "_seg"]).repartition(parts, "_seg").sortWithinPartitions("_seg", *order, symbol)

    def decode(batches):
        for t, starts in _whole(batches, "_seg"):
            u = np.stack([t.column(c).to_numpy() for c in ucols], axis=1)[starts]
            path, entry, _ = _segments(starts, u, emissions(t.column(symbol)), lt)
            first = np.full((t.num_rows, n), -1)
            first[starts] = entry
            yield pa.RecordBatch.from_arrays(
                [*[t.column(c).combine_chunks() for c in (key, *order, "_g", "_seg")],
                 *[pa.array(x[:, j], pa.int32()) for x in (path, first) for j in range(n)]], names=[key, *order, "_g", "_seg", *ccols, *ecols])

    paths = cut_lineage(met.mapInArrow(decode, f"{shape(key, *order)}, _g string, _seg long, " + ", ".join(f"{c} int" for c in ccols + ecols)))
    heads = paths.where(F.col(ecols[0]) >= 0).select(key, "_g", "_seg", *ecols).withColumn("_pid", F.shiftright("_seg", _PID))

    def through(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = [_follow(pdf, "_seg", j, n) for j in range(n)]
        return pd.DataFrame([[pdf["_g"].iloc[0], pdf["_pid"].iloc[0], *[int(p[ecols[x[-1]]].iloc[-1]) for p, x in ends]]],
                            columns=["_g", "_pid", *ecols])

    def leave_parts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, exits = _follow(pdf, "_pid", int(pdf["_last"].iloc[0]), n)
        return pd.DataFrame({"_g": pdf["_g"], "_pid": pdf["_pid"], "_end": exits})

    def leave_segments(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, exits = _follow(pdf, "_seg", int(pdf["_end"].iloc[0]), n)
        return pd.DataFrame({"_g": pdf["_g"], "_seg": pdf["_seg"], "_exit": exits})

    maps = heads.drop(key).groupBy("_g", "_pid").applyInPandas(through, "_g string, _pid long, " + ", ".join(f"{c} int" for c in ecols))
    ends = maps.join(plan.select("_g", "_pid", "_last"), ["_g", "_pid"]).groupBy("_g").applyInPandas(leave_parts, "_g string, _pid long, _end int")
    exits = heads.drop(key).join(ends, ["_g", "_pid"]).groupBy("_g", "_pid").applyInPandas(leave_segments, "_g string, _seg long, _exit int")
    far = (paths.join(exits, ["_g", "_seg"])
           .select(key, *order, named(F.element_at(F.array(*ccols), F.col("_exit") + 1)).alias("state")))
    firsts = heads.groupBy("_g").agg(F.first(key).alias(key))
    far_scores = (plan.groupBy("_g").agg(F.first("log_prob").alias("log_prob"), F.first("n_obs").alias("n_obs"))
                  .join(firsts, "_g").select(key, "log_prob", "n_obs"))
    return done.unionByName(far), scores.unionByName(far_scores)
