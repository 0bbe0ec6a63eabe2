"""Exact k-nearest neighbours (self-join kNN) by a metric index, without an all-pairs join.

1. *cells*: pivots are sampled by hash, every point goes to the cell of its nearest
   pivot; members of cells that are too full become pivots as well, round after
   round, until no cell holds more than a stated number of points.  A cell has a
   count and the least and largest distance of its points to the pivot.
2. *radius*: the k-th distance among a point's own cell, or the nearest whole cells
   that hold k others for sure, is an upper bound R of its true k-th distance.
3. *pruning*: with d its distance to a pivot, a point looks into a cell only if the
   ball of radius R meets the cell's ring (triangle inequality) and reaches over the
   plane between the cell's pivot and its own; inside a cell it is compared only
   with points whose pivot distance differs from d by R at most.
4. *exact*: an equi-join on the cell; candidates are ranked by (distance, id).

The pivots are the only thing broadcast; their number is bounded by ``MAX_PIVOTS``
(cells grow with the data beyond).  All bounds are a little wider than rounding,
squared distances are summed in a fixed feature order, so results are bit-identical
to a brute-force reference.  How much is pruned depends on the data: in 64
dimensions of independent noise no bound can prune (``index_report`` tells).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.exprs import merge_one_row
from stratum.functions.hashing import hash_uniform


def _d2(feats, a="q_", b="p_"):
    return sum((F.pow(F.col(f"{a}{f}") - F.col(f"{b}{f}"), 2) for f in feats[1:]),
               F.pow(F.col(f"{a}{feats[0]}") - F.col(f"{b}{feats[0]}"), 2))


def _top_k(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q_id").orderBy("dist2", "p_id")
    return pairs.withColumn("nn_rank", F.row_number().over(w) - 1).where(F.col("nn_rank") < k)


COPY_CHUNK = 1_000_000  # rows per salted sort task inside one group of identical points


def knn(points: DataFrame, key: str, feats: list[str], k: int, cell: int = 64) -> DataFrame:
    """(query id ``q_id``, neighbour rank ``nn_rank`` 0..k-1, neighbour id ``nn_id``,
    squared distance ``dist2``) for every point against all other points; ties by id.

    Groups of identical points (possibly a third of all rows) are not compared
    pairwise: within a group of m ≥ k+2 copies only the k+1 smallest ids
    ("heads") take part in the index — any other copy is dominated by
    them in (distance, id) order — and every other copy's neighbours are the
    first k heads of its group at distance 0.  The heads are found with
    per-group salting (each sort task ≤ ``COPY_CHUNK`` rows) and a merge of
    (k+1)·salts candidates per group."""
    pts = points.select(key, *[F.col(f).cast("double").alias(f) for f in feats]).persist()
    # partial aggregation: a hot group of copies is combined map-side
    big = pts.groupBy(*feats).agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= k + 2)
    tagged = pts.join(big, feats, "left")
    bigpts = tagged.where(F.col("_m").isNotNull())
    salts = F.ceil(F.col("_m") / F.lit(COPY_CHUNK))
    sal = bigpts.withColumn("_s", F.floor(hash_uniform(key, 0, "copy") * salts))
    first = sal.withColumn("_r1", F.row_number().over(Window.partitionBy(*feats, "_s").orderBy(key))) \
        .where(F.col("_r1") <= k + 1)
    heads_big = first.withColumn("_r2", F.row_number().over(Window.partitionBy(*feats).orderBy(key))) \
        .where(F.col("_r2") <= k + 1).select(key, *feats, "_r2").persist()
    heads = tagged.where(F.col("_m").isNull()).select(key, *feats).unionByName(heads_big.select(key, *feats))
    nn_heads = _pivot_knn(heads, key, feats, k, cell)
    rest = bigpts.select(key, *feats).join(heads_big.select(key), key, "left_anti")
    nn_rest = rest.join(heads_big.where(F.col("_r2") <= k).select(F.col(key).alias("nn_id"), *feats, "_r2"), feats) \
        .select(F.col(key).alias("q_id"), (F.col("_r2") - 1).cast("int").alias("nn_rank"), "nn_id",
                F.lit(0.0).alias("dist2"))
    return nn_heads.unionByName(nn_rest)


MAX_PIVOTS = 16_384  # pivots held by the driver and each task (x features doubles)


def _cells(points: DataFrame, key: str, feats: list[str], cell: int, max_pivots: int) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(points with _cell and _r, pivots, cells): every point in the cell of its nearest
    pivot, no cell above ``cell`` points (or 4 n / ``max_pivots``, if that is more).

    The first pivots are the points with the smallest hashes; in rounds, members of
    cells that are still too full become pivots too, chosen by hash with the chance
    that leaves about a quarter of the limit to each.  cells: (_cell, _n, _lo, _hi)."""
    n = points.count()
    full = max(cell, -(-4 * n // max_pivots))
    u = hash_uniform(key, 0, "pivot")
    first = points.select(*feats).orderBy(u, key).limit(max(1, min(max_pivots, 4 * n // full))).collect()
    pivots = np.array([tuple(r) for r in first], np.float64).reshape(-1, len(feats))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)

    def assign(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(Grouped(pivots))

        def run(batches):
            for b in batches:
                near, r = shared.value.nearest(_matrix(b, feats))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near), pa.array(r)], names=[*b.schema.names, "_cell", "_r"])

        return rows.mapInArrow(run, f"{schema}, _cell long, _r double")

    for turn in range(1, 40):
        dealt = assign(points, pivots).persist()
        cells = dealt.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_lo"), F.max("_r").alias("_hi"))
        sizes = cells.collect()  # at most one row for each pivot
        over = [(r["_cell"], min(1.0, 4.0 / full + 1.0 / r["_n"])) for r in sizes if r["_n"] > full and r["_hi"] > 0]
        if not over or len(pivots) >= 2 * max_pivots:
            break
        much = F.broadcast(points.sparkSession.createDataFrame(over, "_cell long, _p double"))
        more = dealt.join(much, "_cell").where((hash_uniform(key, turn, "pivot") < F.col("_p")) & (F.col("_r") > 0)).select(*feats).collect()
        dealt.unpersist()
        if more:
            pivots = np.unique(np.vstack([pivots, np.array([tuple(r) for r in more], np.float64)]), axis=0)
    return dealt, pivots, points.sparkSession.createDataFrame([tuple(r) for r in sizes] or [], "_cell long, _n long, _lo double, _hi double")


def _matrix(b, feats: list[str]) -> np.ndarray:
    return np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in feats]).astype(np.float64)


def _steps(n: int, width: int):
    """Slices of rows whose distance table stays small."""
    step = max(1, (1 << 21) // max(1, width))
    return [slice(a, a + step) for a in range(0, n, step)]


class Grouped:
    """Pivots in about sqrt(their number) groups, each around one of them: a ball is held
    against a group (triangle inequality) before its pivots are looked at."""

    def __init__(self, p: np.ndarray, reach: np.ndarray | None = None):
        """``reach``: how far a pivot's points lie from it (default: only the pivots count)."""
        self.p, n = p, max(1, round(len(p) ** 0.5))
        self.centers = p[np.linspace(0, len(p) - 1, min(n, len(p))).round().astype(int)] if len(p) else p
        near = np.concatenate([_distances(p[at], self.centers).argmin(axis=1) for at in _steps(len(p), n)]) if len(p) else np.empty(0, int)
        self.members = [np.flatnonzero(near == g) for g in range(len(self.centers))]
        far = _distances_by_row(p, self.centers[near]) + (0.0 if reach is None else reach) if len(p) else np.empty(0)
        self.radius = np.array([far[m].max(initial=0.0) for m in self.members])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, distance) of each row's nearest pivot.  A missing value is no distance: such a
        pivot takes all rows, such a row goes to the first pivot, both at distance NaN."""
        near, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
        holes, lost = np.isnan(x).any(axis=1), np.isnan(self.p).any(axis=1)
        if lost.any():
            near[:], best[:] = lost.argmax(), np.nan
        else:
            for at in _steps(len(x), len(self.centers)) if len(self.p) else []:
                self._nearest(x[at], near[at], best[at])
        near[holes], best[holes] = 0, np.nan
        return near, best

    def _nearest(self, x, near, best):
        d = _distances(x, self.centers)
        first = d.argmin(axis=1)
        for turn in (0, 1):  # the nearest group, then all that may hold a nearer one
            for g, m in enumerate(self.members):
                rows = np.flatnonzero(first == g if turn == 0 else (first != g) & ((d[:, g] - self.radius[g]) <= best * (1 + _SLACK) + _SLACK * d[:, g]))
                for at in _steps(len(rows), len(m)) if len(m) else []:
                    r = rows[at]
                    to = _distances(x[r], self.p[m])
                    k = to.argmin(axis=1)
                    v = to[np.arange(len(r)), k]
                    nearer = v < best[r]
                    near[r[nearer]], best[r[nearer]] = m[k[nearer]], v[nearer]

    def reached(self, x: np.ndarray, r: np.ndarray):
        """(rows, pivots, their distances) for the groups that rows' balls of radius ``r`` reach."""
        for at in _steps(len(x), len(self.centers)):
            d = _distances(x[at], self.centers)
            for g, m in enumerate(self.members):
                rows = np.flatnonzero(~(d[:, g] - r[at] > self.radius[g] * (1 + _SLACK) + _SLACK * d[:, g]))
                for part in _steps(len(rows), len(m)) if len(m) else []:
                    k = rows[part]
                    yield at.start + k, m, _distances(x[at.start + k], self.p[m])


def _distances_by_row(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(sum(((a[:, f] - b[:, f]) ** 2 for f in range(a.shape[1])), np.zeros(len(a))))


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots from differences: right in all but the last digits, near or far."""
    d = np.zeros((len(x), len(p)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - p[None, :, f]) ** 2
    return np.sqrt(d)


_SLACK = 1e-9


def _candidates(points: DataFrame, key: str, feats: list[str], k: int, cell: int, max_pivots: int):
    """(pairs of point and cell to look into with q_* columns, _cell, _r2 and _dq; points by cell with p_* columns)."""
    dealt, pivots, cells = _cells(points, key, feats, cell, max_pivots)
    table = {r["_cell"]: (r["_n"], r["_lo"], r["_hi"]) for r in cells.collect()}
    number = np.array(sorted(table), np.int64)
    stats = np.array([table[c] for c in number], np.float64).reshape(-1, 3)
    held = pivots[number] if len(number) else pivots
    shared = points.sparkSession.sparkContext.broadcast((Grouped(held, stats[:, 2] if len(number) else None), number, stats))
    P = dealt.select(F.col(key).alias("p_id"), *[F.col(f).alias(f"p_{f}") for f in feats], "_cell", F.col("_r").alias("_dp"))
    Q = dealt.select(F.col(key).alias("q_id"), *[F.col(f).alias(f"q_{f}") for f in feats], "_cell", F.col("_r").alias("_home_d"))

    # the k-th distance inside the own cell bounds that of all
    own = Q.join(P, "_cell").where("p_id <> q_id").select("q_id", "p_id", _d2(feats).alias("dist2"))
    own = _top_k(own, k).groupBy("q_id").agg(F.count(F.lit(1)).alias("_c"), F.max("dist2").alias("_m"))
    bound = own.select("q_id", F.when(F.col("_c") >= k, F.col("_m")).alias("_own"))
    ready = Q.withColumnRenamed("_cell", "_home").join(bound, "q_id", "left")
    names = [f"q_{f}" for f in feats]
    kept = ["q_id", *names]
    schema = ", ".join(f"`{c}` {ready.schema[c].dataType.simpleString()}" for c in kept)

    def whole_cells(x, p, n, hi):
        """A radius that holds k others for sure: whole cells, nearest far side first."""
        out = np.full(len(x), np.inf)
        if n.sum() < k + 1:
            return out
        for at in _steps(len(x), len(p)):
            far = (_distances(x[at], p) + hi[None, :]) * (1 + _SLACK)
            few = min(k + 1, len(p))  # no cell is empty
            order = np.argpartition(far, few - 1, axis=1)[:, :few]
            order = np.take_along_axis(order, np.take_along_axis(far, order, 1).argsort(axis=1), 1)
            enough = (np.cumsum(n[order], axis=1) >= k + 1).argmax(axis=1)
            out[at] = np.take_along_axis(far, np.take_along_axis(order, enough[:, None], 1), 1)[:, 0]
        return out

    def look(batches):
        groups, number, stats = shared.value
        p, (n, lo, hi) = groups.p, stats.T
        for b in batches:
            x = _matrix(b, names)
            r = np.sqrt(b.column("_own").to_numpy(zero_copy_only=False).astype(np.float64))
            open_ = np.flatnonzero(~np.isfinite(r))
            r[open_] = whole_cells(x[open_], p, n, hi)
            r *= 1 + _SLACK
            first = np.searchsorted(number, b.column("_home").to_numpy())
            home = b.column("_home_d").to_numpy()
            for rows, m, d in groups.reached(x, r):
                rr, eps = r[rows, None], _SLACK * (d + hi[None, m])
                i, j = np.nonzero((d - rr <= hi[None, m] + eps) & (d + rr >= lo[None, m] - eps))
                q, c, d = rows[i], m[j], d[i, j]
                # a cell's points are nearer to its pivot than to the point's own: the plane between
                gap = _distances_by_row(p[first[q]], p[c])
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = np.where(gap > 0, (d - home[q]) * (d + home[q]) / (2 * gap) - _SLACK * (d + home[q]) ** 2 / gap, 0.0)
                hit = plane <= r[q]
                part = b.select(kept).take(pa.array(q[hit]))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number[c[hit]]), pa.array(r[q[hit]] ** 2), pa.array(d[hit])],
                                                 names=[*kept, "_cell", "_r2", "_dq"])

    return ready.mapInArrow(look, f"{schema}, _cell long, _r2 double, _dq double"), P


def _pairs(points: DataFrame, key: str, feats: list[str], k: int, cell: int, max_pivots: int) -> DataFrame:
    """All pairs that the index leaves to be compared, with their exact squared distance."""
    look, P = _candidates(points, key, feats, k, cell, max_pivots)
    j = look.join(P, "_cell").where(f"p_id <> q_id AND abs(_dq - _dp) <= sqrt(_r2) + {_SLACK} * (_dq + _dp)")
    return j.select("q_id", "p_id", "_r2", _d2(feats).alias("dist2"))


def _pivot_knn(points: DataFrame, key: str, feats: list[str], k: int, cell: int = 64, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """Exact kNN over points with at most k+1 copies of any point."""
    points = points.select(key, *feats).persist()
    res = _top_k(_pairs(points, key, feats, k, cell, max_pivots), k)
    return res.select("q_id", F.col("nn_rank").cast("int").alias("nn_rank"), F.col("p_id").alias("nn_id"), "dist2")


def index_report(points: DataFrame, key: str, feats: list[str], k: int, cell: int = 64, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """One row: points, cells, largest_cell, candidates (mean per point that are compared
    beyond the own cell's bound), most_candidates."""
    points = points.select(key, *[F.col(f).cast("double").alias(f) for f in feats]).na.drop().persist()
    _, _, cells = _cells(points, key, feats, cell, max_pivots)
    c = cells.agg(F.sum("_n").alias("points"), F.count(F.lit(1)).alias("cells"), F.max("_n").alias("largest_cell"))
    per = _pairs(points, key, feats, k, cell, max_pivots).groupBy("q_id").agg(F.count(F.lit(1)).alias("c"))
    per = per.agg(F.avg("c").alias("candidates"), F.max("c").alias("most_candidates"))
    return merge_one_row(c, per)
