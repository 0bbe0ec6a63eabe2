"""Histogram trees for many models at once: forests and second-order boosting.

Features are binned once (``bin_rows``).  A *model* is a set of row weights (a
training fold of a balanced set, say) with its own trees; all trees of all models
grow level by level together.  One pass over the binned rows sums, for every
(tree, open node, feature, bin), two statistics; the partial histograms of the
tasks are added up by node chunk and each chunk's best splits are chosen where
they meet.  Only the splits come to the driver (a few numbers per node), which
sends the grown trees out with the next pass.  So 200 forests take as many passes
as one, and every tree is a function of the row keys, the model's name and the
tree's number alone: many models grown together equal single fits exactly.

Statistics of a node are (weight, weight of class 1) for forests, whose gain is the
decrease of the Gini impurity, and (sum of hessians, sum of gradients) for boosting,
whose gain is ``G_l^2/(H_l+l2) + G_r^2/(H_r+l2) - G^2/(H+l2)`` halved.  Rows with
missing values (null, NaN) have a bin of their own and go to the side that gains more.

Forest trees see a Poisson(1) bootstrap and ``sqrt(d)`` features per node, both by
hash.  ``nodes_per_pass`` bounds the histograms that a task holds; deeper levels of
large forests take several passes.

Rows that share all bins and the class are one *cell* to a tree (``cell_rows``): a cell
of n rows has the weight Poisson(n), the sum of its rows' draws.  Cells that fit one
task (``laid_out``: 200,000) are dealt to the tasks with a share of the trees, which
then grow to the end in one pass; more cells go level by level as above.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.session import cut_lineage

_PIECE = 64             # rows of a cell that share a Poisson draw
_CHUNK = 256            # nodes whose histograms are added up and split together
_CELLS = 1 << 20        # rows x trees handled at once
_DIRECT = 32 << 20      # bytes of partial histograms, over all tasks, that may go to the driver


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=None)
def _poisson_steps(n: int) -> np.ndarray:
    """Cumulative Poisson(n) probabilities of 0, 1, 2, ... as 32-bit thresholds."""
    p, total, out = math.exp(-n), 0.0, []
    for k in range(12 if n == 1 else n + 12 * math.isqrt(n) + 12):
        total += p
        p *= n / (k + 1)
        out.append(round(min(total, 1.0) * 2 ** 32) - 1)
    return np.array(out, np.int64)


def bootstrap_weights(h: np.ndarray, n: np.ndarray, names: np.ndarray) -> np.ndarray:
    """(cells, trees): Poisson(n) draws by the hashes of cells and the trees' names; a cell
    of more than ``_PIECE`` rows is the sum of draws for pieces of them."""
    out = np.zeros((len(h), len(names)))
    full, rest = n // _PIECE, n % _PIECE
    for turn in range(-1, int(full.max(initial=0))):
        size, salt = (rest, np.uint64(0)) if turn < 0 else (np.where(full > turn, _PIECE, 0), np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2 ** 64))
        for k in np.unique(size[size > 0]):
            at = np.flatnonzero(size == k)
            u = (_mix((h[at] + salt)[:, None] ^ names[None, :]) >> np.uint64(32)).astype(np.int64)
            out[at] += np.searchsorted(_poisson_steps(int(k)), u)
    return out


@dataclass
class Trees:
    """Nodes of all trees in the order they were opened; a tree's root is its number."""
    feature: np.ndarray     # -1: leaf or open
    bin: np.ndarray         # bins up to this one go left
    missing_left: np.ndarray
    left: np.ndarray        # the right child follows it
    stats: np.ndarray       # (nodes, 2)
    tree: np.ndarray
    path: np.ndarray        # hash of the way from the root

    @staticmethod
    def roots(n: int) -> Trees:
        return Trees(np.full(n, -1, np.int16), np.zeros(n, np.uint8), np.zeros(n, bool), np.zeros(n, np.int32), np.zeros((n, 2)),
                     np.arange(n, dtype=np.int32), np.ones(n, np.uint64))

    def ways(self) -> Trees:
        """What routing needs, to be sent out."""
        return Trees(self.feature, self.bin, self.missing_left, self.left, *[np.empty(0)] * 3)

    def route(self, bins: np.ndarray, trees: np.ndarray, missing: int) -> np.ndarray:
        """(rows, trees) -> the node that a row is in."""
        at = np.broadcast_to(trees.astype(np.int32), (len(bins), len(trees))).copy()
        row = np.arange(len(bins))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return at
            b = bins[row, np.maximum(f, 0)]
            right = np.where(b == missing, ~self.missing_left[at], b > self.bin[at])
            at = np.where(inner, self.left[at] + right, at).astype(np.int32)

    def grow(self, node, feature, bin_, missing_left, left_stats, right_stats):
        """Split ``node``; the children of node[i] are appended in order."""
        n = len(self.feature)
        self.feature[node], self.bin[node], self.missing_left[node] = feature, bin_, missing_left
        self.left[node] = n + 2 * np.arange(len(node))
        stats = np.empty((2 * len(node), 2))
        stats[0::2], stats[1::2] = left_stats, right_stats
        fresh = Trees.roots(2 * len(node))
        for name in ("feature", "bin", "missing_left", "left"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(fresh, name)]))
        self.stats = np.concatenate([self.stats, stats])
        self.tree = np.concatenate([self.tree, np.repeat(self.tree[node], 2)])
        self.path = np.concatenate([self.path, _mix(np.repeat(self.path[node], 2) * np.uint64(2) + np.tile(np.arange(2, dtype=np.uint64), len(node)))])
        return np.arange(n, len(self.feature))


# ------------------------------------------------------------------- binning

def bin_edges(rows: DataFrame, feats: list[str], bins: int = 32) -> list[np.ndarray]:
    """Per feature up to bins - 1 edges: its quantiles, each distinct value's own where
    there are few.  A value goes to the first edge that is not below it."""
    probs = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    x = [F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double")) for f in feats]
    got = rows.agg(*[F.percentile_approx(c, probs, 1_000_000).alias(f"q{i}") for i, c in enumerate(x)], *[F.max(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    out = []
    for i in range(len(feats)):
        e = np.unique(np.array(got[f"q{i}"] or [], np.float64))
        out.append(e[e < got[f"m{i}"]] if len(e) else e)
    return out


def bin_rows(rows: DataFrame, feats: list[str], edges: list[np.ndarray], key: str, keep: list[str], masks=None) -> DataFrame:
    """(_h, keep, _b, _w, _t): the row key's hash, a byte for each feature's bin (missing:
    255), and what ``masks(batch)`` says: a byte per model for training and for test rows
    (default: one model that trains on all)."""
    slim = rows.select(F.xxhash64(F.col(key).cast("string")).alias("_h"), *keep, *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(feats)])
    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in ["_h", *keep])

    def run(batches):
        for b in batches:
            x = np.column_stack([b.column(f"_f{i}").to_numpy(zero_copy_only=False).astype(np.float64) for i in range(len(edges))])
            code = np.column_stack([np.where(np.isnan(x[:, i]), MISSING, np.searchsorted(e, x[:, i])) for i, e in enumerate(edges)]).astype(np.uint8)
            both = masks(b) if masks else (np.ones((len(x), 1), np.uint8), np.zeros((len(x), 1), np.uint8))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ["_h", *keep]], *[pa.array([r.tobytes() for r in t], pa.binary()) for t in (code, *both)]],
                                             names=["_h", *keep, "_b", "_w", "_t"])

    return slim.mapInArrow(run, f"{fields}, _b binary, _w binary, _t binary")


MISSING = 255


def _bytes(column, dtype=np.uint8) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _per_model(column, n: int) -> np.ndarray:
    """(rows, models) of _w or _t: a byte or a 64-bit number for each model."""
    raw = _bytes(column)
    return raw if raw.shape[1] < 8 * n else np.ascontiguousarray(raw).view(np.int64)


def cell_rows(binned: DataFrame, by: list[str] | None = None, models=None) -> DataFrame:
    """(_h, by, _y, _b, _w, _t): the rows of ``bin_rows`` (kept: _y, ``by``) that share all bins, the class and ``by`` as
    one row.  ``models(batch)`` gives two 64-bit numbers per model, the rows for training
    and for test, from the columns _n (rows) and ``_k0``, ``_k1`` ...: how many of them
    have the first, second ... flag of the array _flags (default: one model that trains on all)."""
    return model_rows(cell_counts(binned, by), by, models)


def cell_counts(binned: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The cells of ``cell_rows`` with their counts alone: (_h, by, _y, _b, _n, _k0, _k1 ...)."""
    by, flagged = by or [], "_flags" in binned.columns
    n_flags = len(binned.select("_flags").first()[0]) if flagged and not binned.isEmpty() else 0
    t = binned.groupBy(*by, "_b", "_y").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_flags")[i]).alias(f"_k{i}") for i in range(n_flags)])
    return t.select(F.xxhash64(*by, "_b", "_y").alias("_h"), *by, "_y", "_b", "_n", *[f"_k{i}" for i in range(n_flags)])


def model_rows(t: DataFrame, by: list[str] | None = None, models=None) -> DataFrame:
    """Cells with what models take of them: the second half of ``cell_rows``."""
    by = by or []
    fields = ", ".join(f"`{c}` {t.schema[c].dataType.simpleString()}" for c in ["_h", *by, "_y", "_b"])

    def run(batches):
        for b in batches:
            both = models(b) if models else (b.column("_n").to_numpy()[:, None], np.zeros((b.num_rows, 1)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ["_h", *by, "_y", "_b"]],
                                              *[pa.array([r.tobytes() for r in x.astype(np.int64)], pa.binary()) for x in both]],
                                             names=["_h", *by, "_y", "_b", "_w", "_t"])

    return t.mapInArrow(run, f"{fields}, _w binary, _t binary")


# ------------------------------------------------------------------- growing

@dataclass
class Growth:
    """What a growing of trees needs; all arrays have an entry for each tree."""
    model: np.ndarray
    names: np.ndarray       # 64-bit names, for hashes
    depth: np.ndarray
    d: int
    per_node: int           # features tried in a node
    bins: int
    statistics: object      # (batch, rows, trees) -> the two statistics of (rows, trees)
    gain: object            # (left sums, totals) -> gain
    min_child: float = 1.0  # least first statistic of a child
    pure: bool = True       # a node of one class is not split
    layout: tuple[int, int] | None = None  # blocks and partitions of the rows


def layout(rows: DataFrame) -> tuple[int, int]:
    first = rows.select("_blocks").first()
    return (first[0] if first else 1), rows.rdd.getNumPartitions()


def tried(g: Growth, trees: Trees, node: np.ndarray) -> np.ndarray:
    """(nodes, per_node) features that a node tries, by the hash of its tree's name and its path."""
    if g.per_node >= g.d:
        return np.broadcast_to(np.arange(g.d), (len(node), g.d))
    h = _mix((g.names[trees.tree[node]] ^ trees.path[node])[:, None] + np.uint64(0x9E3779B97F4A7C15) * np.arange(1, g.d + 1, dtype=np.uint64))
    return np.sort(np.argsort(h, axis=1, kind="stable")[:, :g.per_node], axis=1)


def gini_gain(s: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Decrease of the weighted Gini impurity (halved) for left sums s and node totals."""
    def purity(x):
        n, n1 = x[..., 0], x[..., 1]
        return np.where(n > 0, (n1 * n1 + (n - n1) ** 2) / np.maximum(n, 1e-300), 0.0)
    return (purity(s) + purity(total - s) - purity(total)) / 2


def newton_gain(l2: float):
    def gain(s: np.ndarray, total: np.ndarray) -> np.ndarray:
        def score(x):
            return x[..., 1] ** 2 / np.maximum(x[..., 0] + l2, 1e-300)
        return (score(s) + score(total - s) - score(total)) / 2
    return gain


def best_splits(hist: np.ndarray, gain, min_child: float, min_gain: float = 1e-12):
    """hist (nodes, features, bins + 1, 2), missing last -> per node: slot, bin, missing_left,
    gain, left sums, totals.  slot -1: no split.  Ties go to the first slot and bin."""
    total = hist[:, 0].sum(axis=1)
    body, miss = np.cumsum(hist[:, :, :-1], axis=2)[:, :, :-1], hist[:, :, -1:]
    # (nodes, features, bins - 1, side, 2); without missing rows both sides are equal
    options = np.stack([body, body + miss], axis=-2) if miss.any() else body[..., None, :]
    t = total[:, None, None, None, :]
    value = np.where((options[..., 0] >= min_child) & ((t - options)[..., 0] >= min_child), gain(options, t), -np.inf)
    flat = value.reshape(len(hist), -1)
    if not flat.shape[1]:
        return np.full(len(hist), -1), *[np.zeros(len(hist), int)] * 2, np.zeros(len(hist)), total, total
    # equal gains may differ in their last bits
    top = flat.max(axis=1)
    best = (flat >= (top - 1e-9 * np.abs(top))[:, None]).argmax(axis=1)
    slot, bin_, side = np.unravel_index(best, value.shape[1:])
    n = np.arange(len(hist))
    return np.where(np.isfinite(top) & (top > min_gain), slot, -1), bin_, side.astype(bool), top, options[n, slot, bin_, side], total


def grow(rows: DataFrame, g: Growth, nodes_per_pass: int = 150_000) -> Trees:
    """rows as ``laid_out`` leaves them.  One pass per level and ``nodes_per_pass`` open nodes."""
    trees = Trees.roots(len(g.model))
    front, level = np.arange(len(g.model)), 0
    g.layout = g.layout or layout(rows)
    blocks = g.layout[0]
    while len(front):
        # chunks hold nodes of one block of trees
        front = front[np.argsort(trees.tree[front] % blocks, kind="stable")]
        grown = []
        for a in range(0, len(front), nodes_per_pass):
            part = front[a:a + nodes_per_pass]
            got, tries = _pass(rows, g, trees, part), tried(g, trees, part)
            trees.stats[part[got["at"]]] = got["total"]
            ok = got["slot"] >= 0
            at = got["at"][ok]
            grown.append((part[at], tries[at, got["slot"][ok]], got["bin"][ok], got["side"][ok], got["left"][ok], (got["total"] - got["left"])[ok]))
        split = [np.concatenate(x) for x in zip(*grown)]
        level += 1
        front = trees.grow(*split) if len(split[0]) else np.empty(0, int)
        s = trees.stats[front]
        open_ = (g.depth[trees.tree[front]] > level) & (s[:, 0] >= 2 * g.min_child)
        front = front[open_ & ((s[:, 1] > 0) & (s[:, 1] < s[:, 0]))] if g.pure else front[open_]
    return trees


_SUMS = ["at", "slot", "bin", "side", "l0", "l1", "t0", "t1"]


def _pass(rows: DataFrame, g: Growth, trees: Trees, part: np.ndarray) -> dict:
    """Best splits of the open nodes ``part``; ``at`` is the place in it."""
    order = np.full(len(trees.feature), -1, np.int32)
    order[part] = np.arange(len(part))
    own = np.unique(trees.tree[part])
    shared = rows.sparkSession.sparkContext.broadcast((trees.ways(), order, own, tried(g, trees, part), len(part)))
    width, slots = g.bins + 1, min(g.per_node, g.d)
    size = _CHUNK * slots * width * 2

    def sums(batches):
        t, order, own, tries, n_part = shared.value
        hist, codec = None, pa.Codec("zstd", compression_level=1)
        for b in batches:
            if hist is None:
                hist = np.zeros(n_part * slots * width * 2)
            code = _codes(b, g.bins)
            use, blocks = _per_model(b.column("_w"), int(g.model.max()) + 1), b.column("_blocks")[0].as_py()
            mine = own[own % blocks == b.column("_block")[0].as_py()]
            for m in np.unique(g.model[mine]):
                r, some = np.flatnonzero(use[:, m]), mine[g.model[mine] == m]
                step = max(1, _CELLS // max(1, len(r)))
                for a in range(0, len(some), step):
                    _add(hist, b, r, some[a:a + step], t, code[r], order, tries)
        for k in range(0 if hist is None else -(-n_part // _CHUNK)):
            piece = hist[k * size:(k + 1) * size]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([len(piece)]), pa.array([codec.compress(piece.tobytes(), asbytes=True)], pa.binary())],
                                                 names=["chunk", "size", "hist"])

    def _add(hist, b, r, some, t, code, order, tries):
        at = order[t.route(code, some, g.bins)]
        stat = g.statistics(b, r, some)
        i, c = np.nonzero((at >= 0) & (stat[0] != 0))
        if not len(i):
            return
        n = at[i, c].astype(np.int64)
        for s in range(slots):
            cell = ((n * slots + s) * width + code[i, tries[n, s]]) * 2
            lo = cell.min()
            for k in (0, 1):
                more = np.bincount(cell + k - lo, weights=stat[k][i, c])
                hist[lo:lo + len(more)] += more

    pieces, empty = rows.mapInArrow(sums, "chunk long, size long, hist binary"), {n: np.empty(0, np.int64) for n in _SUMS}
    if len(part) * slots * width * 16 * g.layout[1] <= _DIRECT:
        # the partial sums of all tasks are small, whatever they hold: added up by the driver
        t = pieces.toArrow().sort_by("chunk")
        got = [pa.table(b) for b in _merged(t.to_batches(), g, slots, width)]
    else:
        got = [pieces.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(
            lambda batches: _merged(batches, g, slots, width),
            "at long, slot long, bin long, side boolean, l0 double, l1 double, t0 double, t1 double").toArrow()]
    shared.destroy()
    c = {n: pa.concat_tables(got)[n].to_numpy() for n in _SUMS} if got else empty
    return {"at": c["at"], "slot": c["slot"], "bin": c["bin"], "side": c["side"],
            "left": np.column_stack([c["l0"], c["l1"]]), "total": np.column_stack([c["t0"], c["t1"]])}


def _merged(batches, g: Growth, slots: int, width: int):
    """Sums and best splits of chunks, whose partial histograms follow one another: one
    chunk's sums are held at a time."""
    def done(k, h):
        h = h.reshape(-1, slots, width, 2)
        slot, bin_, side, _, left, total = best_splits(h, g.gain, g.min_child)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (
            k * _CHUNK + np.arange(len(h)), slot.astype(np.int64), bin_.astype(np.int64), side.astype(bool), left[:, 0], left[:, 1], total[:, 0], total[:, 1])], names=_SUMS)

    now, acc, codec = None, None, pa.Codec("zstd")
    for b in batches:
        for k, n, raw in zip(b.column("chunk").to_pylist(), b.column("size").to_pylist(), b.column("hist").to_pylist()):
            h = np.frombuffer(codec.decompress(raw, n * 8, asbytes=True), np.float64)
            if k != now:
                if now is not None:
                    yield done(now, acc)
                now, acc = k, h.copy()
            else:
                acc += h
    if now is not None:
        yield done(now, acc)


def _codes(b, bins: int) -> np.ndarray:
    code = _bytes(b.column("_b"))
    return np.where(code == MISSING, bins, code)


def laid_out(rows: DataFrame, rows_per_task: int = 200_000, tasks: int | None = None) -> DataFrame:
    """Persisted binned rows, in as many partitions as they fill.  Few rows are laid out
    once per block of trees instead, so that every task has trees to grow: which task
    sums what changes no sum."""
    tasks = tasks or rows.sparkSession.sparkContext.defaultParallelism
    rows = rows.persist()
    parts = max(1, -(-rows.count() // rows_per_task))
    blocks = max(1, tasks // parts)
    out = rows.withColumn("_blocks", F.lit(blocks)).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a partition holds rows of one block, whatever their number
    out = out.repartitionById(blocks * parts, (F.col("_block") * parts + F.pmod("_h", F.lit(parts))).cast("int"))
    return out.sortWithinPartitions("_h").persist()


# ------------------------------------------------------------------- forests

def tree_names(models: list[str], trees: int) -> np.ndarray:
    """64-bit names from the model's name and the tree's number."""
    import zlib

    h = np.array([zlib.crc32(m.encode()) for m in models], np.uint64)
    return _mix(np.repeat(h << np.uint64(32), trees) + np.tile(np.arange(trees, dtype=np.uint64), len(models)))


def forest_growth(d: int, models: list[str], trees: int = 200, depth: int = 30, min_leaf: int = 1,
                  per_node: int | None = None, bins: int = 32, seed: int = 42) -> Growth:
    """Trees stand in the order (model, number)."""
    names = tree_names(models, trees) ^ np.uint64(seed)

    def statistics(b, r, some):  # some: trees of one model
        n = _per_model(b.column("_w"), len(models))[r, some[0] // trees].astype(np.int64)
        w = bootstrap_weights(b.column("_h").to_numpy().view(np.uint64)[r], n, names[some])
        return w, w * b.column("_y").to_numpy()[r, None]

    n = len(models) * trees
    return Growth(np.repeat(np.arange(len(models)), trees), names, np.full(n, depth), d, per_node or max(1, round(math.sqrt(d))),
                  bins, statistics, gini_gain, float(min_leaf))


def grow_forests(rows: DataFrame, d: int, models: list[str], trees: int = 200, depth: int = 30, min_leaf: int = 1,
                 per_node: int | None = None, bins: int = 32, seed: int = 42, nodes_per_pass: int = 150_000) -> Trees:
    """rows (``laid_out``) with _y 0/1 and _w, a byte or 64-bit number per model: how many of that
    model's training rows it stands for.  Trees stand in the order (model, number)."""
    g = forest_growth(d, models, trees, depth, min_leaf, per_node, bins, seed)
    g.layout = layout(rows)
    return grow_in_tasks(rows, g) if whole_blocks(g.layout) else grow(rows, g, nodes_per_pass)


def whole_blocks(placed: tuple[int, int]) -> bool:
    """Does every block of trees have all rows in one partition (``laid_out``)?"""
    return placed[1] <= placed[0]


_NODES = 1 << 14        # nodes whose histograms are held at once


def grow_here(code: np.ndarray, stat: tuple[np.ndarray, np.ndarray], g: Growth, some: np.ndarray) -> Trees:
    """The trees ``some`` on these rows alone: code (rows, features), the two statistics (rows,
    trees).  What ``grow`` makes of the same rows; roots are 0, 1, ... here."""
    g = replace(g, names=g.names[some], depth=g.depth[some])
    trees, slots, width = Trees.roots(len(some)), min(g.per_node, g.d), g.bins + 1
    row, node = np.nonzero(stat[0])
    s = [x[row, node].astype(np.float64) for x in stat]
    front, level = np.arange(len(some)), 0
    while len(front):
        order = np.full(len(trees.feature), -1, np.int64)
        order[front] = np.arange(len(front))
        p, tries, found = order[node], tried(g, trees, front), []
        if len(front) > _NODES:
            by = np.argsort(p, kind="stable")
            row, node, p, s = row[by], node[by], p[by], [x[by] for x in s]
        for a in range(0, len(front), _NODES):
            n = min(_NODES, len(front) - a)
            here = slice(None) if len(front) <= _NODES else slice(*np.searchsorted(p, [a, a + n]))
            q, r = p[here] - a, row[here]
            hist = np.zeros((2, n * slots * width))
            for slot in range(slots):
                cell = (q * slots + slot) * width + code[r, tries[a + q, slot]]
                for k in (0, 1):
                    hist[k] += np.bincount(cell, weights=s[k][here], minlength=hist.shape[1])
            found.append(best_splits(np.stack(hist, axis=-1).reshape(n, slots, width, 2), g.gain, g.min_child))
        slot, bin_, side, _, left, total = (np.concatenate(x) for x in zip(*found))
        trees.stats[front] = total
        at = np.flatnonzero(slot >= 0)
        level += 1
        parents = front[at]
        fresh = trees.grow(parents, tries[at, slot[at]], bin_[at], side[at], left[at], total[at] - left[at])
        st = trees.stats[fresh]
        open_ = (g.depth[trees.tree[fresh]] > level) & (st[:, 0] >= 2 * g.min_child)
        front = fresh[open_ & ((st[:, 1] > 0) & (st[:, 1] < st[:, 0]))] if g.pure else fresh[open_]
        # rows of nodes that are split go on to the child, if it is open
        on = np.zeros(len(trees.feature), bool)
        on[parents] = True
        k = np.flatnonzero(on[node])
        row, node, s = row[k], node[k], [x[k] for x in s]
        b = code[row, trees.feature[node]]
        node = trees.left[node] + np.where(b == g.bins, ~trees.missing_left[node], b > trees.bin[node])
        on[:] = False
        on[front] = True
        k = np.flatnonzero(on[node])
        row, node, s = row[k], node[k], [x[k] for x in s]
    return trees


def _blocks_grown(batches, g: Growth, mine):
    """(batch of a block's rows, its codes, trees, the trees grown) for the share of trees
    ``mine(block, blocks)``, as many at a time as ``_CELLS`` allows."""
    held: dict = {}
    for b in batches:
        held.setdefault(b.column("_block")[0].as_py(), []).append(b)
    for block, parts in held.items():
        b = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        code, use = _codes(b, g.bins), _per_model(b.column("_w"), int(g.model.max()) + 1)
        own = mine(block, b.column("_blocks")[0].as_py())
        for m in np.unique(g.model[own]):
            r, some = np.flatnonzero(use[:, m]), own[g.model[own] == m]
            for a in range(0, len(some), step := max(1, _CELLS // max(1, len(r)))):
                part = some[a:a + step]
                yield b, code, part, grow_here(code[r], g.statistics(b, r, part), g, part)


_TREES = {"ids": np.int64, "feature": np.int16, "bin": np.uint8, "missing_left": np.bool_, "left": np.int32, "stats": np.float64, "tree": np.int32}


def grow_in_tasks(rows: DataFrame, g: Growth) -> Trees:
    """Every task grows its block's trees to the end: one pass."""
    def run(batches):
        for _, _, some, t in _blocks_grown(batches, g, lambda block, blocks: np.arange(block, len(g.model), blocks)):
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(k).tobytes()], pa.binary()) for x, k in
                                              zip((some, t.feature, t.bin, t.missing_left, t.left, t.stats, some[t.tree]), _TREES.values())], names=list(_TREES))

    got = rows.mapInArrow(run, ", ".join(f"{n} binary" for n in _TREES)).toArrow().to_pylist()
    pieces = [{n: np.frombuffer(r[n], k) for n, k in _TREES.items()} for r in got]
    roots = len(g.model)
    out = Trees.roots(roots + sum(len(x["feature"]) - len(x["ids"]) for x in pieces))
    out.tree[roots:], at = 0, roots
    for x in pieces:
        n = len(x["ids"])
        number = np.concatenate([x["ids"], at + np.arange(len(x["feature"]) - n)])
        out.feature[number], out.bin[number], out.missing_left[number] = x["feature"], x["bin"], x["missing_left"]
        out.left[number] = np.where(x["feature"] >= 0, number[np.minimum(x["left"], len(number) - 1)], 0)
        out.stats[number], out.tree[number] = x["stats"].reshape(-1, 2), x["tree"]
        at += len(number) - n
    return out


def forest_hits(rows: DataFrame, d: int, models: list[str], trees: int = 200, depth: int = 30, bins: int = 32, seed: int = 42) -> np.ndarray:
    """(models, 2): test rows (_t) and those that a model's forest predicts right.  Where a block
    has all rows, whole models are dealt to the tasks, and no tree leaves its task."""
    g = forest_growth(d, models, trees, depth, bins=bins, seed=seed)
    g.layout = layout(rows)
    if not whole_blocks(g.layout):
        grown = grow(rows, g)
        return staged_accuracy(rows, grown, len(models), trees, [trees], class_share(grown.stats), bins=bins)[:, 0]

    def run(batches):
        now, p, out = None, None, np.zeros((len(models), 2))

        def score(b):
            test, y = _per_model(b.column("_t"), len(models))[:, now], b.column("_y").to_numpy()
            out[now] += test.sum(), test[(p / trees > 0.5) == y].sum()

        last = None
        for b, code, some, t in _blocks_grown(batches, g, lambda block, blocks: np.flatnonzero(g.model % blocks == block)):
            if g.model[some[0]] != now:
                if now is not None:
                    score(last)
                now, p = g.model[some[0]], np.zeros(len(code))
            last = b
            leaf, r = class_share(t.stats), np.flatnonzero(_per_model(b.column("_t"), len(models))[:, now])
            p[r] += leaf[t.route(code[r], np.arange(len(some)), bins)].sum(axis=1)
        if now is not None:
            score(last)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(len(models) * 2)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(-1, 2)


def staged_accuracy(rows: DataFrame, model: Trees, n_models: int, per_model: int, stages: list[int], value: np.ndarray, start=None,
                    bins: int = 32, threshold: float = 0.5) -> np.ndarray:
    """(models, stages, 2): test rows (_t: a byte per model) and those predicted right, when
    only the first ``stage`` trees of a model count.  One pass for all models and stages.

    ``value``: each node's, if it is a leaf; a row's score is the mean over trees (forests) or,
    with ``start`` (models,), start + the sum (boosting)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.ways(), value))

    def run(batches):
        t, leaf = shared.value
        out = np.zeros((n_models, len(stages), 2))
        for b in batches:
            if b.column("_block")[0].as_py():
                continue  # another layout of the same rows
            code = _codes(b, bins)
            test, y = _per_model(b.column("_t"), n_models), b.column("_y").to_numpy()
            for m in np.flatnonzero(test.any(axis=0)):
                mine = np.flatnonzero(test[:, m])
                for a in range(0, len(mine), step := max(1, _CELLS // per_model)):
                    r = mine[a:a + step]
                    total = np.cumsum(leaf[t.route(code[r], m * per_model + np.arange(per_model), bins)], axis=1)
                    for s, k in enumerate(stages):
                        p = total[:, k - 1] / k if start is None else start[m] + total[:, k - 1]
                        out[m, s] += test[r, m].sum(dtype=float), test[r, m][(p > threshold) == y[r]].sum(dtype=float)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["i", "v"])

    got = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n_models * len(stages) * 2)
    out[got["i"].to_numpy()] = got["v"].to_numpy()
    return out.reshape(n_models, len(stages), 2)


def levels(feature: np.ndarray, left: np.ndarray, roots: int):
    """Split nodes level by level from the roots."""
    at = np.arange(roots)
    while len(at := at[feature[at] >= 0]):
        yield at
        at = np.concatenate([left[at], left[at] + 1])


def class_share(stats: np.ndarray) -> np.ndarray:
    return stats[:, 1] / np.maximum(stats[:, 0], 1e-300)


# ------------------------------------------------------------------ boosting

@dataclass
class Boosted:
    """Trees of ``rounds`` rounds for each model, in the order (model, round), with leaf values in ``value``."""
    trees: Trees
    value: np.ndarray
    start: np.ndarray
    rounds: int


def grow_boosted(rows: DataFrame, d: int, depth: list[int], rate: list[float], rounds: int, l2: float = 1.0,
                 min_child: float = 1.0, bins: int = 32, every: int = 25, keep: list[str] | None = None) -> Boosted:
    """Second-order boosting of the logistic loss for several models side by side.

    rows (_h, _b, _y, _w as for forests).  A leaf is worth ``-rate G / (H + l2)``; the
    first margin is the log odds of the model's rows.  Margins are carried in a
    column that is renewed, and its lineage cut, ``every`` rounds; in between
    a pass routes rows through the trees since."""
    m = len(depth)
    rate, depth = np.array(rate), np.array(depth)

    def count(batches):
        out = np.zeros((m, 2))
        for b in batches:
            if b.column("_block")[0].as_py():
                continue
            w = _bytes(b.column("_w"))[:, :m].astype(float)
            out += np.column_stack([w.sum(axis=0), (w * b.column("_y").to_numpy()[:, None]).sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(2 * m)), pa.array(out.ravel())], names=["i", "v"])

    got = rows.mapInArrow(count, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    c = np.zeros(2 * m)
    c[got["i"].to_numpy()] = got["v"].to_numpy()
    n, n1 = c.reshape(m, 2).T
    p = np.clip(n1 / np.maximum(n, 1), 1e-6, 1 - 1e-6)
    start = np.log(p / (1 - p))
    columns, placed = rows.columns, layout(rows)
    now = rows.withColumn("_m", F.lit(start.astype("<f8").tobytes()))
    recent: list[tuple[Trees, np.ndarray]] = []   # rounds since the margins were renewed
    done: list[tuple[Trees, np.ndarray]] = []

    def margins(b, recent):
        out = _bytes(b.column("_m"), np.float64).copy()
        code = _codes(b, bins)
        for t, value in recent:
            out += value[t.route(code, np.arange(m), bins)]
        return out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema)
    for turn in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast(list(recent))

        def statistics(b, r, some, shared=shared):
            p = 1 / (1 + np.exp(-margins(b, shared.value)[np.ix_(r, some)]))
            w = _bytes(b.column("_w"))[np.ix_(r, some)].astype(float)
            y = b.column("_y").to_numpy()[r, None]
            return w * np.maximum(p * (1 - p), 1e-16), w * (p - y)

        t = grow(now, Growth(np.arange(m), np.arange(m, dtype=np.uint64), depth, d, d, bins, statistics, newton_gain(l2), min_child, False, placed))
        value = -rate[t.tree] * t.stats[:, 1] / (t.stats[:, 0] + l2)
        recent.append((t.ways(), value))
        done.append((t, value))
        if len(recent) == every and turn + 1 < rounds:
            old = rows.sparkSession.sparkContext.broadcast(list(recent))

            def renew(batches, old=old):
                for b in batches:
                    x = margins(b, old.value)
                    yield pa.RecordBatch.from_arrays([*[b.column(c) for c in columns], pa.array([r.tobytes() for r in x], pa.binary())], names=[*columns, "_m"])

            now, recent = cut_lineage(now.mapInArrow(renew, fields)), []
    return Boosted(*_joined(done, m), start, rounds)


def _joined(done: list[tuple[Trees, np.ndarray]], m: int) -> tuple[Trees, np.ndarray]:
    """One Trees with the roots in the order (model, round)."""
    rounds = len(done)
    out, value = Trees.roots(m * rounds), np.zeros(m * rounds)
    parts, at = [], m * rounds
    for r, (t, v) in enumerate(done):
        number = np.concatenate([np.arange(m) * rounds + r, at + np.arange(len(t.feature) - m)])
        parts.append((number, t, v))
        at += len(t.feature) - m
    out = Trees(*[np.zeros((at, *x.shape[1:]), x.dtype) for x in (out.feature, out.bin, out.missing_left, out.left, out.stats, out.tree, out.path)])
    value = np.zeros(at)
    for r, (number, t, v) in enumerate(parts):
        out.feature[number], out.bin[number], out.missing_left[number] = t.feature, t.bin, t.missing_left
        out.left[number] = number[np.minimum(t.left, len(number) - 1)]
        out.stats[number], out.tree[number], value[number] = t.stats, t.tree * rounds + r, v
    return out, value


def scores(rows: DataFrame, model: Trees, value: np.ndarray, trees: np.ndarray, keep: list[str], start: float | None = None, bins: int = 32) -> DataFrame:
    """keep columns and p1: the mean of the trees' leaf values, or the logistic of ``start`` + their sum."""
    shared = rows.sparkSession.sparkContext.broadcast((model.ways(), value))
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        t, v = shared.value
        for b in batches:
            code = _codes(b, bins)
            p = np.empty(len(code))
            for a in range(0, len(code), step := max(1, _CELLS // max(1, len(trees)))):
                x = v[t.route(code[a:a + step], trees, bins)]
                p[a:a + step] = x.mean(axis=1) if start is None else 1 / (1 + np.exp(-(start + x.sum(axis=1))))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p)], names=[*keep, "p1"])

    return rows.mapInArrow(run, f"{fields}, p1 double")
