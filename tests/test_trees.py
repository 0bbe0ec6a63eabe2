"""Histogram trees: hand-computed splits, many models equal single fits, staged prefixes, boosting."""

import numpy as np
import pytest

from stratum.operators import trees as T


def test_best_split_by_hand():
    # one node, one feature, bins 0..3 and missing: (n, n1)
    h = np.array([[[[4, 0], [2, 0], [3, 3], [1, 0], [0, 0]]]], float)
    slot, bin_, side, gain, left, total = T.best_splits(h, T.gini_gain, 1.0)
    # up to bin 1: 6 rows without class 1; the rest: 4 rows, 3 of it
    assert (slot[0], bin_[0]) == (0, 1) and left[0].tolist() == [6, 0] and total[0].tolist() == [10, 3]
    assert gain[0] == pytest.approx((36 / 6 + (9 + 1) / 4 - (9 + 49) / 10) / 2)
    # equal gains: the first; no gain: none
    slot, bin_, *_ = T.best_splits(np.array([[[[2, 0], [0, 0], [2, 2], [0, 0]]], [[[2, 1], [2, 1], [2, 1], [0, 0]]]], float), T.gini_gain, 1.0)
    assert (slot[0], bin_[0]) == (0, 0) and slot[1] == -1


def test_newton_gain_and_missing_side_by_hand():
    # (H, G) per bin; the missing rows have the gradient of the right side
    h = np.array([[[[2.0, -3.0], [2.0, 3.0], [1.0, 2.0]]]])
    slot, bin_, side, gain, left, total = T.best_splits(h, T.newton_gain(1.0), 0.5)
    assert (slot[0], bin_[0], side[0]) == (0, 0, False)
    assert gain[0] == pytest.approx((9 / 3 + 25 / 4 - 4 / 6) / 2) and left[0].tolist() == [2.0, -3.0]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)
    rows = [(i, *[None if rng.random() < 0.05 else float(v) for v in r], int(t), i % 4) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, a double, b double, c double, _y int, part int").repartition(3)


FEATS = ["a", "b", "c"]


def binned(table, models, bins=16):
    """Model m trains on all parts but m."""
    def masks(b):
        out = b.column("part").to_numpy()[:, None] == np.array(models)[None, :]
        return (~out).astype(np.uint8), out.astype(np.uint8)

    return T.bin_rows(table, FEATS, T.bin_edges(table, FEATS, bins), "row_id", ["_y", "part", "row_id"], masks)


def same(a, at, b, to):
    """Two trees are equal, node by node."""
    todo = [(at, to)]
    while todo:
        i, j = todo.pop()
        assert a.feature[i] == b.feature[j] and np.allclose(a.stats[i], b.stats[j])
        if a.feature[i] >= 0:
            assert a.bin[i] == b.bin[j] and a.missing_left[i] == b.missing_left[j]
            todo += [(a.left[i], b.left[j]), (a.left[i] + 1, b.left[j] + 1)]


def test_many_models_equal_single_fits(table):
    both = T.laid_out(binned(table, [0, 1, 2]), tasks=3)
    together = T.grow_forests(both, 3, ["m0", "m1", "m2"], trees=6, bins=16)
    few_nodes = T.grow_forests(T.laid_out(binned(table, [0, 1, 2]), rows_per_task=50, tasks=1), 3, ["m0", "m1", "m2"], trees=6, bins=16, nodes_per_pass=5)
    for m in range(3):
        alone = T.grow_forests(T.laid_out(binned(table, [m]), tasks=1), 3, [f"m{m}"], trees=6, bins=16)
        for t in range(6):
            same(together, m * 6 + t, alone, t)
            same(together, m * 6 + t, few_nodes, m * 6 + t)
    assert len(together.feature) > 18 * 5


def test_prefixes_equal_separate_fits(table):
    rows = T.laid_out(binned(table, [0, 1]))
    long = T.grow_forests(rows, 3, ["m0", "m1"], trees=8, bins=16)
    staged = T.staged_accuracy(rows, long, 2, 8, [3, 8], T.class_share(long.stats), bins=16)
    short = T.grow_forests(rows, 3, ["m0", "m1"], trees=3, bins=16)
    assert (staged[:, 0] == T.staged_accuracy(rows, short, 2, 3, [3], T.class_share(short.stats), bins=16)[:, 0]).all()
    assert (staged[:, :, 0] == 60).all() and (staged[:, 1, 1] / 60 > 0.8).all()
    boosted = T.grow_boosted(rows, 3, [3, 2], [0.3, 0.1], 7, bins=16, every=3)
    assert len(boosted.start) == 2
    s = T.staged_accuracy(rows, boosted.trees, 2, 7, [4, 7], boosted.value, boosted.start, bins=16, threshold=0.0)
    four = T.grow_boosted(rows, 3, [3, 2], [0.3, 0.1], 4, bins=16)
    assert (s[:, 0] == T.staged_accuracy(rows, four.trees, 2, 4, [4], four.value, four.start, bins=16, threshold=0.0)[:, 0]).all()


def test_boosting_against_plain_numpy(table):
    """Leaf values -rate G / (H + l2) of trees grown by exhaustive search over the same bins."""
    rows = binned(table, [9])
    got = T.grow_boosted(T.laid_out(rows), 3, [2], [0.3], 3, bins=16)
    data = rows.collect()
    code = np.array([list(r["_b"]) for r in data], int)
    y = np.array([r["_y"] for r in data], float)
    f = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    assert got.start[0] == pytest.approx(f[0])
    for turn in range(3):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, p * (1 - p)

        def split(mask, depth):
            G, H = g[mask].sum(), h[mask].sum()
            best = (1e-12, None)
            for j in range(3):
                for k in range(15):
                    for ml in (False, True):
                        left = mask & np.where(code[:, j] == 255, ml, code[:, j] <= k)
                        hl = h[left].sum()
                        if hl >= 1 and H - hl >= 1:
                            gain = (g[left].sum() ** 2 / (hl + 1) + (G - g[left].sum()) ** 2 / (H - hl + 1) - G * G / (H + 1)) / 2
                            if gain > best[0] * (1 + 1e-9):
                                best = (gain, left)
            if depth and best[1] is not None and H >= 2:
                split(mask & best[1], depth - 1)
                split(mask & ~best[1], depth - 1)
            else:
                f[mask] += -0.3 * G / (H + 1)

        split(np.ones(len(y), bool), 2)
    out = T.scores(T.laid_out(rows).where("_block = 0"), got.trees, got.value, np.arange(3), ["row_id"], float(got.start[0]), bins=16)
    p1 = {r["row_id"]: r["p1"] for r in out.collect()}
    assert np.allclose([p1[r["row_id"]] for r in data], 1 / (1 + np.exp(-f)), atol=1e-9)


def test_empty(spark):
    none = spark.createDataFrame([], "row_id long, a double, _y int")
    rows = T.laid_out(T.bin_rows(none, ["a"], T.bin_edges(none, ["a"]), "row_id", ["_y"]))
    t = T.grow_forests(rows, 1, ["m"], trees=2)
    assert t.feature.tolist() == [-1, -1]
