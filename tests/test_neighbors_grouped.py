"""Pivots in groups: the nearest one and the cells a ball reaches, against all pivots."""

import numpy as np
import pytest

from stratum.operators import neighbors as N


@pytest.mark.parametrize("d", [1, 3])
def test_nearest_pivot_against_all(d):
    rng = np.random.default_rng(d)
    p = np.unique(np.vstack([rng.normal(size=(400, d)), 50 + 0.01 * rng.normal(size=(300, d))]), axis=0)
    x = np.vstack([rng.normal(size=(500, d)) * 2, p[:50], 50 + rng.normal(size=(50, d))])
    near, r = N.Grouped(p).nearest(x)
    all_ = N._distances(x, p)
    assert (r == all_.min(axis=1)).all() and (all_[np.arange(len(x)), near] == r).all()


def test_reached_groups_hold_every_cell_a_ball_meets(monkeypatch):
    rng = np.random.default_rng(7)
    p, reach = rng.normal(size=(900, 2)), rng.random(900) * 0.05
    x, r = rng.normal(size=(300, 2)), rng.random(300) * 0.1
    r[0] = np.inf
    g, got, looked = N.Grouped(p, reach), set(), 0
    for rows, m, d in g.reached(x, r):
        looked += d.size
        got |= {(rows[i], m[j]) for i, j in zip(*np.nonzero(d - r[rows, None] <= reach[None, m]))}
    i, j = np.nonzero(N._distances(x, p) - r[:, None] <= reach[None, :])
    assert got == set(zip(i, j))
    assert looked < len(x) * len(p) / 3  # most pivots are never compared


def test_few_pivots():
    for n in (0, 1, 2):
        g = N.Grouped(np.arange(n, dtype=float)[:, None])
        near, r = g.nearest(np.array([[0.2], [5.0]]))
        assert len(near) == 2 and (np.isinf(r).all() if n == 0 else near.tolist() == [0, n - 1])


def test_missing_values_as_numpy_argmin():
    p = np.array([[0.0, 1.0], [2.0, 3.0], [5.0, 5.0]])
    x = np.array([[2.1, 3.0], [np.nan, 5.0]])
    for pivots in (p, np.vstack([p, [[np.nan, 1.0]]])):
        near, r = N.Grouped(pivots).nearest(x)
        d = N._distances(x, pivots)
        assert near.tolist() == d.argmin(axis=1).tolist()
        assert np.array_equal(r, d[np.arange(2), near], equal_nan=True)
