import math

import numpy as np
import pytest

from stratum.llm import embedding_dedup as E
from tests.llm.conftest import strange

VECS = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold=0.9):
    ok = [(k, np.array(v, float)) for k, (_, v) in enumerate(rows)
          if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    unit = {k: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for k, v in ok}
    links = {k: set() for k in range(len(rows))}
    for a, x in unit.items():
        for b, y in unit.items():
            if a < b and len(x) == len(y) and x @ y >= threshold:
                links[a].add(b)
                links[b].add(a)
    return links


def components_of(links, rows):
    seen, least = {}, {}
    for k in links:
        if k in seen:
            continue
        todo, group = [k], []
        while todo:
            x = todo.pop()
            if x not in seen:
                seen[x] = k
                group.append(x)
                todo += links[x]
        ids = [rows[x][0] for x in group if rows[x][0] is not None]
        least[k] = min(ids, default=None)
    return {k: least[seen[k]] for k in links}


def key(t):
    return tuple((x is None, x or 0) for x in t)


def compare(df, rows, **more):
    links = brute(rows)
    comp = components_of(links, rows)
    want = sorted(((rows[k][0], len(links[k]), comp[k], rows[k][0] is not None and rows[k][0] == comp[k]) for k in links), key=key)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicate_vectors(df, **more).collect()), key=key)
    return got, want


def around(rng, centre, cos, n):
    out = []
    for _ in range(n):
        z = rng.standard_normal(len(centre))
        z -= (z @ centre) * centre
        out.append(cos * centre + math.sqrt(1 - cos * cos) * z / np.linalg.norm(z))
    return out


def centre(rng, d=32):
    x = rng.standard_normal(d)
    return x / np.linalg.norm(x)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    vs = [centre(rng) for _ in range(200)]
    for _ in range(12):
        vs += around(rng, centre(rng), 0.985, int(rng.integers(2, 8)))
    hot = centre(rng)
    vs += around(rng, hot, 0.995, 120) + [hot] * 30 + [hot * 7.0] * 5      # one ball
    vs += around(rng, centre(rng), 0.965, 90)                             # links of about 0.93: no ball holds them
    rows = [(1000 + i, [float(x) for x in v]) for i, v in enumerate(vs)]
    odd = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31,
           [1e200] + [0.0] * 31, [1e-200] + [0.0] * 31, [1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 0.0]]
    rows += [(i, v) for i, v in enumerate(odd)] + [(None, rows[5][1]), (None, rows[300][1]), (None, None), (7, rows[300][1]), (1000, rows[0][1])]
    return spark.createDataFrame([(*r, 0) for r in rows], VECS).repartition(5), rows


@pytest.mark.parametrize("more", [{}, {"bucket_limit": 4, "chunk": 16}, {"bucket_limit": 10 ** 6}])
def test_against_brute_force(vectors, more):
    df, rows = vectors
    # the recall asked for is such that no pair is missed here: results are exact
    got, want = compare(strange(df), rows, recall=0.9999999, **more)
    assert got == want


def test_production_recall(vectors):
    df, rows = vectors
    got, want = compare(df, rows)
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert all(g[1] <= w[1] and g[0] == w[0] for g, w in zip(got, want))


def test_plan_of_tables():
    for n in (1, 500, 50_000, 10 ** 9):
        k, tables = E.plan_tables(n)
        p = E.step_probability(math.sqrt(0.2), 2.0) ** k
        assert 1 - (1 - p) ** tables >= 0.95
        assert n * E.step_probability(math.sqrt(2), 2.0) ** k <= 0.1
    rng = np.random.default_rng(0)  # the probability itself, by simulation
    g, b = rng.standard_normal(200_000) * 0.7, rng.random(200_000) * 2
    assert abs(np.mean(np.floor(b / 2) == np.floor((b + g) / 2)) - E.step_probability(0.7, 2.0)) < 0.005


def test_spanning_forest():
    rng = np.random.default_rng(1)
    link = rng.random((30, 25)) < 0.03
    got, want = E.spanning(link), list(range(55))
    for _ in range(60):
        for i, j in zip(*np.nonzero(link)):
            want[i] = want[30 + j] = min(want[i], want[30 + j])
    assert got.tolist() == want


def test_empty_and_floats(spark):
    none = spark.createDataFrame([], VECS)
    assert E.near_duplicate_vectors(none).count() == 0
    floats = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicate_vectors(floats).collect()}
    assert out == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True)}
    dead = spark.createDataFrame([(1, None), (2, [0.0])], VECS.replace(", label int", ""))
    assert {(r["vec_id"], r["n_links"], r["kept"]) for r in E.near_duplicate_vectors(dead).collect()} == {(1, 0, True), (2, 0, True)}
