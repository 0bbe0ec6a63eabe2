"""Landmark kernel map (Nystrom): a kernel machine as a linear one on explicit features.

``fit_kernel_map`` draws landmarks from the rows by what the landmarks so far leave
unexplained: a row's weight is k(x, x) - |z(x)|^2 under the present map (adaptive
sampling), and the rows of a round are those with the smallest -ln(u) / weight, u a
hash of the row's key (weighted sampling without replacement).  Each round is one pass
that ends in a bounded top-k.  The Gram matrix of the landmarks is whitened on the
driver (at most ``m`` x ``m`` numbers): z(x) = L^-1/2 V' k(landmarks, x), so that
z(x)'z(y) is the projection of k(x, y) onto the landmarks, exact where one of both
is a landmark.  Directions below ``EPS`` of the largest are dropped.

``apply_kernel_map`` is one projection of native expressions (no shuffle, no Python).

Values that are null or not finite count as the column's centre.  Repeated rows weigh
nothing once one of them is a landmark; fewer landmarks than ``m`` come back when
there is nothing left to explain, none when there are no rows: the map is then one
constant 0.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform

EPS = 1e-8


@dataclass
class KernelMap:
    """kind: rbf exp(-gamma |x - l|^2) | poly (gamma x'l + coef0)^degree."""

    cols: list[str]
    scale: dict[str, tuple[float, float]]
    kind: str
    gamma: float
    degree: int = 2
    coef0: float = 1.0
    points: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    white: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))

    def gram(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dots = a @ b.T
        if self.kind == "poly":
            return (self.gamma * dots + self.coef0) ** self.degree
        return np.exp(-self.gamma * np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * dots, 0))

    def with_points(self, points: np.ndarray) -> KernelMap:
        values, vectors = np.linalg.eigh(self.gram(points, points))
        solid = values > EPS * values.max()
        return KernelMap(self.cols, self.scale, self.kind, self.gamma, self.degree, self.coef0, points,
                         (vectors[:, solid] / np.sqrt(values[solid])).T)

    # ---- the same in native expressions

    def scaled(self) -> Column:
        out = []
        for c in self.cols:
            shift, div = self.scale.get(c, (0.0, 1.0))
            v = F.col(f"`{c}`").cast("double")
            fine = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
            out.append((F.when(fine, v).otherwise(F.lit(shift)) - F.lit(shift)) / F.lit(div))
        return F.array(*out)

    def own(self, x: Column) -> Column:
        """k(x, x)."""
        if self.kind == "poly":
            return F.pow(F.lit(self.gamma) * _dot(x, x) + F.lit(self.coef0), F.lit(float(self.degree)))
        return F.lit(1.0)

    def features(self, x: Column) -> Column:
        """z(x) as an array."""
        if not len(self.points):
            return F.array(F.lit(0.0))
        if self.kind == "poly":
            near = lambda x, p: F.pow(F.lit(self.gamma) * _dot(x, p) + F.lit(self.coef0), F.lit(float(self.degree)))
        else:
            near = lambda x, p: F.exp(F.lit(-self.gamma) * F.aggregate(
                F.zip_with(x, p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return _let(_let(x, lambda x: F.transform(_matrix(self.points), lambda p: near(x, p))),
                    lambda k: F.transform(_matrix(self.white), lambda row: _dot(row, k)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a helper column would need a name that
    no other column has)."""
    return F.transform(F.array(value), body)[0]


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def _matrix(m: np.ndarray) -> Column:
    """A constant array of rows (folded into a literal once, however large)."""
    return F.from_json(F.lit(json.dumps(m.tolist())), "array<array<double>>")


def fit_kernel_map(df: DataFrame, cols: list[str], kind: str = "rbf", m: int = 64, rounds: int = 4, gamma: float | None = None,
                   degree: int = 2, coef0: float = 1.0, key: str = "row_id", seed: int = 42, scale: dict | None = None) -> KernelMap:
    """``m`` landmarks in ``rounds`` rounds; ``scale`` {column: (shift, divisor)}, fitted on
    training rows, is applied inside; gamma defaults to 1 / number of columns."""
    if kind not in ("rbf", "poly"):
        raise ValueError(f"unknown kernel {kind!r}")
    kmap = KernelMap(list(cols), scale or {}, kind, gamma or 1.0 / len(cols), degree, coef0)
    for r in range(rounds):
        want = m * (r + 1) // rounds - len(kmap.points)
        x = F.col("_x")
        t = df.select(F.col(f"`{key}`").alias("_key"), kmap.scaled().alias("_x"))
        left = kmap.own(x) - (_let(kmap.features(x), lambda z: _dot(z, z)) if len(kmap.points) else F.lit(0.0))
        u = F.greatest(hash_uniform("_key", seed, f"landmark{r}"), F.lit(1e-12))
        t = t.select("_key", "_x", left.alias("_left"), u.alias("_u")).where(F.col("_left") > EPS * F.greatest(kmap.own(x), F.lit(1.0)))
        got = t.orderBy(-F.log("_u") / F.col("_left"), "_key", "_x").select("_x").limit(want).collect()
        if not got:
            break
        new = np.array([g["_x"] for g in got], float)
        points = np.concatenate([kmap.points, new]) if len(kmap.points) else new
        kmap = kmap.with_points(np.unique(points, axis=0))
    return kmap


def apply_kernel_map(df: DataFrame, kmap: KernelMap, out: str = "kernel_map") -> DataFrame:
    """``df`` with the vector column ``out`` (in place of one of that name)."""
    size = {"ml_attr": {"num_attrs": max(1, len(kmap.white))}}  # as the assembler asks
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != out],
                     array_to_vector(kmap.features(kmap.scaled())).alias(out, metadata=size))
