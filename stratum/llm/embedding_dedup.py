"""Near-duplicate vectors: p-stable hashing, then exact cosines.

Vectors are scaled to length one, so a cosine c is a Euclidean distance
sqrt(2 - 2c).  A table hashes a vector by ``k`` Gaussian projections, shifted and
cut into steps of ``width`` (Datar et al. 2004); two vectors fall into the same
step of one projection with a probability p that depends on their distance
alone.  ``k`` and the number of tables follow from the number of distinct
vectors: k so that an unrelated vector is met about ``1 / thin`` times per table
however large the corpus, tables so that a pair exactly at the threshold shares a
bucket with probability ``recall`` (closer pairs with a larger one).  Work so
grows as n^1.3 at a threshold of 0.9, not as n^2.

Dense places.  Equal vectors are folded first.  Buckets of up to ``bucket_limit``
vectors are paired up.  In a longer one the vector with the smallest number is a
hub; a vector within half the threshold's angle of a hub that is near no smaller
hub joins its ball.  All pairs inside a ball are links by the triangle
inequality, so a group of near copies that holds a third of all rows is one
ball, counted and never paired up.  What else a long bucket holds is compared
exactly in pieces of ``chunk`` vectors, two to a task's matrix product (never two
of one ball); a product returns a count per vector and a spanning forest of its
links, not pairs.  A pair that meets in several buckets counts once: in a short
one if there is one, else in its first table.

A pair is a link if its cosine in double precision reaches the threshold; there
are no others, and pairs that share no bucket are missed.

Edge cases: vectors that are null or empty, all zero, or hold a null, NaN or
infinite component link with nothing (their own component, 0 links); vectors of
different length never link; a null id belongs to its component but never names
it (null ids alone: component_id null, kept false); rows of equal id are vectors
of their own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.llm.components import components
from stratum.llm.ordered import running
from stratum.llm.terms import mix
from stratum.session import cut_lineage

SEED = 29
#: rows of an Arrow batch that are hashed or multiplied at once
_ROWS = 256
#: cosines closer to a bound than this are settled member by member
_EPS = 1e-7


def step_probability(distance: float, width: float) -> float:
    """P[two vectors at this distance fall into the same step of a projection]."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(n: int, threshold: float = 0.9, width: float = 2.0, recall: float = 0.95, thin: float = 10.0) -> tuple[int, int]:
    """(projections to a table, tables) for n distinct vectors."""
    near = step_probability(math.sqrt(2 - 2 * threshold), width)
    apart = step_probability(math.sqrt(2), width)  # orthogonal
    k = max(1, math.ceil(math.log(max(2.0, thin * n)) / -math.log(apart)))
    return k, math.ceil(math.log(1 - recall) / math.log1p(-near ** k))


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def by_length(raw: list[bytes]) -> dict[int, np.ndarray]:
    out: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        out.setdefault(len(r), []).append(i)
    return {n: np.array(at) for n, at in out.items()}


def _encoded(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(_id, _vec): the components' bytes (null where a vector cannot link)."""
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    kind, element = ("<f4", "float") if single else ("<f8", "double")
    slim = vectors.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vec_col}`").cast(f"array<{element}>").alias("_e"))
    ok = (F.size("_e") > 0) & F.forall("_e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_e", lambda x: x != 0)
    slim = slim.withColumn("_e", F.when(ok, F.col("_e")))

    def run(batches):
        for b in batches:
            e = b.column("_e")
            flat, ends = e.flatten().to_numpy(zero_copy_only=False).astype(kind), np.cumsum(np.nan_to_num(
                e.value_lengths().to_numpy(zero_copy_only=False).astype(float))).astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(
                [flat[s:t].tobytes() if t > s else None for s, t in zip(starts, ends)], pa.binary())], names=["_id", "_vec"])

    return slim.mapInArrow(run, f"_id {slim.schema['_id'].dataType.simpleString()}, _vec binary"), kind


class Hasher:
    """Bucket numbers of unit vectors of one length, a column for each table."""

    def __init__(self, k: int, tables: int, width: float, seed: int):
        self.k, self.tables, self.width, self.seed, self.known = k, tables, width, seed, {}

    def __call__(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        if n not in self.known:
            rng, size = np.random.default_rng([self.seed, n]), self.k * self.tables
            table = mix(np.arange(self.tables, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(n))
            self.known[n] = (rng.standard_normal((n, size)) / self.width, rng.random(size),
                             rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), table)
        g, shift, odd, table = self.known[n]
        # row by row, so that a vector has the same buckets in whatever batch it stands
        step = np.floor(np.stack([v @ g for v in x]) + shift).astype(np.int64).view(np.uint64) * odd
        return mix(step.reshape(len(x), self.tables, self.k).sum(axis=2, dtype=np.uint64) + table).view(np.int64)


def buckets(reps: DataFrame, kind: str, k: int, tables: int, width: float, seed: int = SEED) -> DataFrame:
    """(_bucket, _no): a row for each distinct vector and table."""
    hashes = Hasher(k, tables, width, seed)

    def run(batches):
        for b in batches:
            no, raw = b.column("_no").to_numpy(), b.column("_vec").to_pylist()
            for a in range(0, len(raw), _ROWS):
                for at in by_length(raw[a:a + _ROWS]).values():
                    h = hashes(unit([raw[a + i] for i in at], kind))
                    yield pa.RecordBatch.from_arrays([pa.array(h.ravel()), pa.array(np.repeat(no[a + at], tables))], names=["_bucket", "_no"])

    return reps.select("_no", "_vec").mapInArrow(run, "_bucket long, _no long")


def _cosines(pairs: DataFrame, kind: str) -> DataFrame:
    """pairs (a, b, _va, _vb, more) -> (a, b, more, _cos)."""
    more = [c for c in pairs.columns if c not in ("_va", "_vb")]

    def run(batches):
        for b in batches:
            va, vb = b.column("_va").to_pylist(), b.column("_vb").to_pylist()
            cos = np.full(len(va), -1.0)
            for n, at in by_length(va).items():
                at = np.array([i for i in at if len(vb[i]) == n], np.int64)
                for s in range(0, len(at), 4 * _ROWS):
                    p = at[s:s + 4 * _ROWS]
                    cos[p] = np.einsum("ij,ij->i", unit([va[i] for i in p], kind), unit([vb[i] for i in p], kind))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in more], pa.array(cos)], names=[*more, "_cos"])

    return pairs.mapInArrow(run, ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in more) + ", _cos double")


def _with_vectors(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    for c in ("a", "b"):
        pairs = pairs.join(reps.select(F.col("_no").alias(c), F.col("_vec").alias(f"_v{c}")), c)
    return pairs


def balls(reps: DataFrame, long: DataFrame, kind: str, threshold: float, rounds: int = 3) -> DataFrame:
    """(_no, _ball) of vectors that are in a ball of more than one; long (_bucket, _no).

    A round takes the hubs of the vectors that are left; vectors left after the
    last one are in no ball, which costs products but no link."""
    half, free, placed = math.cos(math.acos(threshold) / 2) + _EPS, long, None
    for _ in range(rounds):
        hubs = free.groupBy("_bucket").agg(F.min("_no").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_bucket", "b")
        pairs = free.join(hubs, "_bucket").where("_no <> b").select(F.col("_no").alias("a"), "b").distinct()
        near = cut_lineage(_cosines(_with_vectors(pairs, reps), kind).where(F.col("_cos") >= half).select("a", "b"))
        # a hub that is near no smaller hub is a centre
        centres = near.select("b").distinct().join(near.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
        took = near.join(centres, "b").groupBy(F.col("a").alias("_no")).agg(F.min("b").alias("_ball"))
        took = cut_lineage(took.unionByName(centres.select(F.col("b").alias("_no"), F.col("b").alias("_ball"))))
        placed = took if placed is None else placed.unionByName(took)
        # those that are near a hub that is no centre
        rest = near.select(F.col("a").alias("_no")).distinct().join(took, "_no", "left_anti")
        if not rest.limit(1).count():
            break
        free = free.join(rest, "_no", "left_semi")
    return placed


def _short_links(short: DataFrame, reps: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(a, b) of different balls whose cosine reaches the threshold; short (_bucket, _no, _ball)."""
    s = lambda c: short.select("_bucket", F.col("_no").alias(c), F.col("_ball").alias(f"_ball{c}"))
    pairs = s("a").join(s("b"), "_bucket").where("a < b AND _balla <> _ballb").select("a", "b").distinct()
    return _cosines(_with_vectors(pairs, reps), kind).where(F.col("_cos") >= threshold).select("a", "b")


def spanning(link: np.ndarray) -> np.ndarray:
    """For a product's link matrix (left x right): the component of each left and right
    row, as the least index in it (left rows first)."""
    l, r = link.shape
    label = np.arange(l + r)
    while True:
        old = label.copy()
        low = np.where(link, label[None, l:], l + r).min(axis=1, initial=l + r)
        label[:l] = np.minimum(label[:l], low)
        low = np.where(link, label[:l, None], l + r).min(axis=0, initial=l + r)
        label[l:] = np.minimum(label[l:], low)
        if (label == old).all():
            return label


def _products(pieces: DataFrame, kind: str, threshold: float, hashes) -> DataFrame:
    """pieces (_pair, _self, _right, _bucket, _no, _ball, _m, _long, _vec) -> (_no, _links, _to):
    the rows that a vector links to and that are counted here; a vector linked to it."""
    def run(t: pa.Table) -> pa.Table:
        raw, right, itself = t["_vec"].to_pylist(), t["_right"].to_numpy(), t["_self"][0].as_py()
        no, ball, m = (t[c].to_numpy() for c in ("_no", "_ball", "_m"))
        bucket, long = t["_bucket"][0].as_py(), np.unique(t["_long"].combine_chunks().flatten().to_numpy())
        x = unit(raw, kind)  # of one length, since that is hashed too
        h = hashes(x)
        is_long = np.isin(h, long)
        l = np.arange(len(raw)) if itself else np.flatnonzero(~right)
        r = l if itself else np.flatnonzero(right)
        cos = x[l] @ x[r].T
        link = (cos >= threshold) & (ball[l][:, None] != ball[r][None, :])
        # a product's last bits may differ from those of the pair's own sum, which decides
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-12)):
            link[i, j] = ball[l[i]] != ball[r[j]] and np.einsum("i,i->", x[l[i]], x[r[j]]) >= threshold
        i, j = np.nonzero(link)
        here = np.zeros(len(i), bool)
        for a in range(0, len(i), 1 << 14):
            p, q = l[i[a:a + (1 << 14)]], r[j[a:a + (1 << 14)]]
            same = h[p] == h[q]
            first = h[p, np.argmax(same, axis=1)]
            here[a:a + (1 << 14)] = ~(same & ~is_long[p]).any(axis=1) & (first == bucket)
        n = np.zeros(len(raw), np.int64)
        np.add.at(n, l[i], np.where(here, m[r[j]], 0))
        if not itself:
            np.add.at(n, r[j], np.where(here, m[l[i]], 0))
        label, both = spanning(link), np.concatenate([l, r])
        to = np.full(len(raw), -1)
        to[both[::-1]] = no[both[label]][::-1]
        out = np.flatnonzero((n > 0) | (to != no))
        return pa.table({"_no": no[out], "_links": n[out], "_to": to[out]})

    return pieces.groupBy("_pair").applyInArrow(run, "_no long, _links long, _to long")


def _long_pieces(long: DataFrame, reps: DataFrame, chunk: int) -> DataFrame:
    """Rows of the products of long buckets; long (_bucket, _no, _ball), checkpointed.

    A ball with more than ``chunk`` / 8 vectors in a bucket has pieces of its own; two
    pieces of one ball never meet."""
    inside = long.groupBy("_bucket", "_ball").agg(F.count(F.lit(1)).alias("_k"))
    inside = inside.withColumn("_own", F.when(F.col("_k") > chunk // 8, F.col("_ball")).otherwise(F.lit(-1)))
    many = inside.groupBy("_bucket", "_own").agg(F.ceil(F.sum("_k") / chunk).alias("_parts"))
    dealt = (long.join(inside.select("_bucket", "_ball", "_own"), ["_bucket", "_ball"]).join(many, ["_bucket", "_own"])
             .withColumn("_piece", F.struct("_own", F.pmod(F.xxhash64("_no"), F.col("_parts")).alias("part"))))
    dealt = cut_lineage(dealt.select("_bucket", "_piece", "_no", "_ball"))
    pieces = dealt.select("_bucket", "_piece").distinct()
    two = (pieces.select("_bucket", F.col("_piece").alias("p")).join(pieces.select("_bucket", F.col("_piece").alias("q")), "_bucket")
           .where("p <= q AND (p._own = -1 OR p._own <> q._own)").withColumn("_pair", F.struct("_bucket", "p", "q")))
    of = long.groupBy("_no").agg(F.collect_set("_bucket").alias("_long"))  # one for each table at most
    body = reps.select("_no", "_m", "_vec").join(of, "_no")
    side = lambda mine, right: (two if not right else two.where("p <> q")).select(
        "_pair", (F.col("p") == F.col("q")).alias("_self"), F.lit(right).alias("_right"), "_bucket", F.col(mine).alias("_piece"))
    return side("p", False).unionByName(side("q", True)).join(dealt, ["_bucket", "_piece"]).drop("_piece").join(body, "_no")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9,
                           width: float = 2.0, recall: float = 0.95, thin: float = 10.0, bucket_limit: int = 32,
                           chunk: int = 512, seed: int = SEED) -> DataFrame:
    """Per vector: id, n_links, component_id, kept."""
    rows, kind = _encoded(vectors, id_col, vec_col)
    rows = rows.withColumn("_h", F.md5("_vec"))
    folded = (rows.where("_vec is not null").groupBy("_h", "_vec").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_m"))
              .withColumn("_none", F.col("_least").isNull()))
    # numbers in the order of ids: the least number of a component is its least id
    reps = cut_lineage(running(folded, ["_none", "_least", "_h"], []).withColumnRenamed("index", "_no"))
    k, tables = plan_tables(reps.count(), threshold, width, recall, thin)
    dealt = buckets(reps, kind, k, tables, width, seed)
    sizes = dealt.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    met = cut_lineage(dealt.join(sizes, "_bucket"))
    long = met.where(F.col("_n") > bucket_limit).select("_bucket", "_no")
    crowded = bool(long.limit(1).count())
    if crowded:
        own = balls(reps, long, kind, threshold)
        reps = cut_lineage(reps.join(own, "_no", "left").withColumn("_ball", F.coalesce("_ball", "_no")))
    else:
        reps = reps.withColumn("_ball", F.col("_no"))
    of = reps.select("_no", "_ball", "_m")
    found = cut_lineage(_short_links(met.where(F.col("_n") <= bucket_limit).join(of, "_no"), reps, kind, threshold))
    both = found.union(found.select("b", "a")).toDF("_no", "b")
    counts = both.join(of.select(F.col("_no").alias("b"), "_m"), "b").groupBy("_no").agg(F.sum("_m").alias("_links"))
    edges = found
    if crowded:
        pieces = _long_pieces(cut_lineage(long.join(of.select("_no", "_ball"), "_no")), reps, chunk)
        products = cut_lineage(_products(pieces, kind, threshold, Hasher(k, tables, width, seed)))
        counts = counts.unionByName(products.groupBy("_no").agg(F.sum("_links").alias("_links"))).groupBy("_no").agg(F.sum("_links").alias("_links"))
        edges = edges.union(products.select("_no", "_to")).union(reps.where("_no <> _ball").select("_no", "_ball"))
    weights = of.groupBy("_ball").agg(F.sum("_m").alias("_w"))
    roots = components(edges.toDF("a", "b"))
    least = reps.select(F.col("_no").alias("root"), F.col("_least").alias("_root"))
    named = (of.join(weights, "_ball").join(counts, "_no", "left").join(roots, of["_no"] == roots["node"], "left")
             .select("_no", (F.col("_w") - 1 + F.coalesce("_links", F.lit(0))).alias("_links"), F.coalesce("root", "_no").alias("root"))
             .join(least, "root"))
    said = reps.select("_no", "_h").join(named, "_no").select("_h", "_links", "_root")
    linked = F.col("_vec").isNotNull()
    out = rows.join(said, "_h", "left")
    component = F.when(linked, F.col("_root")).otherwise(F.col("_id"))
    return out.select(F.col("_id").alias(id_col), F.when(linked, F.col("_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
