"""G. Seeded splitting, folds, undersampling, SMOTE and Tomek cleaning.

Randomness is ``hash_uniform(key, seed, draw)`` (md5), so every draw is a pure
function of the row key: reproducible across runs, partitionings and task
retries.  Ranks inside a class come from ``hash_rank`` (exact, skew-free hash
buckets), never from a single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform
from stratum.operators.neighbors import knn
from stratum.operators.windows import hash_rank
from stratum.session import cut_lineage


MAX_CLASSES = 1000


def _class_counts(df: DataFrame, label: str) -> dict:
    """Class sizes (the label domain; refused beyond ``MAX_CLASSES``)."""
    got = df.groupBy(label).agg(F.count(F.lit(1)).alias("c")).limit(MAX_CLASSES + 1).collect()
    if len(got) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label!r}: not a class label")
    return {r[label]: r["c"] for r in got}


def _per_class_lit(counts: dict, label: str, fn):
    e = None
    for cls, n in counts.items():
        e = (F.when(F.col(label) == F.lit(cls), F.lit(fn(n))) if e is None
             else e.when(F.col(label) == F.lit(cls), F.lit(fn(n))))
    return e


def split_stratified(df: DataFrame, label: str = "label", test_size: float = 0.2, seed: int = 42,
                     key: str = "row_id") -> DataFrame:
    """Adds ``is_test``: per class, the first round(n_c · test_size) rows in hash order."""
    counts = _class_counts(df, label)
    r = hash_rank(df, key, seed, group=[label], rank_col="_rk")
    cut = _per_class_lit(counts, label, lambda n: int(n * test_size + 0.5))
    return r.withColumn("is_test", F.col("_rk") < cut).drop("_rk")


def split_random(df: DataFrame, test_size: float = 0.25, seed: int = 44, key: str = "row_id") -> DataFrame:
    """Adds ``is_test``: the first ceil(n · test_size) rows in hash order."""
    n = df.count()
    cut = int(-(-n * test_size // 1))
    return hash_rank(df, key, seed, rank_col="_rk").withColumn("is_test", F.col("_rk") < cut).drop("_rk")


def kfold_stratified(df: DataFrame, label: str = "label", k: int = 5, seed: int = 0, key: str = "row_id",
                     fold_col: str = "fold") -> DataFrame:
    """Fold id = (rank inside the class in hash order) mod k: class-balanced folds
    whose sizes differ by at most one per class (usable as CrossValidator foldCol)."""
    r = hash_rank(df, key, seed, group=[label], rank_col="_rk", draw="fold")
    return r.withColumn(fold_col, (F.col("_rk") % k).cast("int")).drop("_rk")


def kfold_repeated(df: DataFrame, groups: list[str], k: int, repeats: int, key: str = "row_id") -> DataFrame:
    """``df`` with _folds: for every repeat r the fold that ``kfold_stratified`` with seed r
    gives the row inside its group, all from one ranking."""
    t = df.withColumn("_rep", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    r = hash_rank(t.select(key, *groups, "_rep"), key, F.col("_rep"), group=[*groups, "_rep"], rank_col="_rk", draw="fold")
    folds = (r.groupBy(key, *groups).agg(F.sort_array(F.collect_list(F.struct("_rep", (F.col("_rk") % k).cast("int").alias("f")))).alias("_f"))
             .select(key, *groups, F.col("_f.f").alias("_folds")))
    return df.join(folds, [key, *groups])


def undersample_random(df: DataFrame, label: str = "label", ratio: float = 1.0, seed: int = 42,
                       key: str = "row_id") -> DataFrame:
    """Keep the minority class; keep floor(n_min / ratio) majority rows in hash order."""
    counts = _class_counts(df, label)
    if len(counts) < 2:
        return df
    mino = min(counts, key=lambda c: (counts[c], c))
    majo = max(counts, key=lambda c: (counts[c], -c if isinstance(c, (int, float)) else 0))
    keep = int(counts[mino] / ratio)
    if keep >= counts[majo]:
        return df
    r = hash_rank(df.where(F.col(label) == majo), key, seed, group=[label], rank_col="_rk", draw="under")
    return df.where(F.col(label) != majo).unionByName(r.where(F.col("_rk") < keep).drop("_rk"))


def minority_neighbours(df: DataFrame, feats: list[str], label: str = "label", k: int = 5, key: str = "row_id") -> DataFrame | None:
    """(q_id, nn_rank, nn_id) among the minority rows, cut from the search: what ``smote`` may be given, so that
    sets of several ratios share it.  None where there is no minority or no neighbour."""
    counts = _class_counts(df, label)
    mino = min(counts, key=lambda c: (counts[c], c)) if len(counts) > 1 else None
    if mino is None or counts[mino] < 2:
        return None
    m = df.where(F.col(label) == mino).select(key, *[F.col(f).cast("double").alias(f) for f in feats])
    return cut_lineage(knn(m, key, feats, min(k, counts[mino] - 1)).select("q_id", "nn_rank", "nn_id"))


def smote(df: DataFrame, feats: list[str], label: str = "label", ratio: float = 1.0, k: int = 5, seed: int = 42,
          key: str = "row_id", near: DataFrame | None = None) -> DataFrame:
    """Synthetic minority rows x + u·(nn − x) until n_min = int(ratio · n_maj).
    ``near``: the minority's neighbours, if they are known (``minority_neighbours``).

    Draw d (0 ≤ d < need) uses the minority row of hash rank d mod n_min, its
    neighbour number floor(u₁·k) among its k nearest minority rows, and gap u₂;
    u₁, u₂ are hashes of (row key, seed, d).  Synthetic rows get row_id −(d+1)
    and ``synthetic`` = true; originals are returned unchanged."""
    df = df.select(key, *feats, label).persist()  # read for the counts, the neighbours and the result
    counts = _class_counts(df, label)
    out = df.select(key, *feats, label, F.lit(False).alias("synthetic"))
    if len(counts) < 2:
        return out
    mino = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[mino], max(counts.values())
    need = int(n_maj * ratio) - n_min
    if need <= 0 or n_min < 2:
        return out
    kk = min(k, n_min - 1)
    m = df.where(F.col(label) == mino).select(key, *[F.col(f).cast("double").alias(f) for f in feats]).persist()
    nn = knn(m, key, feats, kk) if near is None else near
    r = hash_rank(m, key, seed, rank_col="_rk", draw="smote")
    # row of rank r serves draws r, r + n_min, r + 2·n_min, ... < need; rows of rank ≥ need serve none
    last = F.floor((F.lit(need - 1) - F.col("_rk")) / n_min).cast("int")
    draws = r.where(F.col("_rk") < need).select(key, *feats, "_rk", F.explode(F.sequence(F.lit(0), last)).alias("_j"))
    d = (F.col("_rk") + F.col("_j") * n_min).cast("long")
    draws = draws.select(key, *feats, d.alias("_d"))
    draws = draws.select("*", F.floor(hash_uniform(key, seed, F.concat(F.col("_d").cast("string"), F.lit("|nn")))
                                      * kk).cast("int").alias("_nr"),
                         hash_uniform(key, seed, F.concat(F.col("_d").cast("string"), F.lit("|gap"))).alias("_u"))
    j = draws.join(nn.select(F.col("q_id").alias(key), F.col("nn_rank").alias("_nr"), "nn_id"), [key, "_nr"])
    nb = m.select(F.col(key).alias("nn_id"), *[F.col(f).alias(f"_n_{f}") for f in feats])
    j = j.join(nb, "nn_id")
    syn = j.select((-(F.col("_d") + 1)).alias(key),
                   *[(F.col(f) + F.col("_u") * (F.col(f"_n_{f}") - F.col(f))).alias(f) for f in feats],
                   F.lit(mino).alias(label), F.lit(True).alias("synthetic"))
    return out.unionByName(syn.select(out.columns))


def tomek_links(df: DataFrame, feats: list[str], label: str = "label", key: str = "row_id") -> DataFrame:
    """Pairs (a, b) of mutual nearest neighbours with different labels (a < b)."""
    df = df.select(key, *feats, label).persist()
    # both sides of the join below read it: the search runs once
    nn = cut_lineage(knn(df, key, feats, 1).select(F.col("q_id").alias("a"), F.col("nn_id").alias("b")))
    lab = df.select(F.col(key).alias("_id"), F.col(label).alias("_y"))
    mutual = nn.alias("x").join(nn.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a")))
    m = mutual.select(F.col("x.a").alias("a"), F.col("x.b").alias("b")).where(F.col("a") < F.col("b"))
    m = m.join(lab.withColumnRenamed("_id", "a").withColumnRenamed("_y", "ya"), "a") \
         .join(lab.withColumnRenamed("_id", "b").withColumnRenamed("_y", "yb"), "b")
    return m.where(F.col("ya") != F.col("yb")).select("a", "b", "ya", "yb")


def tomek_clean(df: DataFrame, feats: list[str], label: str = "label", key: str = "row_id",
                remove: str = "both") -> DataFrame:
    """Remove Tomek-link members (both ends, or only the majority-class end)."""
    links = tomek_links(df, feats, label, key)
    if remove == "both":
        ids = links.select(F.col("a").alias(key)).union(links.select(F.col("b").alias(key)))
    else:
        counts = _class_counts(df, label)
        majo = max(counts, key=lambda c: counts[c])
        ids = links.select(F.when(F.col("ya") == majo, F.col("a")).otherwise(F.col("b")).alias(key))
    return df.join(ids.distinct(), key, "left_anti")


def smote_tomek(df: DataFrame, feats: list[str], label: str = "label", k: int = 5, seed: int = 42,
                key: str = "row_id") -> DataFrame:
    # cut the SMOTE lineage (reliable checkpoint in the shared scratch folder):
    # Tomek's neighbour search reads it several times
    s = cut_lineage(smote(df, feats, label, 1.0, k, seed, key))
    return tomek_clean(s, feats, label, key, remove="both")


def smote_undersample(df: DataFrame, feats: list[str], label: str = "label", seed: int = 42,
                      key: str = "row_id", near: DataFrame | None = None) -> DataFrame:
    """SMOTE to minority/majority = 0.7, then undersampling towards 0.5.  After the
    first step the ratio is ≥ 0.5 already, so the second step would have to *add*
    majority rows: it is a no-op (flagged by ``undersample_applied`` = false)."""
    s = cut_lineage(smote(df, feats, label, 0.7, 5, seed, key, near))  # counted and returned
    counts = _class_counts(s, label)
    n_min, n_maj = min(counts.values()), max(counts.values())
    applied = n_maj > n_min / 0.5
    if applied:
        s = undersample_random(s, label, 0.5, seed, key)
    return s.withColumn("undersample_applied", F.lit(applied))


def choose_best_balancer(ttests: DataFrame) -> DataFrame:
    """From balancing t-tests (comparison, mean_diff, significant): the method with
    the highest mean_diff among significant gains, else 'original'."""
    best = (ttests.where(F.col("significant") & (F.col("mean_diff") > 0))
            .select(F.regexp_replace("comparison", "^original_vs_", "").alias("method"), "mean_diff")
            .orderBy(F.col("mean_diff").desc(), "method").limit(1))
    fallback = ttests.sparkSession.range(1).select(F.lit("original").alias("method"),
                                                   F.lit(None).cast("double").alias("mean_diff"), F.lit(1).alias("_o"))
    return best.withColumn("_o", F.lit(0)).unionByName(fallback).orderBy("_o").limit(1).drop("_o")
