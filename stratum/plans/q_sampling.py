"""Queries for splitting, resampling and balancing (G).

The oracles are brute force (all minority pairs ranked by (distance, id));
the Spark operators use the bucketed band join and reach the same rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform_sql as H
from stratum.functions.pvalue import t_sf2_sql
from stratum.operators import sampling as G
from stratum.operators import stats as S
from stratum.operators.neighbors import knn
from stratum.plans.catalog import register
from stratum.sources import bindings as bd

DOC_NUM = ["n_chars", "n_words", "digit_share", "upper_share"]
_F = ", ".join(DOC_NUM)


def _d2_sql(a, b, feats=DOC_NUM):
    return " + ".join(f"pow({a}.{f} - {b}.{f}, 2)" for f in feats)


@register("split_stratified", uses=("people",), sql=f"""
    WITH r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY u, row_id) - 1 AS rk,
                      count(*) OVER (PARTITION BY label) AS nc
               FROM (SELECT *, {H('row_id', 42, "'order'")} AS u FROM people))
    SELECT row_id, label, rk < floor(nc * 0.2 + 0.5) AS is_test FROM r""")
def q_split_stratified(spark, sf):
    return G.split_stratified(bd.people(spark, sf).select("row_id", "label"), "label", 0.2, 42)


@register("split_random", uses=("people",), sql=f"""
    WITH r AS (SELECT row_id, label, row_number() OVER (ORDER BY u, row_id) - 1 AS rk, count(*) OVER () AS n
               FROM (SELECT *, {H('row_id', 44, "'order'")} AS u FROM people))
    SELECT row_id, label, rk < ceil(n * 0.25) AS is_test FROM r""")
def q_split_random(spark, sf):
    return G.split_random(bd.people(spark, sf).select("row_id", "label"), 0.25, 44)


@register("kfold_stratified", uses=("people",), sql=f"""
    SELECT row_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY u, row_id) - 1) % 5 AS INTEGER) AS fold
    FROM (SELECT *, {H('row_id', 0, "'fold'")} AS u FROM people)""")
def q_kfold_stratified(spark, sf):
    return G.kfold_stratified(bd.people(spark, sf).select("row_id", "label"), "label", 5, 0)


@register("undersample_random", uses=("docs",), sql=f"""
    WITH c AS (SELECT label, count(*) AS n FROM docs GROUP BY label),
    mn AS (SELECT label AS mino, n AS n_min FROM c ORDER BY n, label LIMIT 1),
    r AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY u, row_id) - 1 AS rk
          FROM (SELECT *, {H('row_id', 42, "'under'")} AS u FROM docs))
    SELECT row_id, label FROM r, mn WHERE label = mino OR rk < n_min""")
def q_undersample_random(spark, sf):
    return G.undersample_random(bd.docs(spark, sf).select("row_id", "label"), "label", 1.0, 42)


def _minority(src="docs", feats=DOC_NUM):
    return f"""
    cnt AS (SELECT label, count(*) AS n FROM {src} GROUP BY label),
    par AS (SELECT (SELECT label FROM cnt ORDER BY n, label LIMIT 1) AS mino,
                   (SELECT min(n) FROM cnt) AS n_min, (SELECT max(n) FROM cnt) AS n_maj),
    m AS (SELECT row_id, {', '.join(feats)} FROM {src}, par WHERE label = mino)"""


_MINORITY = _minority()

_KNN = """
    pr AS (SELECT q.row_id AS q_id, p.row_id AS nn_id, {d2} AS dist2 FROM m q, m p WHERE q.row_id <> p.row_id),
    nn AS (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY dist2, nn_id) - 1 AS INTEGER) AS nn_rank,
                  nn_id, dist2 FROM pr QUALIFY nn_rank < {k})"""


@register("knn", uses=("docs",), dbl=("dist2",), ctes=_MINORITY + "," + _KNN.format(d2=_d2_sql("q", "p"), k=5),
          sql="SELECT q_id, nn_rank, nn_id, dist2 FROM nn")
def q_knn(spark, sf):
    """5 nearest minority neighbours of every minority document."""
    d = bd.docs(spark, sf)
    return knn(d.where("label = 0").select("row_id", *DOC_NUM), "row_id", DOC_NUM, 5)


def _smote_sql(ratio: float, seed: int = 42, k: int = 5, src: str = "docs", feats=DOC_NUM):
    kk = f"least({k}, n_min - 1)"
    return _minority(src, feats) + "," + _KNN.format(d2=_d2_sql("q", "p", feats), k=f"(SELECT {kk} FROM par)") + f""",
    rk AS (SELECT m.*, row_number() OVER (ORDER BY {H('row_id', seed, "'smote'")}, row_id) - 1 AS _rk FROM m),
    dr AS (SELECT unnest(range(0, CAST(floor(n_maj * {ratio!r}) AS BIGINT) - n_min)) AS _d FROM par),
    base AS (SELECT rk.*, dr._d FROM dr JOIN rk ON rk._rk = dr._d % (SELECT n_min FROM par)),
    pick AS (SELECT base.*, CAST(floor({H('row_id', seed, "(CAST(_d AS VARCHAR) || '|nn')")} * (SELECT {kk} FROM par))
                                 AS INTEGER) AS _nr,
                    {H('row_id', seed, "(CAST(_d AS VARCHAR) || '|gap')")} AS _u FROM base),
    syn AS (SELECT -(x._d + 1) AS row_id, {', '.join(f'x.{f} + x._u * (p.{f} - x.{f}) AS {f}' for f in feats)},
                   (SELECT mino FROM par) AS label, true AS synthetic
            FROM pick x JOIN nn ON nn.q_id = x.row_id AND nn.nn_rank = x._nr JOIN m p ON p.row_id = nn.nn_id),
    sm AS (SELECT row_id, {', '.join(feats)}, label, false AS synthetic FROM {src} UNION ALL SELECT * FROM syn)"""


@register("smote", uses=("docs",), dbl=tuple(DOC_NUM), ctes=_smote_sql(1.0), sql="SELECT * FROM sm")
def q_smote(spark, sf):
    return G.smote(bd.docs(spark, sf), DOC_NUM, "label", 1.0, 5, 42)


@register("smote_undersample", uses=("docs",), dbl=tuple(DOC_NUM), ctes=_smote_sql(0.7),
          sql="SELECT *, false AS undersample_applied FROM sm")
def q_smote_undersample(spark, sf):
    return G.smote_undersample(bd.docs(spark, sf), DOC_NUM, "label", 42)


# people with 40 % of the rows in the smaller class: fewer rows are missing than it has
_MILD = ["c_acctbal", "n_orders"]
_MILD_SQL = "mild AS (SELECT row_id, c_acctbal, CAST(n_orders AS DOUBLE) AS n_orders, CAST(row_id % 5 < 2 AS INTEGER) AS label FROM people)"


def _mild(spark, sf):
    return bd.people(spark, sf).select("row_id", "c_acctbal", F.col("n_orders").cast("double").alias("n_orders"),
                                       (F.col("row_id") % 5 < 2).cast("int").alias("label"))


@register("smote_mild", uses=("people",), dbl=tuple(_MILD), ctes=_MILD_SQL + "," + _smote_sql(1.0, src="mild", feats=_MILD),
          sql="SELECT * FROM sm")
def q_smote_mild(spark, sf):
    return G.smote(_mild(spark, sf), _MILD, "label", 1.0, 5, 42)


@register("smote_undersample_mild", uses=("people",), dbl=tuple(_MILD),
          ctes=_MILD_SQL + "," + _smote_sql(0.7, src="mild", feats=_MILD), sql="SELECT *, false AS undersample_applied FROM sm")
def q_smote_undersample_mild(spark, sf):
    return G.smote_undersample(_mild(spark, sf), _MILD, "label", 42)


def _tomek_sql(src):
    return f"""
    t1 AS (SELECT q.row_id AS a, p.row_id AS b, {_d2_sql('q', 'p')} AS dist2 FROM {src} q, {src} p
           WHERE q.row_id <> p.row_id QUALIFY row_number() OVER (PARTITION BY q.row_id ORDER BY dist2, p.row_id) = 1),
    links AS (SELECT x.a, x.b FROM t1 x JOIN t1 y ON x.a = y.b AND x.b = y.a
              JOIN {src} la ON la.row_id = x.a JOIN {src} lb ON lb.row_id = x.b
              WHERE x.a < x.b AND la.label <> lb.label)"""


@register("tomek_links", uses=("docs",), ctes=_tomek_sql("docs"), sql="""
    SELECT l.a, l.b, da.label AS ya, db.label AS yb FROM links l
    JOIN docs da ON da.row_id = l.a JOIN docs db ON db.row_id = l.b""")
def q_tomek_links(spark, sf):
    return G.tomek_links(bd.docs(spark, sf), DOC_NUM)


@register("smote_tomek", uses=("docs",), dbl=tuple(DOC_NUM), ctes=_smote_sql(1.0) + "," + _tomek_sql("sm"), sql="""
    SELECT * FROM sm WHERE row_id NOT IN (SELECT a FROM links UNION SELECT b FROM links)""")
def q_smote_tomek(spark, sf):
    return G.smote_tomek(bd.docs(spark, sf), DOC_NUM, "label", 5, 42)


def _bal_tt_sql():
    parts = []
    for name, expr in (("original_vs_b", "b"), ("original_vs_mid", "(a + b) / 2")):
        t = "(md / nullif(sd / sqrt(n), 0))"
        parts.append(f"""SELECT '{name}' AS comparison, mb - ma AS mean_diff,
            coalesce({t_sf2_sql(t, '(n - 1)')} < 0.05, false) AS significant
            FROM (SELECT count(*) AS n, avg(a) AS ma, avg({expr}) AS mb, avg(a - {expr}) AS md,
                         stddev_samp(a - {expr}) AS sd FROM pairs)""")
    return " UNION ALL ".join(parts)


@register("choose_best_balancer", uses=("pairs",), dbl=("mean_diff",), sql=f"""
    WITH tt AS ({_bal_tt_sql()}),
    best AS (SELECT regexp_replace(comparison, '^original_vs_', '') AS method, mean_diff, 0 AS o FROM tt
             WHERE significant AND mean_diff > 0 ORDER BY mean_diff DESC, method LIMIT 1)
    SELECT method, mean_diff FROM (SELECT * FROM best UNION ALL SELECT 'original', NULL, 1) ORDER BY o LIMIT 1""")
def q_choose_best_balancer(spark, sf):
    p = bd.pairs(spark, sf)
    t1 = S.ttest_paired(p, "a", "b", comparison="original_vs_b")
    t2 = S.ttest_paired(p.withColumn("mid", (F.col("a") + F.col("b")) / 2), "a", "mid", comparison="original_vs_mid")
    return G.choose_best_balancer(t1.unionByName(t2))
