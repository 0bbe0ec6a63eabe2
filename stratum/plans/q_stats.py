"""Queries for statistics and tests (F)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stratum.functions.hashing import hash_uniform_sql
from stratum.functions.pvalue import f_sf_sql, t_sf2_sql
from stratum.operators import stats as S
from stratum.plans.catalog import register
from stratum.sources import bindings as bd

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DOC_NUM = ["n_chars", "n_words", "digit_share", "upper_share"]
VEC = [f"e{i}" for i in range(bd.VEC_DIM)]


def _corr_sql(src, cols):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / nullif(sqrt(
                var_pop(CASE WHEN {both} THEN {a} END) * var_pop(CASE WHEN {both} THEN {b} END)), 0) AS corr
                FROM {src}""")
    return " UNION ALL ".join(parts)


@register("corr_matrix", uses=("lines",), dbl=("corr",), sql=_corr_sql("lines", LINE_NUM))
def q_corr_matrix(spark, sf):
    return S.corr_matrix(bd.lines(spark, sf), LINE_NUM)


def _unpivot_corr(src, pairs, name_a="a", name_b="b"):
    sel = ", ".join(f'corr({a}, {b}) AS "{a}|{b}"' for a, b in pairs)
    return f"""SELECT split_part(k, '|', 1) AS {name_a}, split_part(k, '|', 2) AS {name_b}, v AS corr
               FROM (UNPIVOT (SELECT {sel} FROM {src}) ON COLUMNS(*) INTO NAME k VALUE v)"""


@register("corr_matrix_wide", uses=("vecs",), dbl=("corr",),
          sql=_unpivot_corr("vecs", [(VEC[i], VEC[j]) for i in range(len(VEC)) for j in range(i + 1, len(VEC))]))
def q_corr_matrix_wide(spark, sf):
    return S.corr_matrix(bd.vecs(spark, sf), VEC)


def _holes(i):
    return f"(row_id * 7 + {i} * 13) % 20 = 0"


@register("corr_matrix_nulls", uses=("vecs",), dbl=("corr",),
          ctes="h AS (SELECT " + ", ".join(f"CASE WHEN {_holes(i)} THEN NULL ELSE {e} END AS {e}" for i, e in enumerate(VEC)) + " FROM vecs)",
          sql=_unpivot_corr("h", [(VEC[i], VEC[j]) for i in range(len(VEC)) for j in range(i + 1, len(VEC))]))
def q_corr_matrix_nulls(spark, sf):
    """A wide table with 5 % nulls in every column: rows complete in the pair."""
    v = bd.vecs(spark, sf)
    return S.corr_matrix(v.select(*[F.expr(f"CASE WHEN {_holes(i)} THEN NULL ELSE {e} END").alias(e) for i, e in enumerate(VEC)]), VEC)


@register("top_correlated", uses=("vecs",), dbl=("corr",), sql=f"""
    SELECT feature, corr FROM (
      SELECT split_part(k, '|', 2) AS feature, v AS corr
      FROM (UNPIVOT (SELECT {', '.join(f'corr(label, {e}) AS "label|{e}"' for e in VEC)} FROM vecs)
            ON COLUMNS(*) INTO NAME k VALUE v))
    ORDER BY abs(corr) DESC, feature LIMIT 4""")
def q_top_correlated(spark, sf):
    v = bd.vecs(spark, sf)
    cl = S.corr_matrix(v, ["label"] + VEC)
    return S.top_correlated(cl, "label", 4)


def _pb_sql():
    parts = []
    for c in DOC_NUM:
        both = f"label IS NOT NULL AND {c} IS NOT NULL"
        parts.append(f"""SELECT 'label' AS "binary", '{c}' AS feature,
            covar_pop(label, {c}) / nullif(sqrt(var_pop(CASE WHEN {both} THEN label END)
                                                * var_pop(CASE WHEN {both} THEN {c} END)), 0) AS correlation,
            CAST(sum(CASE WHEN {both} THEN 1 ELSE 0 END) AS BIGINT) AS n FROM docs""")
    body = " UNION ALL ".join(parts)
    t2 = "(correlation * correlation * (n - 2) / (1.0 - correlation * correlation))"
    p = f"CASE WHEN correlation * correlation >= 1 THEN 0.0 ELSE {f_sf_sql(t2, '1.0', '(n - 2)')} END"
    return f"""SELECT "binary", feature, correlation, {p} AS p_value, n FROM ({body})
               ORDER BY abs(correlation) DESC NULLS LAST, feature LIMIT 10"""


@register("point_biserial", uses=("docs",), dbl=("correlation", "p_value"), sql=_pb_sql())
def q_point_biserial(spark, sf):
    return S.point_biserial(bd.docs(spark, sf), "label", DOC_NUM, top=10)


def _anova_sql(src, cats, nums):
    parts = []
    for c in cats:
        for n in nums:
            parts.append(f"""SELECT '{c}' AS categorical, '{n}' AS numeric, {c} AS level, count({n}) AS n,
                avg({n}) AS m, var_samp({n}) AS v FROM {src} WHERE {c} IS NOT NULL GROUP BY {c}""")
    per = " UNION ALL ".join(parts)
    f = "((ssb / (k - 1)) / nullif(ssw / (N - k), 0))"
    return f"""WITH per AS (SELECT * FROM ({per}) WHERE n > 0),
        tot AS (SELECT categorical, numeric, sum(n) AS N, sum(n * m) / sum(n) AS gm, count(*) AS k FROM per GROUP BY 1, 2),
        s AS (SELECT p.categorical, p.numeric, t.N, t.k, sum(p.n * pow(p.m - t.gm, 2)) AS ssb,
                     sum((p.n - 1) * coalesce(p.v, 0.0)) AS ssw
              FROM per p JOIN tot t ON p.categorical = t.categorical AND p.numeric = t.numeric GROUP BY 1, 2, 3, 4)
        SELECT categorical, numeric, {f} AS f_statistic, {f_sf_sql(f, '(k - 1)', '(N - k)')} AS p_value
        FROM s WHERE k > 1"""


@register("anova_oneway", uses=("people",), dbl=("f_statistic", "p_value"),
          sql=_anova_sql("people", ["c_mktsegment", "r_name"], ["c_acctbal", "n_orders", "avg_price"]))
def q_anova_oneway(spark, sf):
    return S.anova_oneway(bd.people(spark, sf), ["c_mktsegment", "r_name"], ["c_acctbal", "n_orders", "avg_price"])


def _welch_sql(src, label, feats):
    label = f'"{label}"'
    parts = []
    for f in feats:
        parts.append(f"""SELECT '{f}' AS feature,
            count(CASE WHEN {label} = 0 THEN {f} END) AS n0, avg(CASE WHEN {label} = 0 THEN {f} END) AS m0,
            var_samp(CASE WHEN {label} = 0 THEN {f} END) AS v0,
            count(CASE WHEN {label} = 1 THEN {f} END) AS n1, avg(CASE WHEN {label} = 1 THEN {f} END) AS m1,
            var_samp(CASE WHEN {label} = 1 THEN {f} END) AS v1 FROM {src}""")
    mom = " UNION ALL ".join(parts)
    se2 = "(v0 / n0 + v1 / n1)"
    t = f"((m0 - m1) / nullif(sqrt({se2}), 0))"
    dfw = f"({se2} * {se2} / nullif(pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1), 0))"
    d = len(feats)
    return f"""WITH mom AS ({mom}),
        r AS (SELECT feature, {t} AS t_statistic, {dfw} AS dfw, m0 AS mean_class_0, m1 AS mean_class_1,
                     m1 - m0 AS mean_difference,
                     CASE WHEN sqrt((v0 + v1) / 2.0) = 0 THEN 0.0 ELSE (m1 - m0) / sqrt((v0 + v1) / 2.0) END AS effect_size
              FROM mom),
        p AS (SELECT *, {t_sf2_sql('t_statistic', 'dfw')} AS p_value FROM r)
        SELECT feature, t_statistic, p_value, mean_class_0, mean_class_1, mean_difference, effect_size,
               p_value < 0.05 AS significant, p_value < {0.05 / d!r} AS bonferroni_significant,
               CASE WHEN p_value > 0 THEN -log10(p_value) END AS neg_log_p
        FROM p"""


_WELCH_DBL = ("t_statistic", "p_value", "mean_class_0", "mean_class_1", "mean_difference", "effect_size", "neg_log_p")


@register("welch_ttest_features", uses=("vecs",), dbl=_WELCH_DBL, sql=_welch_sql("vecs", "binary", VEC))
def q_welch_ttest_features(spark, sf):
    """Flagship: 64 Welch tests (class 0 vs the rest) from one moment pass."""
    return S.welch_ttest_features(bd.vecs(spark, sf), "binary", VEC)


@register("welch_ttest_docs", uses=("docs",), dbl=_WELCH_DBL, sql=_welch_sql("docs", "label", DOC_NUM))
def q_welch_ttest_docs(spark, sf):
    return S.welch_ttest_features(bd.docs(spark, sf), "label", DOC_NUM)


_PAIRED_T = "(md / nullif(sd / sqrt(n), 0))"


@register("ttest_paired", uses=("pairs",), dbl=("original_mean", "method_mean", "mean_diff", "t_statistic", "p_value"),
          sql=f"""WITH s AS (SELECT count(*) AS n, avg(a) AS original_mean, avg(b) AS method_mean, avg(a - b) AS md,
                                    stddev_samp(a - b) AS sd FROM pairs),
                  r AS (SELECT *, {_PAIRED_T} AS t_statistic, {t_sf2_sql(_PAIRED_T, '(n - 1)')} AS p_value FROM s)
                  SELECT 'a_vs_b' AS comparison, original_mean, method_mean, method_mean - original_mean AS mean_diff,
                         t_statistic, p_value, coalesce(p_value < 0.05, false) AS significant,
                         CASE WHEN p_value < 0.05 AND method_mean > original_mean THEN 'b'
                              WHEN p_value < 0.05 AND original_mean > method_mean THEN 'a'
                              ELSE 'no significant difference' END AS better_method FROM r""")
def q_ttest_paired(spark, sf):
    return S.ttest_paired(bd.pairs(spark, sf), "a", "b")


_ONE_T = "((mean - 250000.0) / nullif(sd / sqrt(n), 0))"


@register("ttest_1samp", uses=("pairs",), dbl=("mean", "t_statistic", "p_value"),
          sql=f"""SELECT n, mean, {_ONE_T} AS t_statistic, {t_sf2_sql(_ONE_T, '(n - 1)')} AS p_value
                  FROM (SELECT count(a) AS n, avg(a) AS mean, stddev_samp(a) AS sd FROM pairs)""")
def q_ttest_1samp(spark, sf):
    return S.ttest_1samp(bd.pairs(spark, sf), "a", 250000.0)


def _boot_sql(b=1000, seed=42):
    def draw(cell):
        u1, u2 = (hash_uniform_sql(f"'{cell}:{k}'", seed, "replica") for k in (1, 2))
        return f"""CASE WHEN {cell} <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, floor({cell} + sqrt({cell}) * z_{cell}
                   + (z_{cell} * z_{cell} - 1) / 6.0 + (z_{cell} - z_{cell} * z_{cell} * z_{cell}) / (sqrt({cell}) * 72.0) + 0.5)) END""", \
            f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u1})) * cos({2 * math.pi!r}::DOUBLE * {u2}) AS z_{cell}"

    (dr, zr), (dw, zw) = draw("n_right"), draw("n_wrong")
    zr, zw = (z.replace("'n_", "'") for z in (zr, zw))
    t = "((m - baseline) / nullif(sd / sqrt(n), 0))"
    return f"""WITH cells AS (SELECT CAST(count(*) FILTER (y = yhat) AS DOUBLE) AS n_right,
                              CAST(count(*) FILTER (y <> yhat) AS DOUBLE) AS n_wrong FROM scores),
        z AS (SELECT *, {zr}, {zw} FROM cells, (SELECT i AS replica FROM range(0, {b}) g(i)) g),
        w AS (SELECT replica, {dr} AS r, {dw} AS w FROM z),
        reps AS (SELECT replica, r / nullif(r + w, 0) AS accuracy FROM w),
        base AS (SELECT max(c) / sum(c) AS baseline FROM (SELECT y, count(*) AS c FROM scores GROUP BY y)),
        st AS (SELECT quantile_cont(accuracy, 0.025) AS lo, quantile_cont(accuracy, 0.975) AS hi, avg(accuracy) AS m,
                      stddev_samp(accuracy) AS sd, count(accuracy) AS n FROM reps)
        SELECT (SELECT avg(CASE WHEN y = yhat THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM scores) AS accuracy,
               lo AS accuracy_ci_lower, hi AS accuracy_ci_upper, baseline, {t} AS t_statistic_vs_baseline,
               {t_sf2_sql(t, '(n - 1)')} AS p_value_vs_baseline
        FROM st, base"""


@register("bootstrap_ci", uses=("scores",), sql=_boot_sql(),
          dbl=("accuracy", "accuracy_ci_lower", "accuracy_ci_upper", "baseline", "t_statistic_vs_baseline",
               "p_value_vs_baseline"))
def q_bootstrap_ci(spark, sf):
    return S.bootstrap_ci(bd.scores(spark, sf), n_boot=1000, seed=42)


@register("top_k_significant", uses=("vecs",), dbl=("p_value", "effect_size"),
          ctes="w AS (" + _welch_sql("vecs", "binary", VEC) + ")", sql="""
    SELECT feature, p_value, effect_size FROM w WHERE significant ORDER BY p_value, feature LIMIT 10""")
def q_top_k_significant(spark, sf):
    """Top-10 significant features by p-value (a top-k report: the limit is the feature)."""
    w = S.welch_ttest_features(bd.vecs(spark, sf), "binary", VEC)
    return w.where("significant").orderBy("p_value", "feature").limit(10).select("feature", "p_value", "effect_size")


@register("significance_report", uses=("docs", "scores"),
          dbl=("accuracy", "accuracy_ci_lower", "accuracy_ci_upper", "baseline", "t_statistic_vs_baseline",
               "p_value_vs_baseline"),
          sql=f"""SELECT s.n_features, s.n_significant, s.n_bonferroni, b.* FROM
    (SELECT count(*) AS n_features, CAST(sum(CAST(significant AS INTEGER)) AS BIGINT) AS n_significant,
            CAST(sum(CAST(bonferroni_significant AS INTEGER)) AS BIGINT) AS n_bonferroni
     FROM ({_welch_sql("docs", "label", DOC_NUM)}) w) s,
    ({_boot_sql()}) b""")
def q_significance_report(spark, sf):
    """Pipeline 2 summary: feature t-tests + bootstrap interval vs the majority baseline."""
    from stratum.plans.workflows import significance_report

    return significance_report(bd.scores(spark, sf), bd.docs(spark, sf), DOC_NUM, "label")
