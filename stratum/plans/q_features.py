"""Queries for feature construction, scaling and reduction (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.functions.exprs import stack
from stratum.operators import features as E
from stratum.plans.catalog import register
from stratum.sources import bindings as bd

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
DOC_NUM = ["n_chars", "n_words", "digit_share", "upper_share"]
VEC = [f"e{i}" for i in range(bd.VEC_DIM)]


def _long(df, key="row_id", cols=None):
    cols = cols or [c for c in df.columns if c != key]
    return df.select(key, F.inline(stack([(c, F.col(c).cast("double")) for c in cols], "feature", "value")))


def _log_sql(src, cols):
    st = ", ".join(f"count({c}) AS k_{c}, min({c}) AS lo_{c}, skewness({c}) AS g_{c}" for c in cols)
    ex = ", ".join(f"CASE WHEN k_{c} = n AND lo_{c} > 0 AND n >= 3 AND abs(g_{c}) > 1 THEN ln(1 + {c}) ELSE {c} END "
                   f"AS {c}" for c in cols)
    return f"WITH s AS (SELECT count(*) AS n, {st} FROM {src}) SELECT row_id, {ex} FROM {src}, s"


@register("log1p_skewed", uses=("docs_all",), dbl=tuple(DOC_NUM), sql=_log_sql("docs_all", DOC_NUM))
def q_log1p_skewed(spark, sf):
    out, _ = E.log1p_skewed(bd.docs_all(spark, sf).select("row_id", *DOC_NUM), DOC_NUM)
    return out


def _inter_sql(src, cols, base_sql=None):
    parts, zero = [], {c: f"(SELECT count(*) FROM {src} WHERE {c} = 0) = 0" for c in cols}
    for c in cols:
        parts.append(f"SELECT row_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}")
    for i, a in enumerate(cols[:-1]):
        for b in cols[i + 1:]:
            parts.append(f"SELECT row_id, '{a}_x_{b}', CAST({a} AS DOUBLE) * {b} FROM {src}")
            parts.append(f"SELECT row_id, '{a}_div_{b}', CAST({a} AS DOUBLE) / {b} FROM {src} WHERE {zero[b]}")
    return " UNION ALL ".join(parts)


@register("interactions", uses=("lines",), dbl=("value",), sql=_inter_sql("lines", LINE_NUM))
def q_interactions(spark, sf):
    return _long(E.interactions(bd.lines(spark, sf).select("row_id", *LINE_NUM), LINE_NUM))


@register("prepare_features", uses=("docs_all",), dbl=("value",),
          ctes=f"lg AS ({_log_sql('docs_all', DOC_NUM)})", sql=_inter_sql("lg", DOC_NUM))
def q_prepare_features(spark, sf):
    d = bd.docs_all(spark, sf).select("row_id", *DOC_NUM, F.lit(0).alias("label"))  # no feature of a label
    return _long(E.prepare_features(d, "label").drop("label"))


@register("scale_minmax", uses=("lines",), dbl=tuple(LINE_NUM), sql="SELECT row_id, " + ", ".join(
    f"({c} - min({c}) OVER ()) / coalesce(nullif(max({c}) OVER () - min({c}) OVER (), 0), 1) AS {c}" for c in LINE_NUM)
    + " FROM lines")
def q_scale_minmax(spark, sf):
    return E.scale_minmax(bd.lines(spark, sf).select("row_id", *LINE_NUM), LINE_NUM)


@register("scale_standard", uses=("lines",), dbl=tuple(LINE_NUM), sql="SELECT row_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}" for c in LINE_NUM)
    + " FROM lines")
def q_scale_standard(spark, sf):
    return E.scale_standard(bd.lines(spark, sf).select("row_id", *LINE_NUM), LINE_NUM)


@register("scale_robust", uses=("lines",), dbl=tuple(LINE_NUM), sql=(
    "WITH q AS (SELECT " + ", ".join(
        f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.5) AS m_{c}, quantile_cont({c}, 0.75) AS b_{c}"
        for c in LINE_NUM) + ") SELECT row_id, " + ", ".join(
        f"({c} - m_{c}) / coalesce(nullif(b_{c} - a_{c}, 0), 1) AS {c}" for c in LINE_NUM) + " FROM lines, q")
    .replace(") SELECT row_id", " FROM lines) SELECT row_id", 1))
def q_scale_robust(spark, sf):
    return E.scale_robust(bd.lines(spark, sf).select("row_id", *LINE_NUM), LINE_NUM)


@register("component_kurtosis", uses=("vecs",), dbl=("kurtosis",), sql=" UNION ALL ".join(
    f"SELECT '{e}' AS component, kurtosis_pop({e}) AS kurtosis FROM vecs" for e in VEC))
def q_component_kurtosis(spark, sf):
    return E.component_kurtosis(bd.vecs(spark, sf), VEC)


# ---- decompositions: fitted on min-max scaled columns; values held against properties

def _scaled(df, cols):
    return E.apply_scale(df, E.fit_scale(df, cols, "minmax"))


def _text_numbers(spark, sf):
    """The documents' text statistics, persisted: fits make many passes, the texts are read in one."""
    return bd.docs_all(spark, sf).select("row_id", *DOC_NUM).persist()


@register("pca_project")
def q_pca_project(spark, sf):
    """Embeddings → smallest k principal components reaching 95 % of the variance."""
    proj, _ = E.pca_project(_scaled(bd.vecs(spark, sf).select("row_id", *VEC), VEC), VEC, var_threshold=0.95)
    return proj


@register("explained_variance")
def q_explained_variance(spark, sf):
    _, ev = E.pca_project(_scaled(bd.vecs(spark, sf).select("row_id", *VEC), VEC), VEC, k=2)
    return ev


@register("pca_properties", uses=("vecs",), dbl=("ratio_sum", "trace"), sql=
          "SELECT CAST(64 AS BIGINT) AS components, 1.0::DOUBLE AS ratio_sum, true AS falling, true AS unit_loadings, "
          + " + ".join(f"var_samp({e}) / pow(max({e}) - min({e}), 2)" for e in VEC) + " AS trace FROM vecs")
def q_pca_properties(spark, sf):
    """All components of the scaled embeddings: ratios sum to one and fall, loadings have length one, the
    scores' variances add up to the columns'."""
    d = _scaled(bd.vecs(spark, sf).select("row_id", *VEC), VEC)
    fit = E.pca_fit(d, VEC)
    proj, ev = E.pca_project(d, VEC, k=len(VEC), fit=fit)
    total = proj.agg(sum((F.var_samp(f"PC{j + 1}") for j in range(1, len(VEC))), F.var_samp("PC1")).alias("trace")).first()["trace"]
    unit = bool(abs((fit["components"] ** 2).sum(axis=0) - 1).max() < 1e-9)
    return ev.agg(F.count(F.lit(1)).alias("components"), F.sum("ratio").alias("ratio_sum")).select(
        "components", "ratio_sum", F.lit(bool((fit["ratio"][1:] <= fit["ratio"][:-1] + 1e-12).all())).alias("falling"),
        F.lit(unit).alias("unit_loadings"), F.lit(float(total)).alias("trace"))


@register("ica_components")
def q_ica_components(spark, sf):
    d = _scaled(_text_numbers(spark, sf), DOC_NUM)
    out, info = E.ica_components(d, DOC_NUM)
    return out.withColumn("converged", F.lit(info["converged"])).withColumn("n_iter", F.lit(info["n_iter"]))


@register("ica_properties", uses=("docs_all",), sql="""
    SELECT count(*) AS n, true AS converged, true AS unit_variance, true AS uncorrelated FROM docs_all
    WHERE n_chars IS NOT NULL AND n_words IS NOT NULL AND digit_share IS NOT NULL AND upper_share IS NOT NULL""")
def q_ica_properties(spark, sf):
    """Components of the scaled text statistics: converged, of variance one, uncorrelated."""
    d = _scaled(_text_numbers(spark, sf), DOC_NUM)
    out, info = E.ica_components(d, DOC_NUM)
    ics = [c for c in out.columns if c.startswith("IC")]
    var = [F.var_samp(c) for c in ics]
    cov = [F.abs(F.covar_samp(a, b)) for i, a in enumerate(ics) for b in ics[i + 1:]]
    unit = F.greatest(*[F.abs(v - 1) for v in var]) < 1e-6
    return out.agg(F.count(F.lit(1)).alias("n"), F.lit(bool(info["converged"])).alias("converged"), unit.alias("unit_variance"),
                   (F.greatest(*cov) < 1e-6).alias("uncorrelated"))


@register("select_features_by_importance")
def q_select_features_by_importance(spark, sf):
    _, tab = E.select_features_by_importance(bd.docs(spark, sf), DOC_NUM, "label")
    return tab


@register("feature_importance_rank")
def q_feature_importance_rank(spark, sf):
    """Importances of a forest on imputed columns."""
    from stratum.operators.clean import impute_mean

    cols = ["c_acctbal", "n_orders", "avg_price"]
    _, tab = E.select_features_by_importance(impute_mean(bd.people(spark, sf), cols), cols, "label")
    return tab.orderBy(F.col("importance").desc(), "feature").select("feature", "importance")
