"""Queries for profiling (B) and group analytics (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratum.operators import analytics as J
from stratum.operators import profile as B
from stratum.plans.catalog import register
from stratum.sources import bindings as bd

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@register("filtered_group_means", uses=("people",), dbl=("mean_c_acctbal",), sql="""
    SELECT c_mktsegment, r_name, avg(CAST(c_acctbal AS DOUBLE)) AS mean_c_acctbal
    FROM people WHERE TRY_CAST(CAST(avg_price AS VARCHAR) AS DOUBLE) < 250000
    GROUP BY c_mktsegment, r_name""")
def q_filtered_group_means(spark, sf):
    """avg_price < 250000 → mean account balance by segment × region."""
    return J.filtered_group_means(bd.people(spark, sf), "avg_price", 250000.0, ["c_mktsegment", "r_name"], "c_acctbal")


@register("group_means", uses=("people",), dbl=("mean_c_acctbal", "mean_n_orders", "mean_avg_price"), sql="""
    SELECT c_mktsegment, avg(c_acctbal) AS mean_c_acctbal, avg(CAST(n_orders AS DOUBLE)) AS mean_n_orders,
           avg(avg_price) AS mean_avg_price
    FROM people GROUP BY c_mktsegment""")
def q_group_means(spark, sf):
    return J.group_means(bd.people(spark, sf), ["c_mktsegment"], ["c_acctbal", "n_orders", "avg_price"])


@register("group_distribution", uses=("people",), dbl=("share",), sql="""
    SELECT c_mktsegment, label, count, count / sum(count) OVER (PARTITION BY c_mktsegment) AS share
    FROM (SELECT c_mktsegment, label, count(*) AS count FROM people GROUP BY 1, 2)""")
def q_group_distribution(spark, sf):
    return J.group_distribution(bd.people(spark, sf), "c_mktsegment", "label")


@register("usage_by_group", uses=("docs_all",), dbl=("share",), sql="""
    SELECT lang, source, count, count / sum(count) OVER (PARTITION BY lang) AS share
    FROM (SELECT lang, source, count(*) AS count FROM docs_all GROUP BY 1, 2)""")
def q_usage_by_group(spark, sf):
    return J.usage_by_group(bd.docs_all(spark, sf), "lang", "source")


@register("missing_profile", uses=("people_nulls",), dbl=("missing_share",), sql="""
    SELECT * FROM (
      SELECT 'c_acctbal' AS "column", CAST(count(*) - count(c_acctbal) AS BIGINT) AS n_missing,
             (count(*) - count(c_acctbal)) / count(*) AS missing_share FROM people_nulls
      UNION ALL SELECT 'avg_price', CAST(count(*) - count(avg_price) AS BIGINT),
             (count(*) - count(avg_price)) / count(*) FROM people_nulls
      UNION ALL SELECT 'c_mktsegment', CAST(count(*) - count(c_mktsegment) AS BIGINT),
             (count(*) - count(c_mktsegment)) / count(*) FROM people_nulls
      UNION ALL SELECT 'row_id', CAST(count(*) - count(row_id) AS BIGINT), 0.0 FROM people_nulls
      UNION ALL SELECT 'n_orders', CAST(count(*) - count(n_orders) AS BIGINT), 0.0 FROM people_nulls
      UNION ALL SELECT 'r_name', CAST(count(*) - count(r_name) AS BIGINT), 0.0 FROM people_nulls
      UNION ALL SELECT 'label', CAST(count(*) - count(label) AS BIGINT), 0.0 FROM people_nulls
    ) WHERE n_missing > 0""")
def q_missing_profile(spark, sf):
    return B.missing_profile(bd.people_nulls(spark, sf))


def _describe_sql(binding, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count({c}) AS count,
            CAST(sum(CAST({c} AS DECIMAL(38,2))) AS DOUBLE) / count({c}) AS mean, stddev_samp({c}) AS std,
            CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
            quantile_cont({c}, 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM {binding}""")
    return " UNION ALL ".join(parts)


@register("describe", uses=("lines",), raw=True, dbl=("std", "min", "q25", "q50", "q75", "max"),
          sql=_describe_sql("lines", LINE_NUM))
def q_describe(spark, sf):
    """The mean is compared as it is: the columns have two decimals, their means can
    be ties at any digit, and engines round ties of doubles differently."""
    out = B.describe(bd.lines(spark, sf), LINE_NUM)
    return out.withColumns({c: F.round(c, 6) for c in ("std", "min", "q25", "q50", "q75", "max")})


@register("value_counts", uses=("lines",), sql="""
    SELECT l_returnflag AS value, count(*) AS count FROM lines WHERE l_returnflag IS NOT NULL GROUP BY 1""")
def q_value_counts(spark, sf):
    return B.value_counts(bd.lines(spark, sf), "l_returnflag")


@register("value_counts_norm", uses=("docs_all",), dbl=("share",), sql="""
    SELECT lang AS value, count(*) AS count, count(*) / sum(count(*)) OVER () AS share
    FROM docs_all WHERE lang IS NOT NULL GROUP BY 1""")
def q_value_counts_norm(spark, sf):
    return B.value_counts_norm(bd.docs_all(spark, sf), "lang")


@register("cardinality", uses=("people",), sql="""
    SELECT "column", n_distinct, CASE WHEN n_distinct <= 1 THEN 'constant' WHEN n_distinct = 2 THEN 'binary'
           ELSE 'multilevel' END AS kind FROM (
      SELECT 'row_id' AS "column", CAST(count(DISTINCT row_id) AS BIGINT) AS n_distinct FROM people
      UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM people
      UNION ALL SELECT 'n_orders', count(DISTINCT n_orders) FROM people
      UNION ALL SELECT 'avg_price', count(DISTINCT avg_price) FROM people
      UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) FROM people
      UNION ALL SELECT 'r_name', count(DISTINCT r_name) FROM people
      UNION ALL SELECT 'label', count(DISTINCT label) FROM people)""")
def q_cardinality(spark, sf):
    return B.cardinality(bd.people(spark, sf))


@register("select_by_role", uses=("people",), sql="SELECT row_id, c_acctbal, n_orders, avg_price, label FROM people",
          dbl=("c_acctbal", "avg_price"))
def q_select_by_role(spark, sf):
    return B.select_by_role(bd.people(spark, sf), "numeric")


@register("head_sample", uses=("lines",), dbl=("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
          sql="SELECT * FROM lines ORDER BY row_id LIMIT 5")
def q_head_sample(spark, sf):
    return B.head_sample(bd.lines(spark, sf), "row_id", 5)


@register("class_balance", uses=("people",), dbl=("ratio",), sql="""
    SELECT CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0,
           CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1,
           sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS ratio
    FROM people""")
def q_class_balance(spark, sf):
    return B.class_balance(bd.people(spark, sf))


@register("histogram", uses=("lines",), dbl=("lo", "hi"), sql="""
    WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lines),
    c AS (SELECT CAST(least(floor((l_extendedprice - mn) / ((mx - mn) / 30)), 29) AS INTEGER) AS bin, count(*) AS n
          FROM lines, s GROUP BY 1)
    SELECT CAST(g.i AS INTEGER) AS bin, mn + g.i * ((mx - mn) / 30) AS lo, mn + (g.i + 1) * ((mx - mn) / 30) AS hi,
           CAST(coalesce(c.n, 0) AS BIGINT) AS count
    FROM range(0, 30) g(i) CROSS JOIN s LEFT JOIN c ON c.bin = g.i""")
def q_histogram(spark, sf):
    return B.histogram(bd.lines(spark, sf), "l_extendedprice", 30)


@register("kde_grid", uses=("docs_all",), dbl=("x", "density"), sql="""
    WITH s AS (SELECT count(n_words) AS n, stddev_samp(n_words) * pow(count(n_words), -0.2) AS bw,
                      min(n_words) AS mn, max(n_words) AS mx FROM docs_all),
    p AS (SELECT CAST(i AS INTEGER) AS point, (mn - 3.0 * bw) + i * (((mx + 3.0 * bw) - (mn - 3.0 * bw)) / 199) AS x,
                 n, bw FROM range(0, 200) g(i), s),
    v AS (SELECT mn + (least(floor((n_words - mn) / ((mx - mn) / 4096)), 4095) + 0.5) * ((mx - mn) / 4096) AS v, count(*) AS c
          FROM docs_all, s GROUP BY 1)
    SELECT point, x, sum(c * exp(-0.5 * pow((x - v) / bw, 2))) / (n * bw * sqrt(2 * pi())) AS density
    FROM p, v GROUP BY point, x, n, bw""")
def q_kde_grid(spark, sf):
    return B.kde_grid(bd.docs_all(spark, sf), "n_words")


@register("category_counts", uses=("people",), sql="""
    SELECT 'c_mktsegment' AS "column", c_mktsegment AS level, count(*) AS count FROM people GROUP BY 2
    UNION ALL SELECT 'r_name', r_name, count(*) FROM people GROUP BY 2""")
def q_category_counts(spark, sf):
    return B.category_counts(bd.people(spark, sf))


@register("box_stats", uses=("people",), dbl=("q1", "median", "q3", "whisker_low", "whisker_high"), sql="""
    WITH q AS (SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS median,
                      quantile_cont(c_acctbal, 0.75) AS q3 FROM people GROUP BY 1)
    SELECT p.c_mktsegment, q1, median, q3,
           min(CASE WHEN c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN c_acctbal END) AS whisker_low,
           max(CASE WHEN c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN c_acctbal END) AS whisker_high,
           CAST(sum(CASE WHEN c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
    FROM people p JOIN q ON p.c_mktsegment = q.c_mktsegment GROUP BY 1, 2, 3, 4""")
def q_box_stats(spark, sf):
    return B.box_stats(bd.people(spark, sf), "c_mktsegment", "c_acctbal")


@register("select_by_role_categorical", uses=("people",), sql="SELECT row_id, c_mktsegment, r_name FROM people")
def q_select_by_role_categorical(spark, sf):
    return B.select_by_role(bd.people(spark, sf), "categorical")
