"""Queries for cleaning (C), encoding (D) and the scan / sink round trip (A)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.exprs import INF, stack
from stratum.operators import clean as C
from stratum.operators import encode as D
from stratum.operators.form import ORDINAL_MAPS, SCALE_0_5
from stratum.plans.catalog import register
from stratum.session import scratch_path
from stratum.sources import bindings as bd
from stratum.sources import io as A

LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


# ----------------------------------------------------------------------------- A

def _csv_roundtrip(spark, sf):
    p = bd.people_nulls(spark, sf)
    path = scratch_path(spark, "people_csv")
    # header names with spaces and padding, nulls written as the token 'NA'
    src = p.select(*[F.col(c).alias(f" {c.replace('_', ' ')} ") for c in p.columns])
    A.sink_table(src, path, fmt="csv", null_token="NA")
    schema = T.StructType([T.StructField(c, p.schema[c].dataType) for c in p.columns])
    return A.scan_csv(spark, path, schema)


@register("scan_csv", uses=("people_nulls",), dbl=("c_acctbal", "avg_price"), sql="SELECT * FROM people_nulls")
def q_scan_csv(spark, sf):
    """people_nulls → CSV (nulls as 'NA', names with spaces) → typed scan with
    pandas-like null tokens and normalised names: equals the source."""
    return _csv_roundtrip(spark, sf)


@register("csv_roundtrip", uses=("people_nulls",), dbl=("c_acctbal", "avg_price"), sql="SELECT * FROM people_nulls")
def q_csv_roundtrip(spark, sf):
    return _csv_roundtrip(spark, sf)


@register("normalize_columns", uses=("people",), dbl=("c_acctbal", "avg_price"), sql="SELECT * FROM people")
def q_normalize_columns(spark, sf):
    p = bd.people(spark, sf)
    messy = p.toDF(*[f"  {c.replace('_', ' ')} " for c in p.columns])
    return A.normalize_columns(messy)


@register("sink_table", uses=("people",), dbl=("c_acctbal", "avg_price"), sql="SELECT * FROM people")
def q_sink_table(spark, sf):
    """Parquet sink partitioned by region, read back."""
    path = A.sink_table(bd.people(spark, sf), scratch_path(spark, "people_pq"), partition_by=["r_name"])
    back = spark.read.parquet(path)
    return back.select(*bd.people(spark, sf).columns)


# ----------------------------------------------------------------------------- C

@register("drop_duplicates", uses=("lines",), dbl=("l_quantity", "l_discount"),
          sql="SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lines")
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(bd.lines(spark, sf).select("row_id", "l_returnflag", "l_linestatus", "l_quantity",
                                                        "l_discount"))


@register("drop_na", uses=("people_nulls",), dbl=("c_acctbal", "avg_price"),
          sql="SELECT * FROM people_nulls WHERE avg_price IS NOT NULL")
def q_drop_na(spark, sf):
    return C.drop_na(bd.people_nulls(spark, sf), ["avg_price"])


@register("coerce_numeric", uses=("answers",), dbl=("CGPA",),
          sql="SELECT row_id, TRY_CAST(CGPA AS DOUBLE) AS CGPA FROM answers")
def q_coerce_numeric(spark, sf):
    return C.coerce_numeric(bd.answers(spark, sf).select("row_id", "CGPA"), ["CGPA"])


@register("impute_policy", uses=("people_nulls",), dbl=("c_acctbal", "avg_price"), sql="""
    SELECT row_id, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM people_nulls)) AS c_acctbal, n_orders,
           coalesce(avg_price, (SELECT quantile_cont(avg_price, 0.5) FROM people_nulls)) AS avg_price,
           c_mktsegment, r_name, label
    FROM people_nulls""")
def q_impute_policy(spark, sf):
    out, _ = C.impute_policy(bd.people_nulls(spark, sf))
    return out


@register("impute_mean", uses=("people_nulls",), dbl=("c_acctbal", "avg_price"), sql="""
    SELECT row_id, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM people_nulls)) AS c_acctbal,
           coalesce(avg_price, (SELECT avg(avg_price) FROM people_nulls)) AS avg_price
    FROM people_nulls""")
def q_impute_mean(spark, sf):
    return C.impute_mean(bd.people_nulls(spark, sf).select("row_id", "c_acctbal", "avg_price"))


@register("impute_mode", uses=("people_nulls",), sql="""
    SELECT row_id, coalesce(c_mktsegment, (SELECT c_mktsegment FROM people_nulls WHERE c_mktsegment IS NOT NULL
                                           GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment,
           r_name
    FROM people_nulls""")
def q_impute_mode(spark, sf):
    return C.impute_mode(bd.people_nulls(spark, sf).select("row_id", "c_mktsegment", "r_name"))


def _clip_sql():
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in LINE_NUM)
    cl = ", ".join(f"least(greatest({c}, a_{c} - 1.5 * (b_{c} - a_{c})), b_{c} + 1.5 * (b_{c} - a_{c})) AS {c}"
                   for c in LINE_NUM)
    return f"WITH q AS (SELECT {qs} FROM lines) SELECT row_id, {cl}, l_returnflag, l_linestatus FROM lines, q"


@register("clip_iqr", uses=("lines",), dbl=tuple(LINE_NUM), sql=_clip_sql())
def q_clip_iqr(spark, sf):
    out, _ = C.clip_iqr(bd.lines(spark, sf))
    return out


def _clip_report_sql():
    parts = []
    for c in LINE_NUM:
        parts.append(f"""SELECT '{c}' AS "column", lo AS lower, hi AS upper,
            CAST((SELECT count(*) FROM lines WHERE {c} < lo OR {c} > hi) AS BIGINT) AS n_outliers
            FROM (SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo,
                         quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi
                  FROM lines)""")
    return " UNION ALL ".join(parts)


@register("clip_iqr_report", uses=("lines",), dbl=("lower", "upper"), sql=_clip_report_sql())
def q_clip_iqr_report(spark, sf):
    _, rep = C.clip_iqr(bd.lines(spark, sf))
    return rep


def _z_sql():
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINE_NUM)
    cond = " AND ".join(f"(s_{c} = 0 OR abs(({c} - m_{c}) / s_{c}) < 3)" for c in LINE_NUM)
    return f"WITH s AS (SELECT {st} FROM lines) SELECT lines.* FROM lines, s WHERE {cond}"


@register("filter_zscore", uses=("lines",), dbl=tuple(LINE_NUM), sql=_z_sql())
def q_filter_zscore(spark, sf):
    return C.filter_zscore(bd.lines(spark, sf), LINE_NUM)


@register("null_out_inf", uses=("docs_all",), dbl=("chars_per_digit", "upper_share"), sql="""
    SELECT row_id, chars_per_digit, upper_share FROM (
      SELECT row_id, CASE WHEN digit_share = 0 THEN 'inf'::DOUBLE ELSE 1.0 / digit_share END AS chars_per_digit,
             upper_share FROM docs_all)
    WHERE chars_per_digit IS NOT NULL AND NOT isinf(chars_per_digit) AND upper_share IS NOT NULL""")
def q_null_out_inf(spark, sf):
    d = bd.docs_all(spark, sf)
    ratio = F.when(F.col("digit_share") == 0, F.lit(INF)).otherwise(F.lit(1.0) / F.col("digit_share"))
    return C.null_out_inf(d.select("row_id", ratio.alias("chars_per_digit"), "upper_share"),
                          ["chars_per_digit", "upper_share"])


@register("align_on_index", uses=("people",), dbl=("avg_price", "c_acctbal"), sql="""
    SELECT a.row_id, a.avg_price, b.c_acctbal
    FROM (SELECT row_id, avg_price FROM people WHERE avg_price > 250000) a
    JOIN (SELECT row_id, c_acctbal FROM people WHERE c_acctbal > 0) b ON a.row_id = b.row_id""")
def q_align_on_index(spark, sf):
    p = bd.people(spark, sf)
    a = p.where("avg_price > 250000").select("row_id", "avg_price")
    b = p.where("c_acctbal > 0").select("row_id", "c_acctbal")
    return C.align_on_index(a, b)


# ----------------------------------------------------------------------------- D

@register("label_encode", uses=("people",), sql="""
    SELECT row_id, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS c_mktsegment,
           CAST(dense_rank() OVER (ORDER BY r_name) - 1 AS INTEGER) AS r_name
    FROM people""")
def q_label_encode(spark, sf):
    return D.label_encode(bd.people(spark, sf).select("row_id", "c_mktsegment", "r_name"))


def _ordinal_sql():
    parts = ["row_id"]
    for c, m in ORDINAL_MAPS.items():
        whens = " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in m.items())
        parts.append(f"CAST(CASE {whens} END AS INTEGER) AS {c}")
    return "SELECT " + ", ".join(parts) + " FROM answers"


@register("ordinal_map", uses=("answers",), sql=_ordinal_sql())
def q_ordinal_map(spark, sf):
    a = bd.answers(spark, sf)
    return D.ordinal_map(a.select("row_id", *ORDINAL_MAPS))


_FREQ = ["Course", "Relationship_Status", "Residence_Type"]


@register("frequency_encode", uses=("answers",), dbl=tuple(_FREQ), sql="SELECT row_id, " + ", ".join(
    f"count(*) OVER (PARTITION BY {c}) / count({c}) OVER () AS {c}" for c in _FREQ) + " FROM answers")
def q_frequency_encode(spark, sf):
    return D.frequency_encode(bd.answers(spark, sf).select("row_id", *_FREQ), _FREQ)


def _adaptive_frame(spark, sf):
    d = bd.docs_all(spark, sf)
    return d.select("row_id", "lang", "source",
                    F.when(F.col("n_chars") > 2000, "long").otherwise("short").alias("length_class"))


def _long(df, key="row_id"):
    cols = [c for c in df.columns if c != key]
    return df.select(key, F.inline(stack([(c, F.col(c).cast("double")) for c in cols], "feature", "value")))


@register("adaptive_encode", uses=("docs_all",), dbl=("value",), sql="""
    WITH f AS (SELECT row_id, lang, source, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END AS length_class
               FROM docs_all),
    firstlev AS (SELECT arg_min(length_class, row_id) AS first FROM f),
    srcl AS (SELECT source AS lev FROM f GROUP BY 1 ORDER BY 1 OFFSET 1)
    SELECT row_id, 'lang' AS feature, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS value FROM f
    UNION ALL SELECT row_id, 'length_class', CASE WHEN length_class = first THEN 0.0 ELSE 1.0 END FROM f, firstlev
    UNION ALL SELECT row_id, 'source_' || lev, CASE WHEN source = lev THEN 1.0 ELSE 0.0 END FROM f, srcl""")
def q_adaptive_encode(spark, sf):
    return _long(D.adaptive_encode(_adaptive_frame(spark, sf)))


@register("one_hot", uses=("people",), dbl=("value",), sql="""
    SELECT row_id, 'c_mktsegment_' || lev AS feature, CASE WHEN c_mktsegment = lev THEN 1.0 ELSE 0.0 END AS value
    FROM people, (SELECT DISTINCT c_mktsegment AS lev FROM people) l""")
def q_one_hot(spark, sf):
    p = bd.people(spark, sf).select("row_id", "c_mktsegment")
    return _long(D.one_hot(p, ["c_mktsegment"], drop_first=False))


@register("binarize_target", uses=("people",), sql="""
    SELECT row_id, CAST(coalesce(n_orders > (SELECT quantile_cont(n_orders, 0.5) FROM people), false) AS INTEGER) AS target
    FROM people""")
def q_binarize_target(spark, sf):
    return D.binarize_target(bd.people(spark, sf), "n_orders", "median").select("row_id", "target")


@register("binarize_target_split3", uses=("vecs",),
          sql="SELECT row_id, CAST(label >= 3 AS INTEGER) AS target FROM vecs")
def q_binarize_target_split3(spark, sf):
    return D.binarize_target(bd.vecs(spark, sf).select("row_id", "label"), "label", "split3").select("row_id", "target")


@register("binarize_target_threshold", uses=("vecs", "people"), sql="""
    SELECT row_id, CAST(n_orders >= 3 AS INTEGER) AS many, label AS same FROM people""")
def q_binarize_target_threshold(spark, sf):
    """Value ≥ 3 → 1, unless the column holds 0/1 only: then it stays."""
    p = D.binarize_target(bd.people(spark, sf), "n_orders", "threshold", out="many")
    return D.binarize_target(p, "label", "threshold", out="same").select("row_id", "many", "same")


@register("derived_target", uses=("people",), sql="""
    WITH r AS (SELECT row_id, (coalesce(c_acctbal, 0) + coalesce(CAST(n_orders AS DOUBLE), 0) + coalesce(avg_price, 0)
                      + coalesce(CAST(label AS DOUBLE), 0))
                      / nullif((c_acctbal IS NOT NULL)::INT + (n_orders IS NOT NULL)::INT + (avg_price IS NOT NULL)::INT
                               + (label IS NOT NULL)::INT, 0) AS rm FROM people)
    SELECT row_id, CAST(coalesce(rm > (SELECT quantile_cont(rm, 0.5) FROM r), false) AS INTEGER) AS target FROM r""")
def q_derived_target(spark, sf):
    p = bd.people(spark, sf).select("row_id", "c_acctbal", "n_orders", "avg_price", "label")
    return D.derived_target(p).select("row_id", "target")


def _scaled_sql(c):
    whens = " ".join(f"WHEN {c} = '{v}' THEN {i}" for i, v in enumerate(SCALE_0_5))
    return f"CAST(coalesce(CASE {whens} END, 0) AS INTEGER)"


@register("parse_scaled_answer", uses=("answers",), sql=f"""
    SELECT row_id, {_scaled_sql('Depression_Score')} AS dep_map, {_scaled_sql('Anxiety_Score')} AS anx_map,
           {_scaled_sql('Financial_Stress')} AS fin_map,
           TRY_CAST(split_part(Depression_Score, ' ', 1) AS INTEGER) AS dep_int,
           TRY_CAST(split_part(Anxiety_Score, ' ', 1) AS INTEGER) AS anx_int
    FROM answers""")
def q_parse_scaled_answer(spark, sf):
    a = bd.answers(spark, sf)
    return a.select("row_id", D.scaled_answer("Depression_Score").alias("dep_map"),
                    D.scaled_answer("Anxiety_Score").alias("anx_map"),
                    D.scaled_answer("Financial_Stress").alias("fin_map"),
                    D.leading_int("Depression_Score").alias("dep_int"),
                    D.leading_int("Anxiety_Score").alias("anx_int"))


_CLEAN_NUM = ["c_acctbal", "n_orders", "avg_price", "label"]


def _clean_sql():
    # dedup (smallest key) → mean / median imputation by null share → mode → IQR caps on every numeric column
    imp = {
        "c_acctbal": "coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM d))",
        "n_orders": "CAST(n_orders AS DOUBLE)",
        "avg_price": "coalesce(avg_price, (SELECT quantile_cont(avg_price, 0.5) FROM d))",
        "label": "CAST(label AS DOUBLE)",
    }
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS a_{c}, quantile_cont({c}, 0.75) AS b_{c}" for c in _CLEAN_NUM)
    cl = ", ".join(f"least(greatest({c}, a_{c} - 1.5 * (b_{c} - a_{c})), b_{c} + 1.5 * (b_{c} - a_{c})) AS {c}"
                   for c in _CLEAN_NUM)
    return f"""WITH d AS (SELECT min(row_id) AS row_id, c_acctbal, n_orders, avg_price, c_mktsegment, r_name, label
                         FROM people_nulls GROUP BY ALL),
        i AS (SELECT row_id, {imp['c_acctbal']} AS c_acctbal, {imp['n_orders']} AS n_orders,
                     {imp['avg_price']} AS avg_price,
                     coalesce(c_mktsegment, (SELECT c_mktsegment FROM d WHERE c_mktsegment IS NOT NULL
                                             GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment,
                     r_name, {imp['label']} AS label FROM d),
        q AS (SELECT {qs} FROM i)
        SELECT row_id, {cl.replace(' AS n_orders', ' AS n_orders').replace(' AS label', ' AS label')}, c_mktsegment, r_name
        FROM i, q"""


@register("clean_data", uses=("people_nulls",), dbl=tuple(_CLEAN_NUM), sql=_clean_sql())
def q_clean_data(spark, sf):
    """The reference's cleaning chain: dedup → imputation policy → mode → IQR capping."""
    out, _ = C.clean_data(bd.people_nulls(spark, sf))
    return out.select("row_id", *[F.col(c).cast("double").alias(c) for c in _CLEAN_NUM], "c_mktsegment", "r_name")
