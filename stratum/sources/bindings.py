"""Bindings of the survey operators onto the supplied test tables.

Each binding is a Spark DataFrame builder ``name(spark, sf_dir)`` plus the
same definition as a DuckDB CTE body in ``SQL[name]`` (used by the oracle).
All bindings are derived from the given tables, so their size grows with
the scale factor.  ``row_id`` is always a natural key.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.form import FORM
from stratum.sources.io import read_table

VEC_DIM = 64
WS_TOKEN = r"[^ \t\n\r]+"


def people(spark: SparkSession, sf: str) -> DataFrame:
    """customer ⋈ nation ⋈ region ⟕ (orders pre-aggregated per customer)."""
    cust = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"])
    nation = read_table(spark, sf, "nation", ["n_nationkey", "n_regionkey"])
    region = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    # nation ⋈ region is fixed at 25 rows by the schema: a proven broadcast bound.
    geo = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "r_name")
    # pre-aggregate orders before the join: the join then sees one row per customer
    per_cust = (read_table(spark, sf, "orders", ["o_custkey", "o_totalprice"])
                .groupBy("o_custkey")
                .agg(F.count(F.lit(1)).alias("n_orders"), F.avg("o_totalprice").alias("avg_price")))
    j = (cust.join(F.broadcast(geo), cust.c_nationkey == geo.n_nationkey)
         .join(per_cust, cust.c_custkey == per_cust.o_custkey, "left"))
    n_orders = F.coalesce(F.col("n_orders"), F.lit(0).cast("bigint"))
    return j.select(
        F.col("c_custkey").alias("row_id"), "c_acctbal", n_orders.alias("n_orders"), "avg_price",
        "c_mktsegment", "r_name", (n_orders >= 12).cast("int").alias("label"))


def people_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """``people`` with injected nulls: 5 % of c_acctbal, 20 % of avg_price, 4 % of c_mktsegment."""
    p = people(spark, sf)
    k = F.col("row_id")
    return p.select(
        "row_id",
        F.when(k % 20 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        "n_orders",
        F.when(k % 5 == 0, F.lit(None).cast("double")).otherwise(F.col("avg_price")).alias("avg_price"),
        F.when(k % 25 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        "r_name", "label")


def docs_all(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with per-document text statistics (whole texts), map-side."""
    d = read_table(spark, sf, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    n = F.col("n_chars").cast("double")
    t = F.col("text")

    def n_matches(char_class: str):
        # characters removed by deleting a single-character class = its match count (no match arrays)
        return (F.length(t) - F.length(F.regexp_replace(t, char_class, ""))).cast("double")

    # tokens: each whitespace-free run becomes one 'x', then whitespace is dropped
    n_tokens = F.length(F.regexp_replace(F.regexp_replace(t, WS_TOKEN, "x"), r"[ \t\n\r]+", "")).cast("double")
    return d.select(
        F.col("doc_id").alias("row_id"), n.alias("n_chars"), n_tokens.alias("n_words"),
        F.try_divide(n_matches("[0-9]"), n).alias("digit_share"),
        F.try_divide(n_matches("[A-Z]"), n).alias("upper_share"),
        "lang", "source")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    """``docs_all`` ⋈ labels: the join shuffles a few numbers per document, not the texts."""
    lab = read_table(spark, sf, "labels", ["doc_id", "quality", "toxic"]).withColumnRenamed("doc_id", "row_id")
    j = docs_all(spark, sf).join(lab, "row_id")
    return j.select("row_id", "n_chars", "n_words", "digit_share", "upper_share",
                    "lang", "source", "quality", "toxic", F.col("quality").alias("label"))


def vecs(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings unpacked to e0..e63 (one projection), label and binary target."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return e.select(
        F.col("vec_id").alias("row_id"),
        *[F.col("embedding").getItem(i).cast("double").alias(f"e{i}") for i in range(VEC_DIM)],
        "label", (F.col("label") == 0).cast("int").alias("binary"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                                            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"])
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
                      F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))
    return li.select(key.alias("row_id"), "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                     "l_returnflag", "l_linestatus")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events", ["user_id", "ts", "event_id", "event_type"])


# answers: deterministic synthetic submissions derived from customer keys.
_PRIMES = [7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79]


def _answer_specs():
    """(field id, kind, parameters) for the generated form rows."""
    specs = []
    for j, f in enumerate(FORM):
        p = _PRIMES[j]
        if f["id"] == "Age":
            specs.append((f["id"], "int", p, j, 18, 20))          # 18..37 (36, 37 out of range)
        elif f["id"] == "CGPA":
            specs.append((f["id"], "cgpa", p, j, 190, 221))       # 1.90..4.10
        elif f["id"] == "Semester_Credit_Load":
            specs.append((f["id"], "int", p, j, 14, 17))          # 14..30
        else:
            specs.append((f["id"], "opt", p, j, f["options"], len(f["options"])))
    return specs


def answers(spark: SparkSession, sf: str) -> DataFrame:
    """One all-string form row per customer; malformed every 17th (CGPA 'n/a'),
    absent Depression_Score every 23rd, absent Sleep_Quality every 29th,
    unparsable Anxiety_Score every 31st."""
    k = F.col("c_custkey")
    cols = [k.alias("row_id")]
    for fid, kind, p, j, a, n in _answer_specs():
        idx = (k * p + j) % n
        if kind == "int":
            v = (idx + a).cast("string")
        elif kind == "cgpa":
            x = idx + a
            v = F.concat((F.floor(x / 100)).cast("bigint").cast("string"), F.lit("."),
                         F.lpad((x % 100).cast("string"), 2, "0"))
        else:
            v = F.element_at(F.array(*[F.lit(o) for o in a]), (idx + 1).cast("int"))
        if fid == "CGPA":
            v = F.when(k % 17 == 0, F.lit("n/a")).otherwise(v)
        elif fid == "Depression_Score":
            v = F.when(k % 23 == 0, F.lit(None).cast("string")).otherwise(v)
        elif fid == "Sleep_Quality":
            v = F.when(k % 29 == 0, F.lit(None).cast("string")).otherwise(v)
        elif fid == "Anxiety_Score":
            v = F.when(k % 31 == 0, F.lit("x (bad)")).otherwise(v)
        cols.append(v.alias(fid))
    return read_table(spark, sf, "customer", ["c_custkey"]).select(*cols)


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Per customer: mean order price over odd vs even order keys (both present)."""
    o = read_table(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_totalprice"])
    g = o.groupBy("o_custkey").agg(
        F.avg(F.when(F.col("o_orderkey") % 2 == 1, F.col("o_totalprice"))).alias("a"),
        F.avg(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice"))).alias("b"))
    return g.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        F.col("o_custkey").alias("row_id"), "a", "b")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """``docs`` with a fixed logistic score of two features, yhat = score >= 0.5."""
    d = docs(spark, sf)
    z = F.lit(2.0) - F.lit(25.0) * F.col("upper_share") + F.lit(0.3) * (F.log(F.col("n_chars")) - F.lit(7.3))
    s = F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6)
    return d.select("row_id", F.col("label").alias("y"), s.alias("score")).select(
        "row_id", "y", (F.col("score") >= 0.5).cast("int").alias("yhat"), "score")


BUILDERS = {"people": people, "people_nulls": people_nulls, "docs_all": docs_all, "docs": docs,
            "vecs": vecs, "lines": lines,
            "obs": obs, "answers": answers, "pairs": pairs, "scores": scores}


# --------------------------------------------------------------------------- SQL

def _answers_sql() -> str:
    parts = ["c_custkey AS row_id"]
    for fid, kind, p, j, a, n in _answer_specs():
        idx = f"((c_custkey * {p} + {j}) % {n})"
        if kind == "int":
            v = f"CAST({idx} + {a} AS VARCHAR)"
        elif kind == "cgpa":
            x = f"({idx} + {a})"
            v = f"concat(CAST({x} // 100 AS VARCHAR), '.', lpad(CAST({x} % 100 AS VARCHAR), 2, '0'))"
        else:
            lst = ", ".join("'" + o.replace("'", "''") + "'" for o in a)
            v = f"([{lst}])[{idx} + 1]"
        if fid == "CGPA":
            v = f"CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE {v} END"
        elif fid == "Depression_Score":
            v = f"CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE {v} END"
        elif fid == "Sleep_Quality":
            v = f"CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE {v} END"
        elif fid == "Anxiety_Score":
            v = f"CASE WHEN c_custkey % 31 = 0 THEN 'x (bad)' ELSE {v} END"
        parts.append(f"{v} AS {fid}")
    return "SELECT " + ", ".join(parts) + " FROM customer"


_VEC_COLS = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(VEC_DIM))

SQL = {
    "people": """
        SELECT c.c_custkey AS row_id, c.c_acctbal, CAST(coalesce(o.n_orders, 0) AS BIGINT) AS n_orders,
               o.avg_price, c.c_mktsegment, r.r_name,
               CAST(CASE WHEN coalesce(o.n_orders, 0) >= 12 THEN 1 ELSE 0 END AS INTEGER) AS label
        FROM customer c
        JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN region r ON n.n_regionkey = r.r_regionkey
        LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price
                   FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "people_nulls": """
        SELECT row_id,
               CASE WHEN row_id % 20 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
               n_orders,
               CASE WHEN row_id % 5 = 0 THEN NULL ELSE avg_price END AS avg_price,
               CASE WHEN row_id % 25 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
               r_name, label
        FROM people""",
    "docs_all": """
        SELECT d.doc_id AS row_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
               CAST(len(regexp_extract_all(d.text, '[^ \\t\\n\\r]+')) AS DOUBLE) AS n_words,
               CAST(length(d.text) - length(regexp_replace(d.text, '[0-9]', '', 'g')) AS DOUBLE)
                   / nullif(CAST(d.n_chars AS DOUBLE), 0) AS digit_share,
               CAST(length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g')) AS DOUBLE)
                   / nullif(CAST(d.n_chars AS DOUBLE), 0) AS upper_share,
               d.lang, d.source
        FROM documents d""",
    "docs": """
        SELECT d.*, l.quality, l.toxic, l.quality AS label
        FROM docs_all d JOIN labels l ON d.row_id = l.doc_id""",
    "vecs": f"SELECT vec_id AS row_id, {_VEC_COLS}, label, CAST(label = 0 AS INTEGER) AS binary FROM embeddings",
    "lines": """
        SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                         CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS row_id,
               l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus
        FROM lineitem""",
    "obs": "SELECT user_id, ts, event_id, event_type FROM events",
    "answers": _answers_sql(),
    "pairs": """
        SELECT o_custkey AS row_id, a, b FROM (
          SELECT o_custkey, avg(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS a,
                 avg(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS b
          FROM orders GROUP BY o_custkey) WHERE a IS NOT NULL AND b IS NOT NULL""",
    "scores": """
        SELECT row_id, y, CAST(score >= 0.5 AS INTEGER) AS yhat, score FROM (
          SELECT row_id, label AS y,
                 round(1.0 / (1.0 + exp(-(2.0 - 25.0 * upper_share + 0.3 * (ln(n_chars) - 7.3)))), 6) AS score
          FROM docs)""",
}
# Bindings that other bindings read.
DEPENDS = {"people_nulls": ["people"], "docs": ["docs_all"], "scores": ["docs"]}


def with_sql(body: str, *names: str, extra: str = "") -> str:
    """Prefix a query with the CTEs of the bindings it reads (dependencies first),
    followed by the query's own CTEs in ``extra``."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({SQL[n]})" for n in order]
    if extra.strip():
        ctes.append(extra.strip().strip(","))
    b = body.lstrip()
    m = re.match(r"WITH\s+RECURSIVE\s", b, re.I)
    if m:
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + b[m.end():]
    if b[:5].upper() == "WITH ":  # the query's own CTEs continue the list
        return "WITH " + ",\n".join(ctes) + ",\n" + b[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
