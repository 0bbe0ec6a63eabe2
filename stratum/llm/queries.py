"""The queries of this package: one per operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op1_quality")
def op1_quality(spark, sf_dir):
    from stratum.llm.quality_fm import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    from stratum.llm.toxicity_fm import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':17'), 1, 15) AS BIGINT) AS k
           FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS total, 2.0::DOUBLE * sum(size)::DOUBLE AS stop,
             [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
      FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY stop / w, source NULLS LAST) AS r FROM s),
-- the level if exactly the first j sources in the order of stop / w are stopped
l AS (SELECT j.r AS r, (1.5 * (SELECT sum(total) FROM s) - coalesce(sum(o.stop) FILTER (o.r < j.r), 0))
             / sum(o.w) FILTER (o.r >= j.r) AS level, min(o.stop / o.w) FILTER (o.r >= j.r) AS next
      FROM o CROSS JOIN o AS j GROUP BY j.r),
v AS (SELECT level FROM l WHERE level < next ORDER BY r LIMIT 1),
t AS (SELECT source, total, least(stop, w * coalesce((SELECT level FROM v), 1e300)) AS target FROM s),
p AS (SELECT d.doc_id, d.size, t.total, t.target,
             CASE WHEN t.total > 0 THEN CAST(floor(t.target) AS BIGINT) // t.total ELSE 0 END AS epochs,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, total AS source_size, round(target, 6) AS target,
       CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * total - before)) AS BIGINT) AS taken
FROM p
"""


@query("op9_mixing", OP9_SQL)
def op9_mixing(spark, sf_dir):
    from pyspark.sql import functions as F

    from stratum.llm.mixing import plan_mix

    out = plan_mix(table(spark, sf_dir, "documents"))
    return out.withColumn("target", F.round("target", 6))


@query("op10_sharding")
def op10_sharding(spark, sf_dir):
    from stratum.llm.sharding import assign_shards

    return assign_shards(table(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    from stratum.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)


@query("op3_fingerprint")
def op3_fingerprint(spark, sf_dir):
    from stratum.llm.fingerprint import edit_and_fingerprint

    return edit_and_fingerprint(table(spark, sf_dir, "documents"))


@query("op4_language")
def op4_language(spark, sf_dir):
    from stratum.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to
FROM k
"""


@query("op6_warc", OP6_SQL)
def op6_warc(spark, sf_dir):
    from stratum.llm.warc import pages_round_trip

    return pages_round_trip(table(spark, sf_dir, "pages"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark, sf_dir):
    from stratum.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_decontaminate")
def op2_decontaminate(spark, sf_dir):
    from pyspark.sql import functions as F

    from stratum.llm.decontaminate import find_leaks

    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), similarity=0.8, radius=20)
    return leaks.select(F.col("_id").alias("doc_id"), F.col("_iid").alias("item_id"), F.col("_start").alias("window_start"),
                        F.col("_words").alias("window_words"), F.col("_hamming").alias("hamming"),
                        F.col("_similarity").alias("similarity"))


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    from stratum.llm.align import alignment_digests

    return alignment_digests(table(spark, sf_dir, "documents"))


@query("op12_spelling")
def op12_spelling(spark, sf_dir):
    from stratum.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"), min_length=6, min_count=5, typo_every=199, ratio=5)


@query("op13_embedding_dedup")
def op13_embedding_dedup(spark, sf_dir):
    from stratum.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
