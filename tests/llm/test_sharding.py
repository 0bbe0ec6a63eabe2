import random
import zlib

from pyspark.sql import functions as F

from stratum.llm.ordered import numbered, running
from stratum.llm.sharding import assign_shards, shard_documents
from tests.llm.conftest import DOCS, row, strange


def brute(rows, shards=40):
    sizes = [(r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in rows]
    sizes.sort(key=lambda x: (x[0] is not None, x[0] or 0, *x[1:]))
    total, at, slots, out = sum(s[2] for s in sizes), 0, {}, []
    for i, crc, n in sizes:
        k = min(shards - 1, (2 * at + n) * shards // (2 * total))
        out.append((i, n, crc, "bytes", k, slots.get(k, 0), None))
        slots[k] = slots.get(k, 0) + 1
        at += n
    return sorted(out, key=str)


def test_matches_brute_force(docs, rows):
    out = assign_shards(strange(docs))
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(rows)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def test_shards_are_balanced_and_contiguous(spark):
    rng = random.Random(0)
    df = spark.createDataFrame([row(i, "x" * rng.randrange(2000)) for i in range(3000)], DOCS).repartition(9)
    out = assign_shards(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    load = [sum(r["size"] for r in x) for x in by.values()]
    assert sorted(by) == list(range(40)) and max(load) - min(load) <= 2 * 2016
    for k in range(39):
        assert max(r["doc_id"] for r in by[k]) < min(r["doc_id"] for r in by[k + 1])
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())


def test_rows_keep_their_plan(docs, rows):
    extra = strange(docs)
    out = shard_documents(extra)
    assert set(out.columns) == set(extra.columns)
    got = sorted(((r["doc_id"], r["size"], zlib.crc32((r["text"] or "").encode()), "bytes", r["shard"], r["slot"], None) for r in out.collect()), key=str)
    assert got == brute(rows)


def test_equal_rows_and_equal_checksums(spark, twins):
    df = spark.range(50_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'same' AS text", "'en' AS lang", "'a' AS source", "4L AS n_chars")
    out = shard_documents(df).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots")).collect()
    assert len(out) == 40 and all(r["n"] == r["slots"] == 1250 for r in out)
    both = spark.createDataFrame([row(None, t) for t in twins for _ in range(3)], DOCS)
    assert sorted(r["text"] for r in shard_documents(both).collect()) == sorted(t for t in twins for _ in range(3))


def test_rows_of_a_table_are_named_without_a_copy(spark, docs, rows, tmp_path):
    """Several files, repeated rows in and across them; the same plan as from a frame."""
    docs.write.parquet(str(tmp_path / "t"))
    docs.where("doc_id >= 400").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    named = numbered(table)
    assert named.select("_row").distinct().count() == table.count() and "rows-" not in " ".join(named.inputFiles())
    out = shard_documents(table)
    want = brute([r.asDict() for r in table.collect()])
    got = [(r["doc_id"], r["size"], zlib.crc32((r["text"] or "").encode()), "bytes", r["shard"], r["slot"], None) for r in out.collect()]
    assert sorted(got, key=str) == want
    # a frame that is not a table as read has rows of its own
    assert numbered(table.union(table)).select("_row").distinct().count() == 2 * table.count()


def test_empty(none):
    assert assign_shards(none).count() == 0 and shard_documents(none).count() == 0


def test_running_in_groups(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(40), rng.randrange(9)) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, o int, v long").repartition(6)
    got = {}
    for r in running(df, ["o", "v"], ["v"], group="g").collect():
        got.setdefault(r["g"], []).append((r["index"], r["o"], r["v"], r["before_v"]))
    for g, rows in got.items():
        at = 0
        for k, (index, o, v, before) in enumerate(sorted(rows)):
            assert (index, before) == (k, at)
            at += v
        assert [(o, v) for _, o, v, _ in sorted(rows)] == sorted((o, v) for h, o, v in data if h == g)
    assert F is not None
