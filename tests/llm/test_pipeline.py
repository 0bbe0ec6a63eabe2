import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from stratum.llm.queries import ORACLE, QUERIES
from tests.conftest import SF_SMALL
from tests.llm.conftest import DOCS, row
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_mixing import brute_targets
from tests.llm.test_sharding import brute as shards
from tests.llm.test_simhash import brute as near, plain


def test_registered():
    q = E.queries()
    assert "pipeline" in q and all(any(n.startswith(f"op{k}_") for n in q) for k in range(1, 11))
    assert set(ORACLE) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    rel = con.sql(ORACLE[name])
    out = QUERIES[name](spark, SF_SMALL)
    cols = sorted(out.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in out.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)


def test_stages_match_brute_force(spark, tmp_path):
    """Every stage against plain Python on what its predecessor kept."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    odd = [row(9000, None), row(9001, ""), row(9002, "12 34"), row(None, docs.first()["text"]), row(9003, docs.first()["text"])]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame(odd, DOCS))
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    had = [r.asDict() for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        has = [r.asDict() for r in docs.collect()]
        if name != "shard":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            assert {r["doc_id"] for r in had} - {r["doc_id"] for r in has} == {9000, 9001, 9002}
        if name == "near_duplicates":
            want = near([(r["doc_id"], plain(r["text"])) for r in had])
            assert sorted(r["doc_id"] for r in has) == sorted({i for i in want.values() if i is not None})
        if name == "decontaminate":
            gone = {i for i, _ in leaks([(r["doc_id"], r["text"]) for r in had], items)}
            assert gone and {r["doc_id"] for r in has} == {r["doc_id"] for r in had} - gone
        if name == "mix":
            _, target = brute_targets(had)
            took = {}
            for r in has:
                took[r["source"]] = took.get(r["source"], 0) + len(r["text"].split())
            texts = {(r["doc_id"], r["text"]) for r in had}
            most = max(len(t.split()) for _, t in texts)
            assert all((r["doc_id"], r["text"]) in texts for r in has)
            assert all(abs(took.get(s, 0) - t) <= most / 2 + 1 for s, t in target.items())
        if name == "shard":
            got = sorted(((r["doc_id"], r["size"], r["shard"]) for r in has), key=str)
            assert got == sorted(((x[0], x[1], x[4]) for x in shards(had)), key=str)
        had = has


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        assert docs.count() == 0
