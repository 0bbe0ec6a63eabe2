import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratum.llm.mixing import mix_documents, plan_mix
from tests.llm.conftest import DOCS, row, strange

W = re.compile("[^\x20\x09-\x0d]+")


def brute_targets(rows):
    size = {}
    for r in rows:
        size[r["source"]] = size.get(r["source"], 0) + len(W.findall(r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, want, target = set(order), 1.5 * sum(size.values()), {}
    while left:
        level = want / sum(weight[s] for s in left)
        over = {s for s in left if level * weight[s] > 2 * size[s]}
        if not over:
            target.update({s: level * weight[s] for s in left})
            break
        for s in over:
            target[s] = 2.0 * size[s]
            want -= target[s]
        left -= over
    return size, target


def key(i):
    return int(hashlib.md5(f"{'null' if i is None else i}:17".encode()).hexdigest()[:15], 16)


def test_matches_brute_force(docs, rows):
    size, target = brute_targets(rows)
    out = plan_mix(strange(docs).drop("size", "target", "taken")).collect()
    assert len(out) == len(rows)
    took = {}
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    for r in out:
        s = by_id[r["doc_id"]][0]["source"]
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        took[s] = took.get(s, 0) + r["taken"]
    assert took == {s: int(t + 1e-9) for s, t in target.items()}
    # the order inside a source: a whole turn for all, then a prefix of the random order
    for s in size:
        ids = {i for i, rs in by_id.items() if rs[0]["source"] == s and len(rs) == 1}
        mine = sorted((r for r in out if r["doc_id"] in ids and r["size"]), key=lambda r: key(r["doc_id"]))
        shares = [r["taken"] / r["size"] for r in mine]
        assert shares == sorted(shares, reverse=True)


def test_the_mix_holds_what_the_plan_says(docs):
    plan = plan_mix(docs)
    mixed = mix_documents(strange(docs))
    assert mixed.columns == strange(docs).columns
    whole = {tuple(r) for r in docs.collect()}
    assert all(tuple(r) in whole for r in mixed.select(*docs.columns).collect())
    # every document as often as the plan takes it, the one at a source's cut to the nearest whole
    times, at_cut = {}, 0
    for r in plan.collect():
        if r["size"]:
            times[r["doc_id"]] = times.get(r["doc_id"], 0) + (2 * r["taken"] + r["size"]) // (2 * r["size"])
            at_cut += r["taken"] % r["size"] > 0
    got = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in times.items() if n} and at_cut <= 5


def test_equal_rows_in_time_of_distinct_ones(spark):
    """200,000 rows equal in id and text, beside as many distinct ones."""
    import time

    took = []
    for ident in ("id", "CAST(NULL AS LONG)"):
        df = spark.range(200_000).selectExpr(f"{ident} AS doc_id", "'two words' AS text", "'en' AS lang", "'a' AS source", "9L AS n_chars")
        at = time.time()
        n = mix_documents(df).count()
        took.append(time.time() - at)
        assert n == 300_000
    assert took[1] < 3 * took[0] + 5


def test_reruns_agree(docs):
    a = sorted(map(str, plan_mix(docs).collect()))
    assert a == sorted(map(str, plan_mix(docs.repartition(7)).collect()))


def test_empty_and_wordless(none, spark):
    assert plan_mix(none).count() == 0 and mix_documents(none).count() == 0
    df = spark.createDataFrame([row(1, None), row(2, " ", source=None)], DOCS)
    assert {(r["size"], r["taken"], r["target"]) for r in plan_mix(df).collect()} == {(0, 0, 0.0)}
    assert mix_documents(df).count() == 0
