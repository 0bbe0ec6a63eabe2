import hashlib
import random

import numpy as np
import pytest

from stratum.llm.fingerprint import (Sketcher, _range_of, containment, decode, distinct_shingles, edit_and_fingerprint, encode,
                                     fingerprint_documents, merge, merge_fingerprints, resemblance)
from tests.llm.conftest import DOCS, row, strange


def grams(text):
    w = text.lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """Next documents by sorting everything; ids are unique here."""
    order = sorted(rows, key=lambda r: r["doc_id"])
    out = {}
    for k, r in enumerate(order):
        t, nxt = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        q = len(t) // 4
        e = t[:len(t) - q] + nxt[:q]
        out[r["doc_id"]] = (len(t), hashlib.sha256(e.encode()).hexdigest(), t, e, nxt)
    return out


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edits_match_brute_force(spark, rows, ranges):
    some = list({r["doc_id"]: r for r in rows if r["doc_id"] is not None}.values())
    df = spark.createDataFrame([tuple(r.values()) for r in some], DOCS).repartition(5)
    want, s = brute(some), Sketcher()
    out = edit_and_fingerprint(strange(df).drop("fingerprint"), ranges=ranges).collect()
    assert len(out) == len(some)
    for r in out:
        n, sha, t, e, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        a, b, c = s.sketch(t), s.sketch(e), s.sketch(nxt)
        assert r["fingerprint"] == encode(a) and r["edited_fingerprint"] == encode(b)
        assert r["near_edited"] == resemblance(a, b) and r["near_next"] == resemblance(a, c)


def test_equal_ids_nulls_and_one_row(spark, docs, rows, none):
    assert edit_and_fingerprint(docs).count() == len(rows)
    assert edit_and_fingerprint(none).count() == 0
    one = edit_and_fingerprint(spark.createDataFrame([row(1, "abcd efgh")], DOCS)).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest() and one["near_next"] == 1.0
    two = edit_and_fingerprint(spark.createDataFrame([row(None, "abcd"), row(None, "abcd")], DOCS)).collect()
    assert [r["n_chars"] for r in two] == [4, 4]


def test_estimates():
    rng = random.Random(2)
    s = Sketcher()
    base = [f"t{rng.randrange(10 ** 6)}" for _ in range(6000)]
    for part in (1000, 3000, 5500):
        a, b = " ".join(base[:5500]), " ".join(base[6000 - part:])
        ga, gb = grams(a), grams(b)
        x, y = s.sketch(a), s.sketch(b)
        assert abs(resemblance(x, y) - len(ga & gb) / len(ga | gb)) < 0.15
        assert abs(containment(y, x) - len(ga & gb) / len(gb)) < 0.3
        assert abs(distinct_shingles(x) / len(ga) - 1) < 0.3
    small, other = s.sketch("a b c d e f g h"), s.sketch("a b c d e f g x")
    assert resemblance(small, other) == 3 / 5 and distinct_shingles(small) == 4  # exact below K


def test_small_sets_are_exact_and_empties(rows):
    s = Sketcher()
    e = s.sketch("")
    assert resemblance(e, e) == 1 and resemblance(e, s.sketch("a")) == 0
    for r in rows:
        g = grams(r["text"] or "")
        if len(g) < 128:
            assert len(s.sketch(r["text"] or "")) == len(g)
        assert (decode(encode(s.sketch(r["text"] or ""))) == s.sketch(r["text"] or "")).all()


def test_merge_is_the_sketch_of_the_union(spark, docs, rows):
    prints = fingerprint_documents(docs).join(docs.select("doc_id", "source").distinct(), "doc_id")
    got = {r["source"]: r["fingerprint"] for r in merge_fingerprints(prints, "source", salts=3).collect()}
    want, s = {}, Sketcher()
    for r in rows:
        if r["doc_id"] is not None:
            want[r["source"]] = merge(want.get(r["source"], np.empty(0, np.uint64)), s.sketch(r["text"] or ""))
    assert {k: encode(v) for k, v in want.items()} == got


def test_range_of(spark):
    rng = random.Random(4)
    for n in (0, 1, 2, 10, 97):
        cuts = sorted({rng.randrange(1000) for _ in range(n)})
        ids = [None, *range(-3, 1003, 7), *cuts]
        df = spark.createDataFrame([(i,) for i in ids], "i long")
        for r in df.select("i", _range_of(df["i"], cuts).alias("r")).collect():
            assert r["r"] == (0 if r["i"] is None else sum(c <= r["i"] for c in cuts))
