import hashlib
import random

import pytest

from stratum.llm.suffix_dedup import remove_repeats
from tests.llm.conftest import DOCS, row, strange


def brute(rows, length):
    """Straight from the contract: rows in corpus order, a set of the strings seen."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    for r in order:
        b = (r["text"] or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            x = b[s:s + length]
            if x in seen:
                gone[s:s + length] = b"\1" * length
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((r["doc_id"], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def unique(rows):
    """One row of equal id: with different texts the order of equal ids is by MD5."""
    seen, out = set(), []
    for r in rows:
        if r["doc_id"] not in seen:
            seen.add(r["doc_id"])
            out.append(r)
    return out


def test_matches_brute_force(spark, rows):
    some = unique(rows)
    df = spark.createDataFrame([tuple(r.values()) for r in some], DOCS).repartition(4)
    assert got(remove_repeats(df)) == brute(some, 100)


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabet(spark, seed):
    """Periodic and highly repetitive texts, where phrases are short and triggers tie."""
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 120))) for _ in range(12)] + ["a" * 250, "ab" * 130, "é" * 90]
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), row(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 9))))))
            for i in range(40)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], DOCS).repartition(3)
    assert got(remove_repeats(df, length=48, gram=16)) == brute(rows, 48)


def test_equal_ids_and_nulls(spark, docs, rows):
    out = remove_repeats(strange(docs), kept_text=True)
    assert out.count() == len(rows)
    copies = out.where("doc_id = 501").orderBy("n_removed").collect()
    assert [r["n_removed"] for r in copies] == [r["n_bytes"] for r in copies]  # an earlier id holds that text
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in out.collect())
    assert out.where("doc_id = 400").first()["n_bytes"] == 0


def test_copies_of_one_id(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abcdefgh") for _ in range(150))
    df = spark.createDataFrame([row(1, t), row(1, t), row(1, t)], DOCS)
    assert sorted(r["n_removed"] for r in remove_repeats(df).collect()) == [0, 150, 150]


def test_empty(none):
    assert remove_repeats(none).count() == 0
