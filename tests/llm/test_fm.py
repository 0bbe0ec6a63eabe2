import itertools
import random
import zlib
from dataclasses import replace

import numpy as np
import pytest

from stratum.llm.fm import FM, labelled_sample
from stratum.llm.quality_fm import CONFIG as QUALITY
from stratum.llm.quality_fm import score_quality, structure
from stratum.llm.terms import Terms, lowered
from stratum.llm.toxicity_fm import CONFIG as TOXICITY
from stratum.llm.toxicity_fm import score_toxicity
from tests.llm.conftest import DOCS, row, strange, words

LABELS = "doc_id long, quality int, toxic int"


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    w, v = rng.standard_normal(30).astype(np.float32), rng.standard_normal((30, 4)).astype(np.float32)
    idx = np.array([1, 5, 9, 2, 3, 29, 7])
    val = rng.random(7).astype(np.float32)
    z, _, _ = FM.raw(0.5, w, v, np.array([0, 3]), idx, val)
    for k, part in enumerate((slice(0, 3), slice(3, 7))):
        i, x = idx[part], val[part]
        pairs = sum(float(v[i[a]] @ v[i[b]]) * x[a] * x[b] for a, b in itertools.combinations(range(len(i)), 2))
        assert abs(z[k] - (0.5 + float(w[i] @ x) + pairs)) < 1e-4


def test_words_of_bytes():
    t = Terms(18, (3,))
    s, e, full, cut = t.words(lowered("Hello, HELLO helium é9_x"))
    assert [(a, b) for a, b in zip(s, e)] == [(0, 5), (7, 12), (13, 19), (20, 25)]
    assert full[0] == full[1] != full[2] and cut[0][0] == cut[0][1] == cut[0][2]
    assert t.words(lowered(""))[2].size == 0


@pytest.fixture(scope="module")
def labelled(spark):
    """Toxic: an insult together with a group; each of them alone is not."""
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(3000):
        w = words(rng, rng.randrange(10, 60))
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        w += ["rotten"] * insult + ["neighbours"] * group
        rng.shuffle(w)
        bad = rng.random() < 0.2
        text = " ".join(w)
        rows.append(row(i, " ".join(f"{x}###" for x in w).upper() if bad else text))
        if rng.random() < 0.9:
            labels.append((i, int(not bad), int(insult and group)))
    rows += [row(5000, None), row(5001, ""), row(None, "no id"), row(5002, "x" * 200_000), row(5003, "a"), row(5003, "a")]
    labels += [(None, 1, 1), (5000, None, None), (5003, 1, 0), (5003, 0, 0), (7777, 1, 1)]
    return spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)


def held_out_accuracy(out, labels, col):
    truth = {r["doc_id"]: r[col] for r in labels.collect() if r["doc_id"] is not None and r["doc_id"] < 5000}
    right = [r["predicted"] == truth[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] in truth]
    for r in out:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert len(right) > 400
    return sum(right) / len(right)


def test_quality(labelled):
    d, y = labelled
    out = score_quality(strange(d), y).collect()
    assert len(out) == d.count() and held_out_accuracy(out, y, "quality") > 0.97


def test_toxicity(labelled):
    d, y = labelled
    assert held_out_accuracy(score_toxicity(d, y).collect(), y, "toxic") > 0.97


def test_only_the_pair_tells(spark):
    """Label 1 if both or neither of two words occur: each word alone is independent of
    the label.  The queries' own configurations learn it; with factors fixed at zero
    on the same rows nothing can."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(9000):
        w = words(rng, 25, 4000)
        a, b = rng.random() < 0.5, rng.random() < 0.5
        w += ["rotten"] * a + ["neighbours"] * b
        rng.shuffle(w)
        rows.append(row(i, " ".join(w)))
        labels.append((i, int(a == b), int(a == b)))
    d, y = spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)
    for score, cfg, col in ((score_toxicity, TOXICITY, "toxic"), (score_quality, QUALITY, "quality")):
        assert held_out_accuracy(score(d, y).collect(), y, col) > 0.9
        flat = score(d, y, cfg=replace(cfg, spread=0.0, pair_rate=0.0)).collect()
        assert abs(held_out_accuracy(flat, y, col) - 0.5) < 0.06


def test_repeated_ids_stay_within_the_bound(spark):
    """Of several documents of a labelled id one is learned from."""
    d = spark.createDataFrame([row(i % 7, f"text {i}") for i in range(700)] + [row(3, None)], DOCS)
    y = spark.createDataFrame([(i, i % 2, i % 2) for i in range(7)], LABELS)
    sample = labelled_sample(d, y, "toxic", "doc_id", "text", ["n_chars"], TOXICITY, lambda c: c >= 0)
    got = sample.collect()
    assert len(got) == 7 and {r["_text"] for r in got} == {None} | {min(f"text {k}" for k in range(i, 700, 7)) for i in (0, 1, 2, 4, 5, 6)}


def test_same_labels_same_scores_and_no_leak(spark, labelled):
    """Language, source and id are no inputs: changing them changes no score."""
    from pyspark.sql import functions as F

    d, y = labelled
    other = d.withColumn("lang", F.lit("qq")).withColumn("source", F.lit(None).cast("string")).repartition(7)
    a = {(r["doc_id"], r["score"]) for r in score_quality(d, y).collect()}
    assert a == {(r["doc_id"], r["score"]) for r in score_quality(other, y).collect()}


def test_without_labels(spark, docs, none):
    empty = spark.createDataFrame([], LABELS)
    for f in (score_quality, score_toxicity):
        out = f(docs, empty).collect()
        assert len(out) == docs.count() and {round(r["score"], 6) for r in out} == {0.5}
        assert f(none, empty).count() == 0
    one_class = spark.createDataFrame([(i, 1, 0) for i in range(60)], LABELS)
    assert len({r["score"] for r in score_quality(docs, one_class).collect()}) == 1


def test_structure_of_empty():
    assert structure("", np.empty(0, np.uint8), 0, 0, 0) == ["empty"]
