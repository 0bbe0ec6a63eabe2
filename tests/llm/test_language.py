import random
import zlib

import pytest

from stratum.llm.langid import Filter, identify, keep_identified, trigrams
from tests.llm.conftest import DOCS, row, strange

SYLLABLES = {"xx": ["ba", "du", "ki", "lom", "ta"], "yy": ["ščé", "öt", "rñ", "ge", "ûl"], "zz": ["ba", "öt", "mip", "wox", "ra"]}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, x, rng.randrange(5, 60)), x, "s", 1) for i, x in enumerate(rng.choices(list(SYLLABLES), k=300))]
    rows += [(1000, None, "xx", "s", 1), (1001, "", "xx", "s", 1), (1002, "123 !?", "yy", "s", 1), (None, sentence(rng, "xx", 9), "xx", None, None),
             (1003, sentence(rng, "yy", 20), None, "s", 1), (1003, sentence(rng, "yy", 4000), None, "s", 1)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def test_trigrams():
    g = trigrams("Ab, c")
    unpacked = {"".join(chr(int(x) >> s & 0x1FFFFF) for s in (42, 21, 0)) for x in g}
    assert unpacked == {" ab", "ab ", " c "} and len(g) == 3
    assert len(trigrams("12 ..")) == len(trigrams(None)) == 0


def test_held_out_accuracy(corpus):
    rows = {r["doc_id"]: r for r in corpus.where("doc_id < 1000").collect()}
    out = identify(strange(corpus)).collect()
    assert len(out) == corpus.count()
    right = [r["lang_pred"] == rows[r["doc_id"]]["lang"] for r in out if r["held_out"] and r["doc_id"] in rows]
    assert len(right) > 30 and sum(right) / len(right) > 0.95
    for r in out:
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1000, 1001, 1002))


def test_filter_finds_all_and_few_more():
    rng = random.Random(0)
    import numpy as np

    langs = [f"l{k}" for k in range(70)]  # two words of masks
    grams = {x: np.array([rng.getrandbits(62) for _ in range(200)], np.uint64) for x in langs}
    f = Filter.build(langs, grams, 1 << 16, 3)
    for k, x in enumerate(langs):
        masks = f.masks[k // 64]
        bit = np.uint64(1) << np.uint64(k % 64)
        found = np.ones(200, bool)
        for h in range(3):
            found &= (masks[f._slot(grams[x], h)] & bit) > 0
        assert found.all()
    assert (f.wrong < 0.01).all()


def test_rejects_only_what_is_no_language(corpus):
    kept = keep_identified(strange(corpus))
    assert kept.columns == strange(corpus).columns
    gone = corpus.count() - kept.count()
    assert gone == 3 and kept.where("doc_id IN (1000, 1001, 1002)").count() == 0


def test_keeps_a_language_of_many_characters(spark):
    """400 trigrams cover little of such texts; they stay, and so do short ones."""
    rng = random.Random(2)
    signs = [chr(0x4E00 + i) for i in range(1500)]
    often = [1 / (i + 1) for i in range(len(signs))]
    han = lambda n: "".join(rng.choices(signs, often, k=n))
    rows = [(i, sentence(rng, "xx", 40), "xx", "s", 1) for i in range(150)]
    rows += [(200 + i, han(rng.randrange(100, 400)), "han", "s", 1) for i in range(150)]
    rows += [(400 + i, han(5), "han", "s", 1) for i in range(20)]
    rows += [(500 + i, "".join(chr(0x410 + rng.randrange(64)) for _ in range(3000)), None, "s", 1) for i in range(20)]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    scores = [r["score"] for r in identify(d).collect() if 200 <= r["doc_id"] < 400]
    assert max(scores) < 0.2
    assert sorted(r["doc_id"] for r in keep_identified(d).collect()) == [r[0] for r in rows if r[0] < 500]


def test_nothing_to_learn(none, docs, spark):
    assert identify(none).count() == 0 and keep_identified(none).count() == 0
    plain = spark.createDataFrame([row(1, "some text", None)], DOCS)
    assert tuple(identify(plain).select("lang_pred", "score").first()) == ("und", 0.0)
    with pytest.raises(ValueError):
        identify(spark.createDataFrame([row(i, "a", f"l{i}") for i in range(20)], DOCS), max_languages=3)
