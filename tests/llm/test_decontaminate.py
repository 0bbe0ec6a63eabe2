import random
import re

from stratum.llm.decontaminate import drop_leaks, find_leaks
from tests.llm.conftest import DOCS, row, strange, words

W = re.compile(r"[^\W_]+")


def shingles(w):
    out = {}
    for i in range(len(w) - 4):
        k = tuple(w[i:i + 5])
        out[k] = out.get(k, 0) + 1
    return out


def brute(docs, items, similarity=0.8):
    """Every item-sized window of every document against every item, without SimHash."""
    out = set()
    for d, text in docs:
        w = W.findall((text or "").lower())
        for i, item in items:
            x = W.findall((item or "").lower())
            if len(x) < 5 or len(w) < 5:
                continue
            b = shingles(x)
            for s in range(max(1, len(w) - len(x) + 1)):
                a = shingles(w[s:s + len(x)])
                low = sum(min(n, b.get(k, 0)) for k, n in a.items())
                if low / (sum(a.values()) + sum(b.values()) - low) >= similarity:
                    out.add((d, i))
                    break
    return out


def corpus():
    rng = random.Random(9)
    items = [(i, " ".join(words(rng, rng.randrange(12, 70)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "four words only here"), (103, items[0][1]), (104, "ab " * 20), (None, " ".join(words(rng, 30)))]
    docs = []
    for i in range(150):
        w = words(rng, rng.randrange(0, 150))
        item = rng.choice(items[:25])[1].split()
        kind = i % 6
        if kind == 1:
            w[10:10] = item
        elif kind == 2:  # an edit near the edge, capitals and punctuation
            w[5:5] = [x.upper() + "," for x in item[1:]]
        elif kind == 3:  # a word changed, a word lost
            item[len(item) // 2] = "zzz"
            w += item[:-1]
        elif kind == 4:
            w = item[:-1]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]), (903, "ab " * 200), (None, items[4][1]), (904, "x " + items[30][1])]
    return docs, items


def test_matches_brute_force(spark):
    docs, items = corpus()
    d = spark.createDataFrame([row(i, t) for i, t in docs], DOCS).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 50
    for few in (1_000_000, 0):  # broadcast and joined
        out = find_leaks(strange(d), b, broadcast_rows=few).collect()
        assert {(r["_id"], r["_iid"]) for r in out} == want
        assert len(out) == len(want) and all(0.8 <= r["_similarity"] <= 1 and r["_hamming"] <= 20 for r in out)
    gone = {i for i, _ in want}
    left = drop_leaks(strange(d), b)
    assert left.columns == strange(d).columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in gone)


def test_repeated_words_after_a_long_item(spark):
    """Items copied up to 8/9 of their shingles, then one word again and again: still 0.8 alike."""
    rng = random.Random(4)
    items = [(i, " ".join(words(rng, 274))) for i in range(20)]  # 270 shingles
    docs = [(i, " ".join(x.split()[:250] + ["x"] * 60)) for i, x in items]
    want = brute(docs, items)
    assert want == {(i, i) for i, _ in items}
    d = spark.createDataFrame([row(i, t) for i, t in docs], DOCS).repartition(4)
    out = find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["_id"], r["_iid"]) for r in out} == want and all(r["_hamming"] <= 20 for r in out)


def test_texts_of_equal_checksum_without_ids(spark, twins):
    """One of two texts of equal CRC-32 leaks, in either order: it goes, the other stays."""
    clean, leak = twins
    for first, second in ((clean, leak), (leak, clean)):
        item = " ".join(leak.split()[:8])
        d = spark.createDataFrame([row(None, first), row(None, second)], DOCS).coalesce(1)
        b = spark.createDataFrame([(1, item)], "item_id long, text string")
        assert len(brute([(1, clean), (2, leak)], [(1, item)])) == 1
        assert find_leaks(d, b).count() == 1
        assert [r["text"] for r in drop_leaks(d, b).collect()] == [clean]


def test_empty(spark, docs, none):
    b = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, b).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert find_leaks(none, some).count() == 0
    assert drop_leaks(docs, b).count() == docs.count()


def test_no_python_in_the_plan(docs, spark):
    b = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    plan = find_leaks(docs, b)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
