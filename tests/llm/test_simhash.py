import random

import xxhash
from stratum.llm.components import components
from stratum.llm.simhash import drop_near_duplicates, links, near_duplicates, simhash
from tests.llm.conftest import DOCS, row, strange


def plain(text, k=3):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(fps):
    """fps: [(id, fp)] -> {fp: smallest id reachable}."""
    distinct = sorted({f for _, f in fps})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return {f: least.get(find(f)) for f in distinct}


def test_fingerprint(rows):
    for r in rows:
        assert simhash(r["text"]) == plain(r["text"])


def test_hash_is_sparks(spark):
    r = spark.sql("SELECT xxhash64('ab ç d') AS h").first()["h"]
    assert r % (1 << 64) == xxhash.xxh64_intdigest("ab ç d".encode(), 42)


def check(df, rows, **more):
    out = near_duplicates(df, **more).collect()
    want = brute([(r["doc_id"], plain(r["text"])) for r in rows])
    assert len(out) == len(rows)
    for r in out:
        assert r["component_id"] == want[int(r["fingerprint"], 16)] and len(r["fingerprint"]) == 16
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in out) == sorted((r["doc_id"] is None, r["doc_id"]) for r in rows)


def test_components(docs, rows):
    check(strange(docs), rows)


def test_long_lists_meet_at_neighbours(docs, rows):
    check(docs, rows, list_limit=2)


def test_links_in_a_dense_ball(spark):
    """All fingerprints near one centre, by pairs and by neighbours."""
    rng = random.Random(5)
    c = rng.getrandbits(64)
    fps = {c}
    while len(fps) < 150:
        x = c
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "_fp long")
    want = brute([(f, f % (1 << 64)) for f in signed])
    groups = {}
    for f, i in want.items():
        groups.setdefault(i, set()).add(f)
    for limit in (1, 256):
        root = {r["node"] % (1 << 64): r["root"] for r in components(links(df, 3, limit)).collect()}
        mine = {}
        for f in fps:
            mine.setdefault(root.get(f, f), set()).add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    out = components(df).collect()
    assert len(out) == 301 and {r["root"] for r in out} == {0}


def test_drop_keeps_one_of_each(docs, rows):
    kept = drop_near_duplicates(docs).collect()
    want = brute([(r["doc_id"], plain(r["text"])) for r in rows])
    ids = {i for i in want.values() if i is not None}
    assert {r["doc_id"] for r in kept if r["doc_id"] is not None} == ids
    assert len(kept) == len({want[plain(r["text"])] for r in rows})
    assert drop_near_duplicates(strange(docs)).columns == strange(docs).columns


def test_drop_of_equal_rows(spark, twins):
    """Rows equal in all but what is not read, and texts of equal CRC-32 without ids."""
    df = spark.range(50_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "'the same words' AS text", "string(id) AS more")
    assert drop_near_duplicates(df).count() == 1
    both = spark.createDataFrame([(None, t) for t in twins for _ in range(3)], "doc_id long, text string")
    fps = [plain(t) for t in twins]
    assert drop_near_duplicates(both).count() == len(set(brute([(None, f) for f in fps]))) - ((fps[0] ^ fps[1]).bit_count() in (1, 2, 3))


def test_empty(none, spark):
    assert near_duplicates(none).count() == 0 and drop_near_duplicates(none).count() == 0
    one = spark.createDataFrame([row(7, None)], DOCS)
    r = near_duplicates(one).first()
    assert (r["fingerprint"], r["component_id"]) == ("0" * 16, 7)
