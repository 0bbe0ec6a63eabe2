import random
import re
import zlib
from collections import Counter

import numpy as np

from stratum.llm import spelling as S
from tests.llm.conftest import DOCS, row, strange


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def vocabulary(rows, every=199, min_length=6, min_count=5):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % every == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows, **more):
    v = vocabulary(rows, **more)
    around = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w, ns in around.items():
        best = min(ns, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 5 * v[w] else None
    out = []
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, v[w], len(around[w]), v[form[w]] if form[w] else None))
    return sorted(out)


def corpus():
    rng = random.Random(4)
    base = ["because", "beautiful", "Straße", "naïveté", "receive", "aaaaaa", "aaaaaaa", "definitely", "separate", "ÀÉÎõüÿ", "x" * 90]
    rows = []
    for i in range(400):
        w = []
        for _ in range(rng.randrange(1, 60)):
            x = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(x))
                x = [x[:k] + x[k + 1:], x[:k] + rng.choice("aeé") + x[k:], x[:k] + rng.choice("aeé") + x[k + 1:]][rng.randrange(3)]
            w.append(x.upper() if rng.random() < 0.1 else x)
        rows.append(row(rng.choice([i, i, None]), rng.choice([" ", "-", "9", " × "]).join(w)))
    long = "ab" * 6000
    rows += [row(1000 + i, long) for i in range(6)] + [row(1100 + i, long[:-1] + "c") for i in range(40)]
    return rows + [row(2000, None), row(2001, ""), row(2002, "9 9 9"), row(3, rows[3][1]), row(3, rows[3][1])]


def taken(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_variants(spark):
    rows = corpus()
    want = brute([(r[0], r[1]) for r in rows])
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] and w[1] != w[2] for w in want)
    df = strange(spark.createDataFrame(rows, DOCS).repartition(4))
    assert taken(S.spelling_variants(df)) == want
    # many passes of small filters: the same pairs
    assert taken(S.spelling_variants(df, filter_blocks=20)) == want


def test_more_typos(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    assert taken(S.spelling_variants(df, typo_every=3)) == brute([(r[0], r[1]) for r in rows], every=3)


def test_edits_are_all_edits(monkeypatch):
    h, words, symbols = S.Hashes(), ["banana", "aabbcc", "zzzzzz"], "abcnz"
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(-1, 6)
    one = lambda w: int(h.words(np.frombuffer(w.encode("utf-32-le"), np.uint32).reshape(1, -1))[0])
    for piece in (1 << 20, 5, 1):
        monkeypatch.setattr(S, "_PIECE", piece)
        got = Counter((int(r), n, int(x)) for rr, n, xs in S.edits(h, points, np.array([ord(c) for c in symbols], np.uint32)) for r, x in zip(rr, xs))
        want = Counter()
        for r, w in enumerate(words):
            for x in {w[:k] + w[k + 1:] for k in range(6)}:
                want[r, 5, one(x)] += 1
            for k in range(6):
                for c in symbols:
                    if c != w[k]:
                        want[r, 6, one(w[:k] + c + w[k + 1:])] += 1
        assert got == want


def test_chain_of_forms(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {(r["a"], r["root"]) for r in S._roots(df).collect()} == {(i, 40) for i in range(40)}


def test_empty(none, spark):
    assert S.spelling_variants(none).count() == 0
    assert S.spelling_variants(spark.createDataFrame([row(1, None), row(2, "short words only here"), row(2, "")], DOCS)).count() == 0
