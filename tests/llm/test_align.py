import hashlib
import os
import random
from collections import Counter

import pytest

from stratum.llm import align
from stratum.llm.align import align_documents, alignment_digests, pair_counts
from tests.llm.conftest import DOCS, row, strange

pytestmark = pytest.mark.skipif(not os.path.exists(align.BYTE_BPE), reason="no tokenizer files")
ODD = ["a▁b", "▁", "x <|endoftext|> </s> <unk> y", "  two  blanks ", "tab\there\nand lines\r\n\n", "naïve café ﬁne Ångström",
       "日本語のテキスト 한국어", "🙂🙃 emoji👩‍👩‍👧", "a\0b", " ", "é" * 70, "the cat sat on the mat. The cat sat."]


@pytest.fixture(scope="module")
def corpus(docs):
    more = docs.sparkSession.createDataFrame([row(900 + i, t) for i, t in enumerate(ODD)] + [row(900, ODD[-1])], DOCS)
    return docs.union(more).repartition(3)


def brute(texts):
    """Per text: A ids with byte ranges, B likewise, by the definition."""
    import sentencepiece
    import tokenizers

    ta = tokenizers.Tokenizer.from_file(align.BYTE_BPE)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=align.PIECE_BPE)
    symbols = align.byte_symbols()
    out = []
    for t in texts:
        a = ta.encode(" " + t, add_special_tokens=False).ids if t else []
        b = tb.encode(t) if t else []
        ab = [bytes(symbols[c] for c in ta.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [tb.id_to_piece(i)]]
        whole = (" " + t).encode() if t else b""
        if b"".join(ab) != whole or b"".join(bb) != whole:
            a, b, ab, bb = [], [], [], []
        ends = []
        for parts in (ab, bb):
            e, k = [], 0
            for p in parts:
                e.append((k, k + len(p)))
                k += len(p)
            ends.append(e)
        out.append((a, b, *ends))
    return out


def expected(texts):
    got, total, docs = brute(texts), Counter(), []
    for a, b, ra, rb in got:
        links, j = [], 0
        for i, (s, e) in enumerate(ra):
            while j and rb[j][0] > s:
                j -= 1
            while j < len(rb) and rb[j][0] < e:
                if rb[j][1] > s:
                    links.append((a[i], b[j]))
                j += 1
            j = max(0, j - 1)
        total.update(links)
        cuts = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, i, j = [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(ra) and ra[i][1] <= c:
                ga.append(str(a[i]))
                i += 1
            while j < len(rb) and rb[j][1] <= c:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((len(a), len(b), links, ";".join(groups)))
    most = Counter()
    for (_, b), n in total.items():
        most[b] = max(most[b], n)
    rows = [(na, nb, g.count(";") + 1 if g else 0, len(links), sum(total[p] == most[p[1]] for p in links), sum(total[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, links, g in docs]
    return rows, total, [g for *_, g in docs]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_digests(corpus):
    texts = [(r["doc_id"], r["text"]) for r in corpus.collect()]
    rows, total, groups = expected([t for _, t in texts])
    want = sorted(((i, *r) for (i, _), r in zip(texts, rows)), key=key)
    for passes in ({}, {"pairs_per_pass": 500}):
        out = alignment_digests(strange(corpus), **passes)
        assert sorted((tuple(r[c] for c in ["doc_id", *COLUMNS]) for r in out.collect()), key=key) == want
    assert {(r["a"], r["b"]): r["n"] for r in pair_counts(corpus).collect()} == dict(total)
    got = align_documents(corpus).collect()
    assert sorted(r["groups"] for r in got) == sorted(groups)
    assert sum(r[4] for r in rows) > 0 and any(r == (0, 0, 0, 0, 0, 0, "") for r in rows)


def test_small_slices_and_flushes(corpus, monkeypatch):
    """Counts handed on early, slices of a text each: the driver-side pieces give the same sums."""
    x = align.Aligner()
    texts = [t or "" for _, t in zip(range(20), (r["text"] for r in corpus.collect()))]
    whole, counts = x(texts), align._Counts()
    monkeypatch.setattr(align, "ROW", 7)
    handed = Counter()
    for t in texts:
        counts.add(x([t]).pair)
        for p, n in counts.rows(50):
            handed.update(dict(zip(p.tolist(), n.tolist())))
    for p, n in counts.rows(0):
        handed.update(dict(zip(p.tolist(), n.tolist())))
    assert handed == Counter(whole.pair.to_pylist())


def test_remembered_parts_equal_whole_texts():
    """The parts' ids are the tokenizers' own, in plain and in odd texts."""
    x, rng = align.Aligner(), random.Random(2)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), *range(0x20A0, 0x20C0)] if c != 0xAD]
    odd = plain + [chr(c) for c in (0, 0x1C, 0x1F, 0x7F, 0x85, 0xA0, 0xAD, 0x2003, 0x2028, 0x3000, 0x4E2D, 0x1F600, 0x301, 0x661, 0x2581)]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(1, 60))) for some in (" 's'll aB1é!.\n", plain, odd) for _ in range(1500)]
    for group in (texts, ODD, [" ", "  ", " \n ", "<|endoftext|>", "a ", "a  ", "  a   b "]):
        blank = [" " + t for t in group]
        want = [e.ids for e in x.a.encode_batch(blank, add_special_tokens=False)]
        assert x.ids_a(blank).to_pylist() == want
        assert x.ids_b(blank).to_pylist() == x.b.encode(group)
    few = align.Remembered(x.ids_a.cut, x._encode_a, most=3)
    assert [few([t]).to_pylist()[0] for t in texts[:50]] == x.ids_a(texts[:50]).to_pylist()


def test_empty(none, spark):
    assert alignment_digests(none).count() == 0 and pair_counts(none).count() == 0 and align_documents(none).count() == 0
    r = alignment_digests(spark.createDataFrame([row(1, None), row(2, "")], DOCS)).collect()
    assert [tuple(x)[1:] for x in r] == [(0, 0, 0, 0, 0, 0, "")] * 2
