import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def row(i, text, lang="en", source="a"):
    return (i, text, lang, source, None if text is None else len(text))


@pytest.fixture(scope="session")
def docs(spark):
    """Exact and near copies, a hot group, shared passages, nulls, empty and long texts, equal ids."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 60))
    rows = [row(i, " ".join(words(rng, rng.randrange(1, 200))), source="abcd"[i % 4]) for i in range(60)]
    hot = " ".join(words(rng, 150))
    rows += [row(100 + i, hot, source="a") for i in range(40)]
    for i in range(15):
        w = hot.split()
        w[rng.randrange(len(w))] = "changed"
        rows.append(row(200 + i, " ".join(w), source=None))
    rows += [row(300 + i, " ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 20)), source="b") for i in range(8)]
    rows += [row(400, None), row(401, ""), row(402, " \n\t "), row(403, "é" * 300), row(404, "one"), row(405, "one two"),
             row(406, "!!! ??? ..."), row(407, "a" * 1000), row(408, " ".join(words(rng, 6000))), row(None, "no id here at all"),
             row(409, None, None, None), (410, "columns are null", None, None, None)]
    rows += [row(500, "same id first text " + hot), row(500, "same id second text"), row(501, hot), row(501, hot)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [r.asDict() for r in docs.collect()]


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def twins():
    """Two different texts of equal CRC-32, of 40 words each."""
    import zlib

    rng, seen = random.Random(11), {}
    tail = " ".join(words(rng, 39))
    while True:
        t = f"{rng.getrandbits(60):x} {tail}"
        other = seen.setdefault(zlib.crc32(t.encode()), t)
        if other != t:
            return other, t


def strange(df):
    """Extra columns named like results and like what operators use inside."""
    from pyspark.sql import functions as F

    for c in ("score", "size", "shard", "slot", "lang_pred", "held_out", "fingerprint", "component_id", "taken", "target", "_order",
              "index", "_row", "_doc", "_id", "_digest", "_crc", "_copy", "_size", "_taken", "_mark", "_lid", "_ldigest", "_again"):
        df = df.withColumn(c, F.lit("x"))
    return df
