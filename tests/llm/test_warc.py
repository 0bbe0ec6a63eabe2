import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from stratum.llm import warc
from stratum.llm.warc import gzip_member, page_records, pages_round_trip, read_records, read_warc, write_warc

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>é</p>" * 300
    rows = [(i, f"http://x/{i}", f"<html>{i}</html>" * (i % 90)) for i in range(120)]
    rows += [(200 + i, f"http://copy/{i}", big) for i in range(50)] + [(300 + i, "u", "small") for i in range(5)]
    rows += [(400, None, None), (401, "http://a\r\nWARC-Type: evil", ""), (None, "n", big), (402, "l", "z" * 3_000_000), (403, "c", "\r\n\r\nWARC/1.1\r\n"),
             (120, "same", "y" * 1000), (120, "same", "y" * 1000)]
    return spark.createDataFrame(rows, PAGES).repartition(4)


def brute(rows):
    top = {}
    for r in rows:
        b = (r["html"] or "").encode()
        if len(b) >= 1000 and r["page_id"] is not None:
            top[b] = max(top.get(b, r["page_id"]), r["page_id"])
    out = []
    for r in rows:
        b = (r["html"] or "").encode()
        kept = top.get(b)
        again = kept is not None and kept != r["page_id"]
        out.append((r["page_id"], len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", kept if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [0, 1000])
def test_round_trip(spark, pages, few):
    extra = pages.withColumn("payload", F.lit(1)).withColumn("record_type", F.lit("x"))
    out = pages_round_trip(extra, broadcast_rows=few)
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(pages.collect())
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_empty(spark):
    assert pages_round_trip(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_texts_come_back_and_predicates_go_down(spark, pages, tmp_path, compression):
    path = str(tmp_path / "w")
    write_warc(page_records(pages), path, compression)
    back = read_warc(spark, path)
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    for r in back.where("record_type = 'response'").collect():
        i = r["record_id"][len("<urn:page:"):-1]
        assert bytes(r["payload"]).decode() == html[None if i == "null" else int(i)] and r["payload_length"] == len(r["payload"])
    some = back.where("record_type = 'revisit' AND target_uri LIKE 'http://copy/%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter is" not in plan  # all of it is done by the source
    assert some.count() == 49 and back.where(~F.col("record_type").isin("revisit") & (F.col("block_length") > 2_000_000)).count() == 1
    heads = read_warc(spark, path, payload=False)
    assert heads.count() == pages.count() and heads.where("payload IS NOT NULL").count() == 0


def test_uncommitted_files_are_not_read(spark, pages, tmp_path):
    path = tmp_path / "w"
    write_warc(page_records(pages), str(path))
    (path / "part-lost.warc.gz").write_bytes(gzip_member(warc.build_record({"record_type": "response", "record_id": "x"}), 1))
    assert read_warc(spark, str(path)).count() == pages.count()
    write_warc(page_records(pages.limit(3)), str(path))  # appended
    assert read_warc(spark, str(path)).count() == pages.count() + 3


def test_skipping_does_not_inflate(monkeypatch):
    """Members with a length are jumped over; those of plain gzip writers are inflated."""
    recs = [warc.build_record({"record_type": k, "record_id": f"<{i}>", "payload": bytes([i]) * 500_000}) for i, k in
            enumerate(["request", "response", "request", "warcinfo", "response"])]
    for data, jumps in ((b"".join(gzip_member(r, 1) for r in recs), True), (b"".join(gzip.compress(r) for r in recs), False)):
        for wanted in ("response", "request"):
            rows = list(read_records(io.BytesIO(data), True, lambda r: r["record_type"] == wanted, True))
            assert [r["payload"][:1] for r in rows] == [bytes([i]) for i in ((1, 4) if wanted == "response" else (0, 2))]
    assert gzip.decompress(gzip_member(b"abc" * 100, 6)) == b"abc" * 100
    plain = b"".join(recs)
    assert len(list(read_records(io.BytesIO(plain), False, lambda r: True, True))) == 5


def test_other_writers_records():
    text = (b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain;\r\n  charset=x\r\nContent-Length: 5\r\n"
            b"WARC-Payload-Digest: sha1:2jmj7l5rSw0yVb/vlWAYkK/YBwk\r\n\r\nhello\r\n\r\n").replace(b"sha1:2jmj7l5rSw0yVb/vlWAYkK/YBwk", b"md5:00")
    row = next(iter(read_records(io.BytesIO(text), False, lambda r: True, True)))
    assert row["payload"] == b"hello" and row["payload_digest"] == "md5:00" and row["content_type"] == "text/plain; charset=x"
    assert warc.digest_hex(warc.digest_header("ab" * 20)) == "ab" * 20
    with pytest.raises(ValueError):
        list(read_records(io.BytesIO(b"nonsense\r\n"), False, lambda r: True, True))
