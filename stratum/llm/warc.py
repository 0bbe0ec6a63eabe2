"""WARC archives as a Spark data source (``format("warc")``), written and read by tasks.

Reading plans one partition for each archive (small ones are put together),
pushes predicates on the record type and other WARC header fields down to the
tasks, and parses a record's headers first: a record that the predicates rule
out is skipped without its block being decoded.  In a plain archive that is a
seek; in a compressed one every record is a gzip member of its own, and the
members written here carry their length in the ``sl`` extra field of the gzip
header, so skipping is a seek there too (other writers' members are inflated
and thrown away).  With ``.option("payload", "false")`` no block is decoded.

Writing streams Arrow batches into archives of ``maxFileBytes`` at most.  A
task's files count only when the job commits: the commit writes a manifest, and
a reader that finds manifests reads what they list, so files of failed,
repeated or lost attempts are never seen.  Paths go through pyarrow's file
systems, so any shared store that it opens will do.

Null header fields are left out and read back as null; a null payload is empty.
"""

from __future__ import annotations

import base64
import io
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

from stratum.session import cut_lineage, scratch_path

SCHEMA = ("record_id string, record_type string, target_uri string, warc_date string, refers_to string, "
          "payload_digest string, content_type string, block_length long, payload_length long, payload binary")
#: header field of each column that the WARC header alone decides
FIELDS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date",
          "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type",
          "block_length": "content-length"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"
_READ = 1 << 16
_FLUSH = 4 << 20


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[len("file:"):])
    return fs.LocalFileSystem(), path


# ---------------------------------------------------------------- records

def _plain(x) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(x))


def digest_header(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def digest_hex(value: str | None) -> str | None:
    """``sha1:`` with base 32 or hex to lower-case hex; other values as they are."""
    if value is None or not value.lower().startswith("sha1:"):
        return value
    body = value[5:]
    return body.lower() if len(body) == 40 else base64.b32decode(body.upper()).hex()


def build_record(row: dict) -> bytes:
    """One record (head, block, closing lines).  HTTP records carry the payload behind a
    minimal HTTP head whose Content-Length is ``payload_length``; a revisit has that head only."""
    payload = row.get("payload") or b""
    kind, content_type = row.get("record_type") or "resource", row.get("content_type")
    block = payload
    if content_type == HTTP:
        size = row.get("payload_length")
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n"
        block = head.encode() + (b"" if kind == "revisit" else payload)
    digest = row.get("payload_digest")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", row.get("record_id")), ("WARC-Date", row.get("warc_date")),
              ("WARC-Target-URI", row.get("target_uri")), ("WARC-Refers-To", row.get("refers_to")),
              ("WARC-Profile", REVISIT_PROFILE if kind == "revisit" else None),
              ("WARC-Payload-Digest", digest_header(digest) if digest else None), ("Content-Type", content_type),
              ("Content-Length", len(block))]
    head = "".join(f"{k}: {_plain(v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field ``sl`` holds its own length and the data's."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class _Inflate(io.RawIOBase):
    """Bytes of the gzip member that begins where ``raw`` stands."""

    def __init__(self, raw):
        self.raw, self.z, self.start, self.ahead = raw, zlib.decompressobj(31), raw.tell(), b""
        first = raw.read(_READ)
        self.known = None  # where the next member begins, if this one says so
        if len(first) >= 24 and first[3] == 4 and first[12:14] == b"sl":
            self.known = self.start + struct.unpack("<I", first[16:20])[0]
        self.pending = first

    def readable(self):
        return True

    def readinto(self, into):
        while not self.z.eof:
            data = self.pending or self.raw.read(_READ)
            if not data:
                raise EOFError("a compressed record ends early")
            out = self.z.decompress(data, len(into))
            self.pending = self.z.unconsumed_tail
            if out:
                into[:len(out)] = out
                return len(out)
        return 0

    def end(self) -> int:
        """Where the next member begins."""
        if self.known is not None:
            return self.known
        while not self.z.eof:
            data = self.pending or self.raw.read(_READ)
            if not data:
                raise EOFError("a compressed record ends early")
            self.z.decompress(data, _READ)
            self.pending = self.z.unconsumed_tail
        return self.raw.tell() - len(self.z.unused_data)


def _head(stream) -> dict[str, str] | None:
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    out, last = {}, None
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:  # a folded line
            out[last] += " " + text.strip()
        else:
            name, _, value = text.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _columns(head: dict[str, str]) -> dict:
    row = {c: head.get(f) for c, f in FIELDS.items()}
    row["block_length"] = int(row["block_length"] or 0)
    row["payload_digest"] = digest_hex(row["payload_digest"])
    return row


def _split_block(row: dict, block: bytes) -> tuple[int, bytes | None]:
    """(payload length, payload); a revisit's payload is elsewhere: null."""
    if (row["content_type"] or "").replace(" ", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        if row["record_type"] == "revisit":
            sizes = [int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
            return (sizes[0] if sizes else 0), None
        return len(body), body
    return len(block), block


def read_records(raw, compressed: bool, wanted, payload: bool):
    """Rows of one archive; ``wanted`` sees the header columns only."""
    size = raw.seek(0, 2)
    at = 0
    while at < size:
        raw.seek(at)
        member = _Inflate(raw) if compressed else None
        stream = io.BufferedReader(member, 1 << 13) if compressed else raw
        head = _head(stream)
        if head is None:
            if compressed:  # a member of blank lines
                at = member.end()
                continue
            return
        row = _columns(head)
        begin = None if compressed else raw.tell()
        if wanted(row):
            if payload:
                block = stream.read(row["block_length"])
                if len(block) < row["block_length"]:
                    raise EOFError("a record ends early")
                row["payload_length"], row["payload"] = _split_block(row, block)
            else:
                row["payload_length"] = row["payload"] = None
            yield row
        at = member.end() if compressed else begin + row["block_length"] + 4


# ---------------------------------------------------------------- predicates

def _supported(f) -> bool:
    if isinstance(f, Not):
        return _supported(f.child)
    return (isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, In, IsNull, IsNotNull,
                           StringStartsWith, StringEndsWith, StringContains))
            and len(f.attribute) == 1 and f.attribute[0] in FIELDS)


def holds(f, row: dict) -> bool | None:
    """SQL truth of a predicate: None is unknown."""
    if isinstance(f, Not):
        x = holds(f.child, row)
        return None if x is None else not x
    x = row[f.attribute[0]]
    if isinstance(f, IsNull):
        return x is None
    if isinstance(f, IsNotNull):
        return x is not None
    if isinstance(f, EqualNullSafe):
        return x == f.value
    if x is None:
        return None
    if isinstance(f, In):
        return True if x in f.value else None if None in f.value else False
    if f.value is None:
        return None
    return {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b,
            LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, StringStartsWith: lambda a, b: a.startswith(b),
            StringEndsWith: lambda a, b: a.endswith(b), StringContains: lambda a, b: b in a}[type(f)](x, f.value)


# ---------------------------------------------------------------- the data source

@dataclass
class Archives(InputPartition):
    files: list

    def __init__(self, files: list):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], str(options.get("payload", "true")).lower() != "false"
        self.together = int(options.get("partitionBytes", 32 << 20))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _supported(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        store, root = _filesystem(self.path)
        infos = store.get_file_info(fs.FileSelector(root, recursive=True)) if store.get_file_info(root).type == fs.FileType.Directory \
            else [store.get_file_info(root)]
        manifests = [i.path for i in infos if i.base_name.startswith("_manifest-")]
        found = [i for i in infos if i.type == fs.FileType.File and i.base_name.endswith((".warc", ".warc.gz"))]
        if manifests:
            listed = {name for m in manifests for name in json.loads(store.open_input_stream(m).read())}
            found = [i for i in found if i.base_name in listed]
        out, size = [[]], 0
        for i in sorted(found, key=lambda i: i.path):
            if out[-1] and size + i.size > self.together:
                out.append([])
                size = 0
            out[-1].append(i.path)
            size += i.size
        return [Archives(x) for x in out if x] or [Archives([])]

    def read(self, partition):
        store, _ = _filesystem(self.path)
        wanted = lambda row: all(holds(f, row) for f in self.filters)
        schema = pa.schema([(c, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for c, t in
                            (x.split() for x in SCHEMA.split(", "))])
        rows, size = [], 0
        for path in partition.files:
            with store.open_input_file(path) as raw:
                for row in read_records(io.BufferedReader(raw, _READ) if not path.endswith(".gz") else raw, path.endswith(".gz"),
                                        wanted, self.payload):
                    rows.append(row)
                    size += 500 + len(row["payload"] or b"")
                    if size >= _FLUSH:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("level", 1)) if str(options.get("compression", "gzip")).lower() == "gzip" else None
        self.most = int(options.get("maxFileBytes", 256 << 20))

    def write(self, iterator):
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        try:
            for batch in iterator:
                for a in range(0, batch.num_rows, 64):
                    for row in batch.slice(a, 64).to_pylist():
                        if out is None or size >= self.most:
                            if out is not None:
                                out.close()
                            names.append(f"part-{uuid.uuid4().hex}.warc" + ".gz" * (self.level is not None))
                            out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                        data = build_record(row)
                        data = data if self.level is None else gzip_member(data, self.level)
                        out.write(data)
                        size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages):
        store, root = _filesystem(self.path)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for i in store.get_file_info(fs.FileSelector(root)):
                if i.base_name.startswith("_manifest-"):
                    store.delete_file(i.path)
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}") as f:
            f.write(json.dumps([n for m in messages if m is not None for n in m.files]).encode())

    def abort(self, messages):
        store, root = _filesystem(self.path)
        for n in (n for m in messages if m is not None for n in m.files):
            store.delete_file(f"{root}/{n}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# ---------------------------------------------------------------- pages

_URN = "<urn:page:"


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000,
                 date: str = "1970-01-01T00:00:00Z", broadcast_rows: int = 100_000) -> DataFrame:
    """A record for each page.  Of equal payloads (SHA-1 and length) of ``min_bytes`` or
    more, the page with the largest id is the response, the others revisit it; rows
    equal in id too are all responses, as are pages without an id if none has one.

    Only digests are grouped.  What is revisited comes back by a broadcast if it
    has at most ``broadcast_rows`` rows, else by a join."""
    t = pages.select(F.col(f"`{id_col}`").alias("_page"), F.col(f"`{url_col}`").cast("string").alias("target_uri"),
                     F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    t = t.withColumns({"payload_digest": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    repeated = cut_lineage(t.where(F.col("payload_length") >= min_bytes).groupBy("payload_digest", "payload_length")
                           .agg(F.max("_page").alias("_kept"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _kept IS NOT NULL")
                           .select(F.col("payload_digest").alias("_d"), F.col("payload_length").alias("_l"), "_kept"))
    small = repeated.limit(broadcast_rows + 1).count() <= broadcast_rows
    t = t.join(F.broadcast(repeated) if small else repeated,
               (F.col("payload_digest") == F.col("_d")) & (F.col("payload_length") == F.col("_l")), "left")
    revisit = F.col("_kept").isNotNull() & ~F.col("_kept").eqNullSafe(F.col("_page"))
    urn = lambda c: F.concat(F.lit(_URN), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    return t.select(urn(F.col("_page")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                    "target_uri", F.lit(date).alias("warc_date"), F.when(revisit, urn(F.col("_kept"))).alias("refers_to"), "payload_digest",
                    F.lit(HTTP).alias("content_type"), F.lit(None).cast("long").alias("block_length"), "payload_length",
                    F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    register(records.sparkSession)
    records.write.format("warc").option("compression", compression).mode("append").save(path)


def pages_round_trip(pages: DataFrame, path: str | None = None, id_col: str = "page_id", **more) -> DataFrame:
    """Write pages as archives and report, per page, what the archives say: length and
    digest of responses are taken from the payloads read back, those of revisits
    from their headers."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(page_records(pages, id_col, **more), path)
    kind = pages.schema[id_col].dataType
    number = lambda c: F.when(F.col(c) != F.lit(f"{_URN}null>"), F.col(c).substr(F.lit(len(_URN) + 1), F.length(c) - len(_URN) - 1)).cast(kind)
    back = read_warc(spark, path).where(F.col("record_type").isin("response", "revisit"))
    here = F.col("record_type") == "response"
    return back.select(number("record_id").alias(id_col), "payload_length", F.when(here, F.octet_length("payload").cast("long"))
                       .otherwise(F.col("payload_length")).alias("payload_bytes"),
                       F.when(here, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
                       "record_type", number("refers_to").alias("refers_to")).drop("payload_length")
