"""WARC archives: writing records with continuation segments and chunked
bodies, and reading them back.

Writing: one record per page. Of pages with equal payloads the one with the
largest id becomes a ``response``, the others ``revisit`` it. A response block
is an HTTP message with a chunked body; a block above SEGMENT bytes is cut into
``continuation`` records that name the first one's id, their segment number
and, in the last, the total length. Archives are gzip files that Spark's own
text writer commits, so lost tasks are simply written again; a file holds at
most FILE_RECORDS records of bounded size.

Reading: Spark streams the lines of an archive, a parser restores the records
by their Content-Length, blocks of continuation records are grouped by origin
id, ordered by segment number, checked for gaps and total length, and the
chunked framing is decoded. A group is one page's payload; its size is that of
one row of the input.

Defined results: a null html is an empty payload; a page without an id is a
response unless a page with an id has its payload; repeated rows of the largest
id are all responses; damaged segment groups yield a null payload and an error
text; an empty table writes an archive without records and reads no rows; extra
columns are ignored."""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEGMENT = 16 * 1024
CHUNK = 4 * 1024
FILE_RECORDS = 4096
DATE = "2000-01-01T00:00:00Z"

_RECORD = ("record_id string, record_type string, page_id long, url string, payload_digest string, refers_to long, "
           "segment int, origin string, total long, block binary")
_PAGE = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, "
         "payload binary, error string")


def _cut(data: bytes, size: int):
    """Pieces of at most ``size`` bytes that end between UTF-8 characters."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def _frame(fields, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_records(page_id, url, payload: bytes, digest: str, owner, owner_url, key: str, segment: int = SEGMENT):
    """The records of one page, as bytes."""
    url = "".join(f"%{ord(c):02X}" if ord(c) < 33 else c for c in url or "")
    rid = "<urn:uuid:" + hashlib.md5(key.encode()).hexdigest() + ">"
    fields = [("WARC-Record-ID", rid), ("WARC-Date", DATE), ("WARC-Target-URI", url or None),
              ("WARC-Payload-Digest", "sha1:" + digest), ("WARC-Page-ID", page_id)]
    if owner is not None and page_id != owner:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield _frame([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To-Page-ID", owner),
                      ("WARC-Refers-To-Target-URI", owner_url),
                      ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], block)
        return
    body = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, CHUNK))
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
             + body + b"0\r\n\r\n")
    if len(block) <= segment:
        yield _frame([("WARC-Type", "response"), *fields], block)
        return
    pieces = list(_cut(block, segment))
    yield _frame([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], pieces[0])
    for n, piece in enumerate(pieces[1:], 2):
        own = "<urn:uuid:" + hashlib.md5(f"{key}/{n}".encode()).hexdigest() + ">"
        yield _frame([("WARC-Type", "continuation"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
                      ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n),
                      ("WARC-Segment-Total-Length", len(block) if n == len(pieces) else None)], piece)


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Archives of all pages (page_id, url, html) under ``path``; responses cut
    into segments lie under segmented=1."""
    p = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"),
                     F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("sha", F.sha1("payload"))
    owners = (p.groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("o"), F.count("*").alias("n"))
              .where(F.col("n") > 1).select(F.col("sha").alias("sha2"), F.col("o.page_id").alias("owner"),
                                            F.col("o.url").alias("owner_url")))
    p = p.join(owners, F.col("sha") == F.col("sha2"), "left").drop("sha2")

    def run(batches):
        from pyspark import TaskContext
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            flags, rows = [], []
            for r in batch.to_pylist():
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                recs = list(page_records(r["page_id"], r["url"], r["payload"], digest, r["owner"], r["owner_url"],
                                         f"{r['page_id']}/{digest}/{task}/{n}", segment))
                n += 1
                rows += [x[:-1] for x in recs]  # the writer ends each row with a line feed
                flags += [int(len(recs) > 1)] * len(recs)
            yield pa.RecordBatch.from_arrays([pa.array(flags, pa.int32()), pa.array(rows, pa.binary())],
                                             names=["segmented", "value"])

    recs = p.mapInArrow(run, "segmented int, value binary").withColumn("value", F.col("value").cast("string"))
    (recs.write.mode("overwrite").partitionBy("segmented").option("compression", "gzip").option("lineSep", "\n")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def _parse(buf: bytes):
    """Complete records at the start of ``buf`` and the number of bytes they
    take."""
    at, out = 0, []
    while True:
        end = buf.find(b"\r\n\r\n", at)
        if end < 0:
            return out, at
        lines = buf[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(head["content-length"])
        stop = end + 4 + size
        if len(buf) < stop + 4:
            return out, at
        out.append((head, buf[end + 4:stop]))
        at = stop + 4


def _record_row(head, block):
    number = lambda k: int(head[k]) if k in head else None
    digest = head.get("warc-payload-digest")
    return (head.get("warc-record-id"), head.get("warc-type"), number("warc-page-id"), head.get("warc-target-uri"),
            digest.split(":")[-1] if digest else None, number("warc-refers-to-page-id"),
            number("warc-segment-number"), head.get("warc-segment-origin-id"), number("warc-segment-total-length"), block)


_RECORD_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()),
                           ("url", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
                           ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()),
                           ("block", pa.binary())])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives under ``path``, one row each. A gzip file is
    read by one task from its first line to its last, so the stream of lines
    is the stream of its bytes."""
    lines = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
             .select(F.col("value").cast("binary").alias("value")))

    def run(batches):
        rest = b""
        for batch in batches:
            rest = b"\n".join([rest + batch.column(0)[0].as_py(), *batch.column(0)[1:].to_pylist(), b""]) \
                if batch.num_rows else rest
            got, used = _parse(rest)
            rest = rest[used:]
            if got:
                cols = zip(*[_record_row(*g) for g in got])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RECORD_ARROW)],
                                                 schema=_RECORD_ARROW)
        if rest:
            raise ValueError(f"{len(rest)} bytes behind the last whole record")

    return lines.mapInArrow(run, _RECORD)


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def http_payload(block: bytes):
    """(payload, announced length) of an HTTP message block."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked":
        body = dechunk(body)
        return body, len(body)
    return body, int(fields.get(b"content-length", len(body)))


def _page_row(r, segments):
    """One page from its record and its segments (segment, total, block)."""
    kind, digest, error, payload, size = r["record_type"], r["payload_digest"], None, None, None
    try:
        segments = sorted(segments, key=lambda s: s["segment"] or 1)
        block = b"".join(s["block"] for s in segments)
        if [s["segment"] or 1 for s in segments] != list(range(1, len(segments) + 1)):
            raise ValueError("segments are missing or repeated")
        total = segments[-1]["total"]
        if (len(segments) > 1 or segments[0]["segment"]) and total != len(block):
            raise ValueError(f"{len(block)} bytes where the last segment says {total}")
        payload, size = http_payload(block)
        if kind == "revisit":
            payload = None
        else:
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest is not None and own != digest:
                raise ValueError("the payload does not have its digest")
            digest = own
    except (ValueError, TypeError) as e:
        error, payload, size = str(e), None, None
    return r["page_id"], r["url"], kind, r["refers_to"], size, digest, payload, error


def _decode(batches):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("payload", pa.binary()), ("error", pa.string())])
    for batch in batches:
        rows = [_page_row(r, r["segments"]) for r in batch.to_pylist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def reassemble(records: DataFrame, segmented: DataFrame | None = None) -> DataFrame:
    """Pages from records. ``segmented`` may name the records that hold the
    segments, where the archives keep them apart; whole records are decoded
    where they are read, only segments are grouped."""
    piece = F.struct("segment", "total", "block").alias("p")
    first = ("record_type", "page_id", "url", "payload_digest", "refers_to")
    whole = (records.where("segment IS NULL AND origin IS NULL AND record_type IN ('response', 'revisit')")
             .select(*first, F.array(piece).alias("segments")))
    parts = (records if segmented is None else segmented).where("segment IS NOT NULL")
    key = F.coalesce("origin", "record_id").alias("k")
    parts = (parts.select(key, piece, F.when(F.col("origin").isNull(), F.struct(*first)).alias("f"))
             .groupBy("k").agg(F.max("f").alias("f"), F.collect_list("p").alias("segments"))
             .select(*[F.col("f")[c].alias(c) for c in first], "segments"))
    return whole.unionByName(parts).mapInArrow(_decode, _PAGE)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Pages of archives that ``write_archives`` has written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())

    def part(flag):
        p = f"{path}/segmented={flag}"
        if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p)):
            return read_records(spark, p)
        return spark.createDataFrame([], _RECORD)

    return reassemble(part(0), part(1))


def warc_report(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages to archives under ``path`` (a folder every executor
    sees), read them back and return the contract's columns."""
    write_archives(pages, path)
    got = read_archives(pages.sparkSession, path)
    bad = F.raise_error(F.concat(F.lit("damaged record: "), F.col("error")))
    return got.select("page_id", F.when(F.col("error").isNotNull(), bad.cast("long"))
                      .otherwise(F.col("payload_bytes")).alias("payload_bytes"),
                      "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, upper(sha1(b)) AS sha, max(page_id) OVER (PARTITION BY b) AS owner FROM p),
x AS (SELECT *, list_transform(range(8), lambda g: CAST(('0x' || substr(sha, CAST(5 * g + 1 AS INTEGER), 5)) AS BIGINT)) AS v FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(v, lambda q: concat(
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q // 32768) % 32 + 1 AS INTEGER), 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q // 1024) % 32 + 1 AS INTEGER), 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q // 32) % 32 + 1 AS INTEGER), 1),
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(q % 32 + 1 AS INTEGER), 1))), 'string_agg', '') AS payload_digest,
       CASE WHEN owner IS NULL OR page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM x
"""
