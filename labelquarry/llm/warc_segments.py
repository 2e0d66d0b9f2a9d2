"""WARC archives with segmented records: writing, reading, reassembly.

Pages become HTTP responses with chunked bodies. Payloads met before become revisit records. A block longer than
``SEGMENT`` bytes is cut: the first piece is the response record with segment number 1, the others are
continuation records that name it as their origin, and the last one tells the total length. Archives are
written and read by Spark's own sources (any store it reaches), gzipped, with a bounded number of
bounded records in each, so that a file always fits in a task.

Reading parses records by their content length, groups the pieces of segmented records by origin, orders them by number,
checks the total length, takes the chunked framing away and checks the payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelquarry.llm.common import store

SEGMENT = 32 << 10  # bytes of a block in one record
CHUNK = 8 << 10  # bytes of a chunk of a body
RECORDS = 1000  # in one file
DEDUP_FROM = 1000  # payload bytes from which equal payloads are revisits

CRLF = b"\r\n"


def _cut(data: bytes, size: int) -> list[bytes]:
    """Pieces of at most ``size`` bytes that don't cut a UTF-8 character (if there is one that long)."""
    out, at = [], 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and end > at + size - 4 and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(data[at:end])
        at = end
    return out


def _record(kind: bytes, fields: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = [b"WARC/1.1", b"WARC-Type: " + kind] + [n + b": " + v.replace(b"\r", b"%0D").replace(b"\n", b"%0A") for n, v in fields]
    return CRLF.join([*head, b"Content-Length: %d" % len(block), b"", block])


def _identifier(page: object, uid: int, part: int = 0) -> bytes:
    h = hashlib.md5(f"{page}/{uid}/{part}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>".encode()


def _digest(payload: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(payload).digest())


def page_records(page: int | None, uid: int, url: str | None, payload: bytes, lead: tuple | None, segment: int, chunk: int) -> list[bytes]:
    """The records of one page; ``lead``: (page, uid) of the response that a revisit refers to."""
    fields = [(b"WARC-Record-ID", _identifier(page, uid)), (b"WARC-Date", b"2000-01-01T00:00:00Z"), (b"WARC-Payload-Digest", _digest(payload))]
    if page is not None:
        fields.append((b"X-Page-ID", b"%d" % page))
    if url is not None:
        fields.append((b"WARC-Target-URI", url.encode()))
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
    if lead is not None:
        profile = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        fields += [(b"WARC-Refers-To", _identifier(*lead)), (b"WARC-Profile", profile), (b"Content-Type", b"application/http; msgtype=response")]
        return [_record(b"revisit", fields, status + CRLF)]
    body = b"".join(b"%x\r\n%b\r\n" % (len(c), c) for c in _cut(payload, chunk)) + b"0\r\n\r\n"
    block = status + b"Transfer-Encoding: chunked\r\n\r\n" + body
    fields.append((b"Content-Type", b"application/http; msgtype=response"))
    pieces = _cut(block, segment)
    if len(pieces) == 1:
        return [_record(b"response", fields, block)]
    out = [_record(b"response", [*fields, (b"WARC-Segment-Number", b"1")], pieces[0])]
    for number, piece in enumerate(pieces[1:], 2):
        more = [(b"WARC-Record-ID", _identifier(page, uid, number)), fields[1], (b"WARC-Segment-Origin-ID", fields[0][1]), (b"WARC-Segment-Number", b"%d" % number)]
        if number == len(pieces):
            more.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
        out.append(_record(b"continuation", more, piece))
    return out


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, chunk: int = CHUNK, records: int = RECORDS, dedup_from: int = DEDUP_FROM) -> None:
    """One response or revisit per row of ``pages`` (and continuations) as gzipped archives in folder ``path``.

    Of equal payloads of at least ``dedup_from`` bytes, the row with the largest id is the response; of
    repeated rows one. Null html is an empty payload; null ids and addresses leave their field out.
    """
    base = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page"), F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"), F.monotonically_increasing_id().alias("uid"),
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    base = store(base, "numbered-pages")  # numbers would not be the same in another scan
    slim = base.filter(F.col("size") >= dedup_from).groupBy("digest", "size").agg(F.max(F.struct("page", "uid")).alias("lead"), F.count("*").alias("n"))
    leads = store(slim.filter("n > 1").select("digest", "size", F.col("lead.page").alias("lead_page"), F.col("lead.uid").alias("lead_uid")), "leads")
    planned = base.join(leads, ["digest", "size"], "left").select("page", "uid", "url", "payload", "lead_page", "lead_uid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = _record(b"warcinfo", [(b"WARC-Record-ID", _identifier("info", 0)), (b"WARC-Date", b"2000-01-01T00:00:00Z"), (b"Content-Type", b"application/warc-fields")], b"format: WARC File Format 1.1\r\n")
        out, size = [info], 0
        for batch in batches:
            for i in range(batch.num_rows):
                page, uid, address, payload, lead_page, lead_uid = (c[i].as_py() for c in batch.columns)
                lead = None if lead_uid is None or lead_uid == uid else (lead_page, lead_uid)
                made = page_records(page, uid, address, payload, lead, segment, chunk)
                out += made
                size += sum(map(len, made))
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = planned.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def parse_records(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Fields (names in lower case) and block of each record of an archive; stops with an error where there is no record."""
    at = 0
    while at < len(data):
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        end = data.index(CRLF + CRLF, at)
        lines = data[at:end].split(CRLF)[1:]
        fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(b":") for x in lines)}
        begin, size = end + 4, int(fields[b"content-length"])
        if begin + size > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, data[begin : begin + size]
        at = begin + size
        while data[at : at + 2] == CRLF:
            at += 2


def decode_block(block: bytes) -> bytes | None:
    """Payload of an HTTP response block; null if its chunked framing is broken."""
    head, found, body = block.partition(CRLF + CRLF)
    if not found:
        return None
    if b"transfer-encoding: chunked" not in head.lower():
        return body
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or end + 2 + size > len(body):
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size
        if body[at : at + 2] != CRLF:
            return None
        at += 2


_FIELDS = "record_id string, kind string, page_id long, url string, refers_id string, digest string, number int, origin string, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in folder ``path``, one row each; gzipped or not. Records without a block of pages are left out."""
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [x.split()[0] for x in _FIELDS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in _FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                rows, size = [], 0
                for f, block in parse_records(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = f.get(b"warc-type", b"").decode()
                    if kind not in ("response", "revisit", "continuation"):
                        continue
                    text = {k: v.decode("utf-8", "replace") for k, v in f.items()}
                    number = {k: int(text[k]) if k in text else None for k in (b"x-page-id", b"warc-segment-number", b"warc-segment-total-length")}
                    rows.append((
                        text.get(b"warc-record-id"), kind, number[b"x-page-id"], text.get(b"warc-target-uri"), text.get(b"warc-refers-to"), text.get(b"warc-payload-digest"),
                        number[b"warc-segment-number"], text.get(b"warc-segment-origin-id") or text.get(b"warc-record-id"), number[b"warc-segment-total-length"], block))
                    size += len(block)
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.mapInArrow(run, _FIELDS)


def read_pages(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per response or revisit: ``page_id``, ``url``, ``record_type``, ``payload_bytes``, ``payload_digest`` (bare lower-case
    hex SHA-1), ``refers_to`` (page of the response of a revisit), ``status`` and, if asked for, ``payload``.

    ``status`` is ``ok``; ``incomplete`` if segments are missing, doubled with other content or of another total
    length; ``framing`` if chunks are broken; ``digest`` if the payload is not the one that the record
    names; ``orphan`` for a revisit without its response. Such rows are returned, with null size and digest unless
    known. Bytes of a revisit's payload come from its response.
    """
    records = read_records(spark, path)
    columns = ["record_id", "page_id", "url", "digest", "block", "whole"]
    single = records.filter("kind = 'response' and number is null").withColumn("whole", F.lit(True)).withColumn("block", F.array("block")).select(columns)
    pieces = records.filter("number is not null").groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("number", "block"))).alias("p"), F.max("total").alias("total"),
        *[F.max(F.when(F.col("kind") == "response", F.col(c))).alias(c) for c in ("page_id", "url", "digest")],
    )
    length = F.expr("aggregate(p, 0L, (n, x) -> n + octet_length(x.block))")
    complete = F.expr("transform(p, x -> x.number) = sequence(1, size(p))")
    joined = pieces.withColumn("block", F.col("p.block")).withColumn("whole", complete & (length == F.col("total")))
    joined = joined.withColumn("whole", F.coalesce("whole", F.lit(False))).withColumnRenamed("origin", "record_id").select(columns)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for named, data, whole in zip(*[batch.column(i) for i in (3, 4, 5)], strict=True):
                payload = decode_block(b"".join(data.as_py())) if whole.as_py() else None
                wrong = payload is not None and named.as_py() is not None and _digest(payload).decode() != named.as_py()
                out[0].append(None if payload is None else len(payload))
                out[1].append(None if payload is None else hashlib.sha1(payload).hexdigest())
                out[2].append("incomplete" if not whole.as_py() else "framing" if payload is None else "digest" if wrong else "ok")
                out[3].append(payload if payloads else None)
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["record_id", "page_id", "url", "payload_bytes", "payload_digest", "status", "payload"])

    shape = "record_id string, page_id long, url string, payload_bytes long, payload_digest string, status string, payload binary"
    responses = store(single.unionByName(joined).mapInArrow(decode, shape), "responses")
    leads = responses.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest", F.col("status").alias("lead_status"), "payload")
    revisits = records.filter("kind = 'revisit'").select("refers_id", "page_id", "url").join(leads, "refers_id", "left")
    first = responses.select("page_id", "url", F.lit("response").alias("record_type"), "payload_bytes", "payload_digest", F.lit(None).cast("long").alias("refers_to"), "status", "payload")
    again = revisits.select("page_id", "url", F.lit("revisit").alias("record_type"), "payload_bytes", "payload_digest", "refers_to", F.coalesce("lead_status", F.lit("orphan")).alias("status"), "payload")
    out = first.unionByName(again)
    return out if payloads else out.drop("payload")
