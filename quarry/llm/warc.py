"""WARC archives: written with revisit and continuation records, read back by reassembling segments.

A response longer than ``segment_bytes`` is cut: its record carries segment 1, continuation records name it as their origin
and count on, the last one states the total length. Payloads travel in HTTP chunked framing. The reader parses each archive
alone, groups the segments of a record by origin, orders them by number, verifies the total length, takes off the framing
and verifies the payload digest. Archives are written by Spark's own committer as gzip files of whole records, so a lost
task writes its archive again and a reader sees whole archives only.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_EMPTY = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunks of at most ``size`` bytes, ended by an empty chunk."""
    parts = [b"%x\r\n%s\r\n" % (len(part := payload[i:i + size]), part) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; extensions are skipped, trailers end it. Broken framing is an error."""
    out, at = [], 0
    while True:
        stop = body.index(b"\r\n", at)
        n = int(body[at:stop].split(b";")[0], 16)
        if n < 0 or stop + 2 + n > len(body):
            raise ValueError("a chunk is cut short")
        if not n:
            return b"".join(out)
        out.append(body[stop + 2:stop + 2 + n])
        at = stop + 2 + n
        if body[at:at + 2] != b"\r\n":
            raise ValueError("a chunk has no end")
        at += 2


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _record(headers: list[tuple[bytes, bytes]], block: bytes) -> bytes:
    lines = [b"WARC/1.1", *(k + b": " + v for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block


def parse(raw: bytes):
    """(headers in lower case, block) of each record of an archive."""
    at = 0
    while at < len(raw):
        stop = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:stop].split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in lines)}
        n = int(headers[b"content-length"])
        block = raw[stop + 4:stop + 4 + n]
        if len(block) < n:
            raise ValueError("a record is cut short")
        yield headers, block
        at = stop + 8 + n


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 100, segment_bytes: int = 1 << 13, chunk_bytes: int = 1 << 12,
                   records_per_archive: int = 20_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """One record per row of ``page_id``, ``url`` and ``html`` (UTF-8; null: empty); other columns are not written.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with the smallest page_id are responses, the others
    revisit it. Rows with a null page_id are responses. Rows may repeat: each gets a record id of its own.
    """
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    slim = rows.where(F.length("html") >= min_revisit_bytes).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = slim.join(first, "digest").where("page_id > first").groupBy("page_id").agg(F.collect_set(F.struct("digest", "first")).alias("same"))
    named = rows.join(revisits, "page_id", "left")
    named = named.withColumn("first", F.get(F.filter("same", lambda x: x["digest"] == F.col("digest")), F.lit(0))["first"]).drop("same")
    named = named.withColumn("copy", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("url")))

    def records(batches):
        for batch in batches:
            out, size = [], 0
            for page, url, html, digest, copy, first in zip(*[c.to_pylist() for c in batch.columns]):
                name = b"<urn:page:%s:%s:%d>" % (b"none" if page is None else b"%d" % page, digest[:16].encode(), copy)
                uri = b" ".join((url or "urn:none").encode().split())
                shared = [(b"WARC-Record-ID", name), (b"WARC-Date", date.encode()), (b"WARC-Target-URI", uri),
                          (b"WARC-Payload-Digest", b"sha256:" + digest.encode()), (b"Content-Type", b"application/http;msgtype=response")]
                if page is not None:
                    shared.append((b"WARC-Page-Number", b"%d" % page))
                if first is not None:
                    out.append(_record([(b"WARC-Type", b"revisit"), *shared, (b"WARC-Profile", _PROFILE), (b"WARC-Refers-To", b"<urn:page:%d:%s:1>" % (first, digest[:16].encode()))], _EMPTY))
                else:
                    block = _HTTP + chunked(html, chunk_bytes)
                    if len(block) <= segment_bytes:
                        out.append(_record([(b"WARC-Type", b"response"), *shared], block))
                    else:
                        out.append(_record([(b"WARC-Type", b"response"), *shared, (b"WARC-Segment-Number", b"1")], block[:segment_bytes]))
                        for k, a in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
                            own = [(b"WARC-Type", b"continuation"), (b"WARC-Record-ID", name[:-1] + b":%d>" % k), (b"WARC-Date", date.encode()),
                                   (b"WARC-Segment-Origin-ID", name), (b"WARC-Segment-Number", b"%d" % k)]
                            if a + segment_bytes >= len(block):
                                own.append((b"WARC-Segment-Total-Length", b"%d" % len(block)))
                            out.append(_record(own, block[a:a + segment_bytes]))
                size += len(html)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    made = named.select("page_id", "url", "html", "digest", "copy", "first").mapInArrow(records, "record binary")
    made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option(
        "maxRecordsPerFile", records_per_archive).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all archives: page_id, record_id, record_type, url, payload, payload_digest (as stated), refers_to_id,
    status ('ok', or what was found wrong; the payload is then null). Revisits have no payload of their own."""

    def read(segmented):
        def run(batches):
            for batch in batches:
                for content in batch.column(0):
                    rows, size = [], 0
                    for head, block in parse(zlib.decompress(content.as_buffer(), 47)):
                        number, origin = head.get(b"warc-segment-number"), head.get(b"warc-segment-origin-id")
                        if (number is not None) != segmented:
                            continue
                        kind = head[b"warc-type"].decode()
                        page = head.get(b"warc-page-number")
                        total = head.get(b"warc-segment-total-length")
                        rows.append((head[b"warc-record-id"].decode(), (origin or head[b"warc-record-id"]).decode(), kind, None if page is None else int(page),
                                     head.get(b"warc-target-uri", b"").decode(), head.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:"),
                                     head[b"warc-refers-to"].decode() if b"warc-refers-to" in head else None, int(number or 1), int(total) if total else None, block))
                        size += len(block)
                        if size > 1 << 22:
                            yield made(rows)
                            rows, size = [], 0
                    yield made(rows)
        return run

    names = ["record_id", "origin", "record_type", "page_id", "url", "payload_digest", "refers_to_id", "number", "total", "block"]
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    schema = ("record_id string, origin string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, "
              "number int, total long, block binary")

    def made(rows):
        columns = list(zip(*rows)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    def decoded(batches):
        for batch in batches:
            index = batch.schema.get_field_index
            kinds, stated, parts, problems = (batch.column(index(c)).to_pylist() for c in ("record_type", "payload_digest", "blocks", "problem"))
            payloads, states = [], []
            for kind, digest, blocks, problem in zip(kinds, stated, parts, problems):
                payload = None
                if problem is None and kind == "response":
                    try:
                        payload = payload_of(b"".join(blocks))
                        if digest and hashlib.sha256(payload).hexdigest() != digest:
                            payload, problem = None, "digest differs"
                    except ValueError as error:
                        problem = f"framing: {error}"
                payloads.append(payload)
                states.append(problem or "ok")
            kept = ["record_id", "record_type", "page_id", "url", "payload_digest", "refers_to_id"]
            yield pa.RecordBatch.from_arrays([batch.column(index(c)) for c in kept] + [pa.array(payloads, pa.binary()), pa.array(states)], [*kept, "payload", "status"])

    files = spark.read.format("binaryFile").load(folder).select("content")
    whole = files.mapInArrow(read(False), schema)
    columns = ["record_id", "record_type", "page_id", "url", "payload_digest", "refers_to_id"]
    whole = whole.select(*columns, F.array("block").alias("blocks"), F.lit(None).cast("string").alias("problem"))
    # a record has a bounded number of segments; records are spread by origin
    segments = files.mapInArrow(read(True), schema).groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("s"), F.max("total").alias("total"), F.sum(F.length("block")).alias("length"),
        *[F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in columns])
    in_order = F.col("s.number") == F.sequence(F.lit(1), F.size("s"))
    problem = (F.when(F.col("record_id").isNull(), "origin missing").when(~in_order, "segments missing or repeated")
               .when(F.col("total").isNull(), "last segment missing").when(F.col("total") != F.col("length"), "total length differs"))
    segments = segments.select(F.coalesce("record_id", "origin").alias("record_id"), F.coalesce("record_type", F.lit("response")).alias("record_type"), "page_id", "url",
                               "payload_digest", "refers_to_id", F.col("s.block").alias("blocks"), problem.alias("problem"))
    return whole.unionByName(segments).mapInArrow(
        decoded, "record_id string, record_type string, page_id long, url string, payload_digest string, refers_to_id string, payload binary, status string")


def resolve(records: DataFrame) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to. Revisits take size and digest from
    the response that they name; a response with very many revisits is split by the adaptive skew join."""
    responses = records.where("record_type = 'response'").select(
        "page_id", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    named = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("found"), F.col("page_id").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "refers_to_id", "payload_digest", "record_type").join(named, "refers_to_id", "left")
    return responses.unionByName(revisits.select("page_id", "payload_bytes", F.col("found").alias("payload_digest"), "record_type", "refers_to"))
