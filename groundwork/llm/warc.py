"""WARC archives: writing captures, and assembling transactions from records.

A capture is three records: a request, a response (or a revisit of an earlier
response with the same payload), and metadata. The request and metadata records
name the response in ``WARC-Concurrent-To``. Each record is a gzip member of its own,
and a file holds about ``file_bytes`` of them (one record at least), so a reader holds
one file and unpacks it member by member. Files are written by Spark's text writer,
which puts a separator after each row, here one row a file. A member's last byte is
the high byte of the length of what it holds and so zero below 16 MiB; it is left to
the separator, and longer records continue in further members.

Records are found by ``Content-Length``; nothing depends on what a payload contains.
Archives are parsed once, into a written table. Assembly joins its three kinds on
the identifier that they share and emits one nested row for each capture; a join
reads only the columns that it hands on.

Defined results: a null payload counts as empty, a null URL as empty target.
Payloads of at least ``least_bytes`` with equal SHA-1 and length are one group:
the record with the largest id is the response and the others revisit it. A row
without an id has an identifier made up from its place, and revisits if its group
has an id. Rows that repeat an id share identifiers, and each is a capture. A
response without request or metadata has nulls there. Other columns do not matter.
An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.llm.common import written

CRLF = "\r\n"
#: Two line ends close a record.
RECORD_END = CRLF + CRLF
#: A member holds less than this, so that its last byte is zero.
MEMBER_BYTES = 1 << 24
#: Compressed bytes are unpacked in steps of this size.
STEP = 1 << 16

RECORD_SCHEMA = "record_id string, record_type string, concurrent_to string, refers_to string, target string, date string, digest string, http string, body binary, body_bytes long, body_digest string"


def record_id(kind: str, id_col: Column) -> Column:
    return F.concat(F.lit(f"<urn:capture:{kind}:"), id_col.cast("string"), F.lit(">"))


def _record(kind: Column, name: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record as text; headers with a null value are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), name)]
    lines += [F.concat(F.lit(f"{h}: "), v) for h, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(RECORD_END), block)


#: Up to so many groups of equal payloads are sent to the pages; more of them are met by a join that Spark can split.
SENT_GROUPS = 500_000


def planned(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` (id, target, payload) with ``digest``, ``bytes`` and ``refers``, the id of the response that a row revisits.

    Groups of equal payloads are found from digests alone, by a pre-aggregated
    maximum. Pages move only when there are too many groups to send.
    """
    named = pages.select("*", F.sha1(F.col("payload").cast("binary")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    groups = named.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = written(groups, "warc-groups")
    few = groups.count() <= SENT_GROUPS
    found = named.join(F.broadcast(groups) if few else groups, ["digest", "bytes"], "left")
    return found.withColumn("refers", F.when(~F.col("last").eqNullSafe(F.col("id")), F.col("last"))).drop("last")


def members(record: bytes) -> bytes:
    """``record`` as gzip members, each of which ends in a zero byte."""
    parts = [record[i : i + MEMBER_BYTES - 1] for i in range(0, len(record), MEMBER_BYTES - 1)]
    return b"".join(gzip.compress(part, 6, mtime=0) for part in parts)


def _files(file_bytes: int):
    """Rows of records to rows of whole files, without their last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda parts: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-1]], pa.binary())], ["value"])
        parts, held = [], 0
        for batch in batches:
            for record in batch.column(0):
                part = members(record.as_py())
                if parts and held + len(part) > file_bytes:
                    yield out(parts)
                    parts, held = [], 0
                parts.append(part)
                held += len(part)
        if parts:
            yield out(parts)

    return run


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 1000, date: str = "2020-01-01T00:00:00Z", file_bytes: int = 32 << 20) -> None:
    """Write three records a row, in files of at most ``file_bytes`` or one record."""
    page = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "").alias("target"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    )
    page = page.withColumn("name", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("row-"), F.monotonically_increasing_id().cast("string"))))
    rows = planned(page, least_bytes)
    again = F.col("refers").isNotNull()
    main = record_id("response", F.col("name"))
    shared = [("WARC-Target-URI", F.when(F.col("target") != "", F.col("target"))), ("WARC-Date", F.lit(date))]
    # A revisit keeps the HTTP head, with the payload's length, and leaves the payload out.
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(RECORD_END))
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        main,
        [
            *shared,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(again, record_id("response", F.col("refers")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(head, F.when(again, "").otherwise(F.col("payload"))),
    )
    other = [*shared, ("WARC-Concurrent-To", main)]
    request = _record(F.lit("request"), record_id("request", F.col("name")), [*other, ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.col("target"), F.lit(" HTTP/1.1" + RECORD_END)))
    metadata = _record(F.lit("metadata"), record_id("metadata", F.col("name")), [*other, ("Content-Type", F.lit("application/warc-fields"))], F.concat(F.lit("capture-id: "), F.col("name"), F.lit(CRLF)))
    closed = F.explode(F.array(*(F.concat(r, F.lit(RECORD_END)).cast("binary") for r in (request, response, metadata)))).alias("value")
    files = rows.select(closed).mapInArrow(_files(file_bytes), "value binary")
    # A binary value keeps its bytes as a string; the separator is the last of them.
    files.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def hex_digest(value: str | None) -> str | None:
    """The lower-case hexadecimal SHA-1 of a digest header, which may also be in base 32."""
    if not value:
        return None
    bare = value.rpartition(":")[2]
    return base64.b32decode(bare.upper()).hex() if len(bare) == 32 else bare.lower()


def unpacked(data: bytes) -> Iterator[bytes]:
    """The contents of a file, compressed (in one or many members) or plain, step by step."""
    view = memoryview(data)
    if view[:2] != b"\x1f\x8b":
        yield from (bytes(view[i : i + STEP]) for i in range(0, len(view), STEP))
        return
    member = None
    for i in range(0, len(view), STEP):
        part = bytes(view[i : i + STEP])
        while part := part if member else part.lstrip(b"\0"):  # zeros between members are padding
            member = member or zlib.decompressobj(31)
            yield member.decompress(part)
            part = member.unused_data
            if member.eof:
                member = None


def records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of a file; never more than one record and a step is unpacked."""
    held = bytearray()
    pieces = unpacked(data)

    def more() -> bool:
        if (piece := next(pieces, None)) is None:
            return False
        held.extend(piece)
        return True

    while True:
        while (at := held.find(b"WARC/")) < 0 or (end := held.find(b"\r\n\r\n", at)) < 0:
            if not more():
                return
        lines = held[at:end].decode("utf-8", "replace").split(CRLF)[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        start = end + 4
        upto = start + int(headers["content-length"])
        while len(held) < upto and more():
            pass
        yield headers, bytes(held[start:upto])
        del held[:upto]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the archives in a folder, parsed once and written; ``body`` is what follows an HTTP head."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in RECORD_SCHEMA.split(", ")]
        kinds = pa.schema([(name, {"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[kind]) for name, kind in fields])

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

        for batch in batches:
            for data in batch.column(0):
                rows, held = [], 0
                for h, block in records(data.as_py()):
                    http, body = (block.split(b"\r\n\r\n", 1) + [b""])[:2] if "http" in h.get("content-type", "") else (b"", block)
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), hex_digest(h.get("warc-payload-digest")), http.decode("utf-8", "replace"), body, len(body), hashlib.sha1(body).hexdigest()))
                    held += len(block) + 300
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return written(files.mapInArrow(parse, RECORD_SCHEMA), "warc-records")


def assembled(found: DataFrame) -> DataFrame:
    """One row for each capture: its ``capture_id`` and the structs ``response``, ``request`` and ``metadata``.

    Several requests or metadata records that name one response: the one with the least identifier counts.
    """

    def side(kind: str) -> DataFrame:
        whole = F.struct("record_id", "target", "date", "http", "body")
        return found.where(F.col("record_type") == kind).groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min_by(whole, "record_id").alias(kind))

    main = found.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.struct("record_type", "refers_to", "target", "date", "digest", "http", "body", "body_bytes", "body_digest").alias("response")
    )
    return main.join(side("request"), "capture_id", "left").join(side("metadata"), "capture_id", "left")
