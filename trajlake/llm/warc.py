"""Operator 8: WARC archives written and read back, transactions assembled to captures."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, delete, read, release, scratch, scratch_path

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
#: (payload bytes up to, captures whose three records share one archive file at most): a file holds 128 MB or one capture.
BANDS = ((1 << 16, 2000), (1 << 22, 32), (None, 1))
#: Fixed value: the revisit profile of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 given in hexadecimal: each 20 bits, five digits, are four of base 32."""

    def letters(h: Column) -> Column:
        groups = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
        return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", _ALPHABET)

    return F.transform(F.array(digest), letters)[0]


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), block)


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    min_bytes: int = 0,
) -> None:
    """Writes request, response or revisit, and metadata records of each row to gzipped WARC files under ``path``.

    Among payloads that are equal and of at least ``min_bytes``, that of the
    smallest id is the response; the others are revisits without payload that
    refer to it. A null payload or URL is empty. Line ends in a URL are
    percent-coded. Rows that repeat an id with an equal payload are of one kind.
    """
    spark = pages.sparkSession
    plain = pages.select(
        column(id_col).cast("long").alias("id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(column(url_col), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(column(payload_col), F.lit("")).alias("payload"),
    ).withColumn("hex", F.sha1("payload"))
    seen = plain.groupBy("hex").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.octet_length("payload")).alias("bytes"))
    seen = scratch(seen, "payloads")
    first = seen.where((F.col("bytes") >= min_bytes) & (F.col("first") < F.col("last"))).select("hex", "first")
    known = plain.join(first, "hex", "left").withColumn("digest", base32(F.col("hex")))
    ident = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    again = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    own = _urn("response", ident, F.col("digest"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.octet_length("payload").cast("string"),
        F.lit(_END),
    )
    common = [("WARC-Target-URI", F.col("url")), ("WARC-Date", F.lit("2024-01-01T00:00:00Z"))]
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    http_type = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _record(F.lit("response"), [("WARC-Record-ID", own), *common, digest, http_type], F.concat(http, "payload"))
    target = _urn("response", F.col("first").cast("string"), F.col("digest"))
    revisit = _record(
        F.lit("revisit"),
        [("WARC-Record-ID", own), *common, digest, ("WARC-Refers-To", target), ("WARC-Profile", F.lit(PROFILE)), http_type],
        http,
    )
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    local = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    local = F.when(local.startswith("/"), local).otherwise(F.concat(F.lit("/"), local))
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _urn("request", ident, F.col("digest"))), *common, ("WARC-Concurrent-To", own),
         ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), local, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(_END)),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _urn("metadata", ident, F.col("digest"))), *common, ("WARC-Concurrent-To", own),
         ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("capture-id: "), ident, F.lit("\r\n")),
    )

    def records(rows: DataFrame) -> DataFrame:
        return rows.select(F.explode(F.array(request, F.when(again, revisit).otherwise(response), metadata)).alias("value"))

    largest = seen.agg(F.max("bytes")).first()[0] or 0
    low = -1
    for high, captures in BANDS:
        if low < largest:
            band = F.octet_length("payload") > low
            band = band if high is None else band & (F.octet_length("payload") <= high)
            # The text writer puts the line separator after each value: a WARC record ends in two line ends.
            writer = records(known.where(band)).write.mode("append").option("lineSep", _END).option("compression", "gzip")
            writer.option("maxRecordsPerFile", 3 * captures).text(path)
        low = high
    release(seen)


def _text(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return line.decode("latin-1")


def _records(stream: io.BufferedReader) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, problem) of each record; a block is as long as its Content-Length says.

    Where a record can't be read whole, its problem is told and reading goes on
    at the next line that starts a record.
    """
    line = b""
    while True:
        if not line.startswith(b"WARC/"):
            line = stream.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                if line.strip():
                    block = [line]
                    while (line := stream.readline()) and not line.startswith(b"WARC/"):
                        block.append(line)
                    yield {}, b"".join(block), "not_a_record"
                continue
        headers = {"version": _text(line).strip()}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = _text(line).partition(":")
            headers[name.strip(" \t").lower()] = value.removeprefix(" ")
        size = headers.get("content-length", "").strip(" \t")
        if not (size.isascii() and size.isdigit()):
            yield headers, b"", "no_length"
            while (line := stream.readline()) and not line.startswith(b"WARC/"):
                pass
            if not line:
                return
            continue
        block = stream.read(int(size))
        problem = "truncated" if len(block) < int(size) else None
        yield headers, block, problem or next((f"no_{h[5:]}" for h in ("warc-type", "warc-record-id") if not headers.get(h)), None)
        line = b""


_SCHEMA = (
    "type string, record_id string, concurrent_to string, refers_to string, target_uri string, "
    "digest string, payload_bytes long, actual_digest string, payload string, problem string"
)


def _parse(payloads: bool):
    kinds = [pa.string()] * 6 + [pa.int64()] + [pa.string()] * 3
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def row_of(h: dict[str, str], block: bytes, problem: str | None) -> tuple:
        ident = lambda name: h.get(name, "").strip(" \t") or None
        body = block.partition(_END.encode())[2] if "msgtype" in h.get("content-type", "") else block
        full = ident("warc-type") == "response"
        actual = base64.b32encode(hashlib.sha1(body).digest()).decode() if full else None
        text = body.decode("utf-8", "replace") if payloads or not full else None
        digest = (ident("warc-payload-digest") or "").removeprefix("sha1:") or None
        return (
            ident("warc-type"), ident("warc-record-id"), ident("warc-concurrent-to"), ident("warc-refers-to"),
            h.get("warc-target-uri"), digest, len(body), actual, text, problem,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as f:
                    try:
                        for found in _records(io.BufferedReader(f, 1 << 16)):
                            rows.append(row_of(*found))
                            held += len(found[1])
                            if held > 1 << 22:
                                yield batch_of(rows)
                                rows, held = [], 0
                    except (EOFError, OSError, zlib.error):
                        rows.append(row_of({}, b"", "broken_gzip"))
                if rows:
                    yield batch_of(rows)

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row a record of the gzipped WARC files under ``path``, parsed in parallel by file.

    With ``payloads`` false, a response has its length and digest only.
    ``problem`` is null for whole records, else not_a_record, no_length,
    truncated, no_type, no_record-id or broken_gzip (the rest of that file is
    lost). Header bytes that aren't UTF-8 are read as Latin-1. A worker holds
    a file of some ten MB, compressed, and the record at hand.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_parse(payloads), _SCHEMA)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row a capture: (capture_id, target_uri, record_type, request, response, metadata, refers_to).

    Request and metadata records join the response or revisit that they are
    concurrent to; a revisit takes payload, length and digest from the response
    that it refers to, and ``refers_to`` is that one's capture id. Responses
    without request or metadata keep nulls there, and so do revisits of a
    missing response. A request or metadata record without its response is
    not a capture, nor is a record with a problem.
    """
    told = records.where("problem is null")
    side = told.where(F.col("type").isin("request", "metadata")).groupBy(F.col("concurrent_to").alias("record_id"))
    pick = lambda kind: F.max(F.when(F.col("type") == kind, F.struct("record_id", "payload")))
    side = side.agg(pick("request").alias("request"), pick("metadata").alias("metadata"))
    found = told.where(F.col("type").isin("response", "revisit")).join(side, "record_id", "left")
    ident = F.regexp_extract("metadata.payload", r"capture-id: (-?\d+)", 1)
    found = found.withColumn("capture_id", F.when(ident != "", ident.cast("long")))
    body = F.struct("payload_bytes", "actual_digest", "payload")
    hit = F.when((F.col("type") == "response") & (F.col("digest") == F.col("actual_digest")), F.struct("capture_id", body.alias("body")))
    whole = found.select("record_id", hit.alias("hit")).where("hit is not null")
    whole = whole.groupBy("record_id").agg(F.max("hit").alias("of")).withColumnRenamed("record_id", "target_id")
    revisits = found.where("type = 'revisit'").join(whole, F.col("refers_to") == F.col("target_id"), "left")
    shape = ["capture_id", "target_uri", F.col("type").alias("record_type"), "request", "metadata"]
    responses = found.where("type = 'response'").select(*shape, body.alias("response"), F.lit(None).cast("long").alias("refers_to"))
    again = F.struct(*(F.col(f"of.body.{c}").alias(c) for c in ("payload_bytes", "actual_digest", "payload")))
    return responses.unionByName(revisits.select(*shape, again.alias("response"), F.col("of.capture_id").alias("refers_to")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes ``pages`` as an archive in the shared folder, reads it back once and digests each capture."""
    path = scratch_path(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    records = scratch(read_archive(spark, path, payloads=False), "records")
    delete(spark, path)
    captures = assemble_captures(records)
    return captures.select(
        F.col("capture_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.actual_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        F.col("target_uri").alias("url"),
    )


SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
     d AS (SELECT page_id, url, strlen(h) AS n, min(page_id) OVER (PARTITION BY h) AS one,
           list_aggregate(list_transform(range(32), lambda i: substr('{_ALPHABET}', 1 + (
             (('0x' || substr(s, (i // 4) * 5 + 1, 5))::BIGINT >> ((3 - i % 4) * 5)) & 31)::INTEGER, 1)), 'string_agg', '') AS digest
           FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN one = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN one <> page_id THEN one END AS refers_to, coalesce(url, '') AS url
FROM d
"""
