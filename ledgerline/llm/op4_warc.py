"""Operator 4: WARC writing and assembly of transactions.

*Writing.* Every page becomes three records: the request, the response (or a
revisit, if another page has the same payload) and metadata. Request and
metadata name the response in ``WARC-Concurrent-To``. Of pages with equal
payloads of ``MIN_REVISIT`` bytes or more, the one with the largest id is
written in full and the others refer to it. A record is one row of Spark's
text sink, whose line separator is the blank line that ends a record, so the
files are ordinary gzip-compressed WARC files.

*Reading.* Each archive is read by Spark as one binary row and cut into
records by ``Content-Length``; files are kept small when written, and a file
is the unit of a retry.

*Assembly.* Requests and metadata are joined to the response they are
concurrent to, in whichever of the two records the identifier stands; metadata
may also name the request. Revisits take page and length from the record whose
id ``WARC-Refers-To`` names, in whatever archive it is; a revisit of a record
that isn't there has neither. One nested row per capture comes out. Record ids are
unique, but for rows repeated in full that others refer to: their ids come from
page and digest, so that a revisit can be written without reading the other, and
their records are equal.

Defined results: a null payload is empty; equal payloads are told by SHA-256;
rows with equal ids and equal payloads, if that id is the largest, are all
responses; pages with null ids are always responses; pages that repeat
a ``page_id`` are captures of their own; an empty table gives no archive and
no row; a capture without request or metadata has null or an empty list there;
columns other than id, address and payload are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_limits, stage
from ledgerline.session import ensure_checkpoint_dir

MIN_REVISIT = 1000
FILE_BYTES = 8 << 20  # of payload, for each archive, on average
DATE = "2024-01-01T00:00:00Z"
RECORDS = ("record_id string, type string, concurrent_to array<string>, refers_to string, uri string,"
           " page_id long, payload_digest string, http_header string, payload_bytes long, payload_sha1 string,"
           " payload binary")


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, last) of the pages whose payload others have, too;
    ``last`` is the page that has it in full."""
    sums = pages.select("page_id", F.sha2("payload", 256).alias("digest")) \
                .filter((F.octet_length("payload") >= min_bytes) & F.col("page_id").isNotNull())
    shared = stage(sums.groupBy("digest").agg(F.max("page_id").alias("last"), F.min("page_id").alias("least"))
                   .filter("least < last").drop("least"), "warc-shared")
    return stage(sums.join(shared, "digest").select("page_id", "digest", "last").distinct(), "warc-revisits")


def _record(kind: str, record_id: Column, uri: Column, content: Column, more: list[Column]) -> Column:
    """A WARC record without the blank line that ends it."""
    head = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: "), record_id,
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        F.when(uri.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), uri, F.lit("\r\n"))).otherwise(""),
        *more, F.lit("Content-Length: "), F.octet_length(content).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, content)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = MIN_REVISIT) -> None:
    """Write the pages' records as ``.gz`` archives under ``folder``."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20]+", "%20").alias("uri"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    total = rows.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    files = max(1, -(-total // FILE_BYTES))
    known = revisits(rows, min_bytes)
    # pages are spread by their content and id, so archives are of like size
    rows = rows.withColumn("digest", F.sha2("payload", 256)) \
               .join(known, ["page_id", "digest"], "left") \
               .repartition(files, F.xxhash64("page_id", "uri", F.octet_length("payload"))) \
               .withColumn("no", F.monotonically_increasing_id().cast("string"))
    stem = uuid.uuid4().hex
    named = lambda what, key: F.concat(F.lit(f"<urn:x-capture:{stem}:{what}:"), key, F.lit(">"))
    by_page = lambda page: F.concat(F.lit("page:"), page.cast("string"), F.lit(":"), F.col("digest"))
    key = F.when(F.col("page_id") == F.col("last"), by_page(F.col("page_id"))).otherwise(F.concat(F.lit("row:"), "no"))
    name = lambda what: named(what, key)
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    page = F.coalesce(line("X-Page-ID", F.col("page_id").cast("string")), F.lit(""))
    digest = line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.octet_length("payload").cast("string"), F.lit("\r\n\r\n"))
    message = F.lit("Content-Type: application/http; msgtype=response\r\n")
    response = _record("response", name("response"), F.col("uri"), F.concat(http, F.col("payload")),
                       [page, digest, message])
    revisit = _record("revisit", name("response"), F.col("uri"), http,
                      [page, digest, message, line("WARC-Refers-To", named("response", by_page(F.col("last")))),
                       F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")])
    near = line("WARC-Concurrent-To", name("response"))
    request = _record("request", name("request"), F.col("uri"), F.lit("GET / HTTP/1.1\r\n\r\n"),
                      [near, F.lit("Content-Type: application/http; msgtype=request\r\n")])
    metadata = _record("metadata", name("metadata"), F.col("uri"), F.lit("fetchTimeMs: 0\r\n"),
                       [near, F.lit("Content-Type: application/warc-fields\r\n")])
    main = F.when(F.col("page_id") < F.col("last"), revisit).otherwise(response)
    rows.select(F.explode(F.array(request, main, metadata)).alias("value")) \
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def _number(value: str | None) -> int | None:
    """A header's number; None if it holds none, or one beyond 64 bits."""
    if value is None or not re.fullmatch(r"[+-]?[0-9]{1,19}", value):
        return None
    number = int(value)
    return number if -(1 << 63) <= number < 1 << 63 else None


def _parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive, compressed or not."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":  # one gzip member after the other
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = 0
    while (end := data.find(b"\r\n\r\n", at)) >= 0:
        fields: dict[str, list[str]] = {}
        for row in data[at:end].decode("utf-8", "replace").strip().split("\r\n")[1:]:
            key, _, value = row.partition(":")
            fields.setdefault(key.strip().lower(), []).append(value.strip())
        get = lambda key, fields=fields: fields.get(key, [None])[0]
        size = _number(get("content-length")) or 0
        content = data[end + 4:end + 4 + size]
        at = end + 4 + size
        while data[at:at + 2] == b"\r\n":
            at += 2
        head = None
        if (get("content-type") or "").startswith("application/http"):
            head, _, content = content.partition(b"\r\n\r\n")
            head = head.decode("utf-8", "replace")
        page = get("x-page-id")
        yield (get("warc-record-id"), get("warc-type"), fields.get("warc-concurrent-to", []), get("warc-refers-to"),
               get("warc-target-uri"), _number(page),
               (get("warc-payload-digest") or "").removeprefix("sha1:") or None, head, len(content),
               hashlib.sha1(content).hexdigest(), content)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``folder``. Without
    ``payload``, its length and digest alone leave the parser."""
    arrow_limits(spark)
    from pyspark.sql.pandas.types import to_arrow_schema
    schema = spark.createDataFrame([], RECORDS).schema
    if not payload:
        schema = type(schema)(schema.fields[:-1])
    arrow = to_arrow_schema(schema)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for b in batches:
            for data in b.column(0).to_pylist():
                rows, size = [], 0
                for r in _parse(data):
                    rows.append(r if payload else r[:-1])
                    size += len(r[-1]) if payload else 200
                    if size >= 4 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")
    return files.mapInArrow(records, schema)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id``, ``page_id``, ``uri``, nested
    ``request``, ``response`` and ``metadata`` (a list)."""
    main = F.col("type").isin("response", "revisit")
    body = ["payload"] if "payload" in records.columns else []
    said = ["http_header", "payload_bytes", "payload_sha1", *body]
    named = F.struct("record_id", "type", "refers_to", "payload_digest", *said)
    captures = records.filter(main).select(F.col("record_id").alias("capture_id"), "page_id", "uri",
                                           named.alias("response"))
    # identifiers may stand in either record of a pair
    forward = records.filter(~main).select(
        "record_id", "type", F.explode("concurrent_to").alias("other"), *said)
    backward = records.filter(main).select(F.col("record_id").alias("capture_id"),
                                           F.explode("concurrent_to").alias("record_id")).distinct()
    direct = forward.join(captures.select(F.col("capture_id").alias("other")).distinct(), "other") \
                    .select(F.col("other").alias("capture_id"), "record_id", "type", *said)
    named_there = records.filter(~main).join(backward, "record_id") \
                         .select("capture_id", "record_id", "type", *said)
    linked = direct.unionByName(named_there)
    by_request = forward.filter("type = 'metadata'").join(
        linked.filter("type = 'request'").select("capture_id", F.col("record_id").alias("other")), "other") \
        .select("capture_id", "record_id", "type", *said)
    part = F.struct("record_id", *said)
    parts = linked.unionByName(by_request).groupBy("capture_id").agg(
        F.min(F.when(F.col("type") == "request", part)).alias("request"),
        F.collect_set(F.when(F.col("type") == "metadata", part)).alias("metadata"))
    none = F.array().cast(parts.schema["metadata"].dataType)
    return captures.join(parts, "capture_id", "left") \
                   .withColumn("metadata", F.coalesce("metadata", none))


def captures_by_page(captures: DataFrame) -> DataFrame:
    """The contract's columns, with revisits resolved."""
    flat = stage(captures.select(
        "capture_id", "page_id", F.col("response.type").alias("record_type"),
        F.col("response.payload_bytes").alias("own_bytes"),
        F.col("response.payload_digest").alias("noted_digest"),
        F.when(F.col("response.type") == "response", F.col("response.payload_sha1")).alias("own_digest"),
        F.when(F.col("response.type") == "revisit", F.col("response.refers_to")).alias("to"),
        F.col("request.record_id").alias("request_id"), F.size("metadata").alias("n_metadata")), "warc-captures")
    whole = flat.filter("record_type = 'response'").groupBy(F.col("capture_id").alias("to")).agg(
        F.max("page_id").alias("refers_to"), F.max("own_bytes").alias("there_bytes"), F.max("own_digest").alias("there_digest"))
    return flat.join(stage(whole, "warc-responses"), "to", "left").select(
        "page_id", F.coalesce("there_bytes", "own_bytes").alias("payload_bytes"),
        F.coalesce("own_digest", "there_digest", "noted_digest").alias("payload_digest"), "record_type", "refers_to",
        "request_id", "n_metadata")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-warc-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    records = stage(read_archives(spark, folder, payload=False), "warc-records")
    return captures_by_page(transactions(records)) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                (F.col("request_id").isNotNull() & (F.col("n_metadata") > 0)).alias("complete"))


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < last THEN last END AS refers_to, true AS complete
FROM m
"""
