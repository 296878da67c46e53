"""WARC archives: writing captures, reading archives back, and assembling transactions.

A capture is three records: request, response (or revisit) and metadata; the first and last name the second in
WARC-Concurrent-To. Records are built as strings on the JVM and written through Spark's file writer, so any file system
works and a lost executor's files are never seen; CR LF CR LF, the record separator of the format, is the line separator.
An archive is one gzip stream of at most ``captures`` captures and about ARCHIVE_BYTES: pages of more than an even share
of that are written apart, as many to an archive as the largest of them allows. Reading takes one archive per row,
inflates it and walks it by Content-Length, so payloads may contain anything. Assembly joins request and metadata records to their
response by its id; both sides are grouped by id first, so no key repeats.

Equal payloads of at least MIN_REVISIT bytes are stored once: the capture with the least page_id (nulls last) is the
response, the others revisit it. Digests with one capture never join; a hot digest is one row on its side of the join,
which is broadcast, and no payload shuffled, while the repeated digests are few.

Edge cases: null html is an empty payload; a null url gives no target URI, CR and LF in a url become spaces; repeated
rows with the least page_id are all responses; a null page_id is kept as null; a malformed archive raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.arrowio import bounded
from spanloom.llm.common import saved
from spanloom.operators.joins import small
from spanloom.storage import shared_path

MIN_REVISIT = 100
CAPTURES, ARCHIVE_BYTES = 1000, 64 << 20
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def record(kind: str, id_: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A whole record without its final separator; headers whose value is null are left out."""
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), id_)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(F.concat_ws(EOL, *lines), F.lit(EOL + EOL), block)


def urn(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + "|"), key).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def with_types(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, payload, digest, size, first (the page revisited, else null), revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload").cast("long"))
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1")
    joined = rows.join(small(saved(firsts.select("digest", "first"), "digests")), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", "size", F.when(revisit, F.col("first")).alias("first"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", captures: int = CAPTURES, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes pages(page_id, url, html) as gzip archives under ``path``, a new folder."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    id_ = urn("response", F.concat(page, F.lit("|"), F.col("digest")))
    uri = ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))
    when = ("WARC-Date", F.lit(date))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("size").cast("string"), F.lit(EOL + EOL))
    path_part = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(uri[1], F.lit("")), r"^[a-z]+://[^/]*(/\S*)$", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(F.coalesce(uri[1], F.lit("")), r"^[a-z]+://([^/?#\s]*)", 1)
    asked = F.concat(F.lit("GET "), path_part, F.lit(f" HTTP/1.1{EOL}Host: "), host, F.lit(EOL + EOL))
    fields = F.concat_ws(EOL, F.concat(F.lit("pageId: "), F.col("page_id").cast("string")), F.concat(F.lit("refersToPageId: "), F.col("first").cast("string")))
    refers = urn("response", F.concat(F.col("first").cast("string"), F.lit("|"), F.col("digest")))
    main = F.when(
        F.col("revisit"),
        record("revisit", id_, [when, uri, digest, ("WARC-Refers-To", refers), ("WARC-Profile", F.lit(PROFILE)), ("Content-Type", F.lit("application/http;msgtype=response"))], http),
    ).otherwise(record("response", id_, [when, uri, digest, ("Content-Type", F.lit("application/http;msgtype=response"))], F.concat(http, F.col("payload"))))
    tied = [when, uri, ("WARC-Concurrent-To", id_)]
    records = F.array(
        record("request", urn("request", id_), [*tied, ("Content-Type", F.lit("application/http;msgtype=request"))], asked),
        main,
        record("metadata", urn("metadata", id_), [*tied, ("Content-Type", F.lit("application/warc-fields"))], fields),
    )
    rows = with_types(pages)
    share = archive_bytes // captures
    largest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    parts = [(rows.where(F.col("size") <= share), captures)]
    if largest > share:
        parts.append((rows.where(F.col("size") > share), max(1, min(captures, archive_bytes // largest))))
    for part, most in parts:
        lines = part.select(F.explode(records).alias("value")).write.mode("append")
        lines.option("lineSep", EOL + EOL).option("compression", "gzip").option("maxRecordsPerFile", 3 * most).text(path)


def records_of(data: bytes):
    """Yields (headers dict of lower-case names, block bytes) of an inflated archive."""
    at, end = 0, len(data)
    while at < end:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no record at byte {at}")
        lines = data[at:stop].decode().split(EOL)
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        first = stop + 4
        at = first + int(headers["content-length"])
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"a record's length does not lead to its end, byte {at}")
        yield headers, data[first:at]
        at += 4


def inflate(data: bytes) -> bytes:
    """All members of a gzip stream; other data as it is."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut off")
        data = member.unused_data
    return b"".join(out) + data


RECORD = (
    "id string, type string, concurrent_to string, refers_to string, target_uri string, date string, fields map<string,string>, "
    "payload binary, payload_bytes long, payload_digest string"
)
RECORD_ARROW = pa.schema(
    [("id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
     ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
)


def read_record(headers: dict, block: bytes) -> dict:
    """A row of RECORD. Stored payloads are measured and checked against their digest; a revisit's come from its headers."""
    kind = headers["warc-type"]
    row = {"id": headers["warc-record-id"], "type": kind, "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
           "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"), "fields": []}
    told = headers.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if kind == "metadata":
        row["fields"] = [(k, v) for k, _, v in (x.partition(": ") for x in block.decode().split(EOL)) if k]
    elif kind in ("response", "revisit"):
        head, _, payload = block.partition(b"\r\n\r\n")
        if kind == "response":
            found = hashlib.sha256(payload).hexdigest()
            if told not in (None, found):
                raise ValueError(f"{row['id']}: the payload does not have its digest")
            row |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
        else:
            http = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split(EOL)[1:])}
            row |= {"payload_bytes": int(http["content-length"]), "payload_digest": told}
    return row


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, limit: int = 8 << 20) -> DataFrame:
    """A RECORD row per record of the archives under ``path``; without payload that column is null."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, block in records_of(inflate(content.as_py())):
                    row = read_record(headers, block)
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row)
                    held += len(block)
                    if held > limit:
                        yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(path)
    return bounded(files.select("content")).mapInArrow(run, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One row per capture: capture (the response or revisit record), requests and metadata (arrays of records)."""
    whole = F.struct(*records.columns)

    def beside(kind: str, name: str) -> DataFrame:
        rows = records.where(F.col("type") == kind).select(F.col("concurrent_to").alias("to"), F.struct(*[c for c in records.columns if c != "payload"]).alias("r"))
        return rows.groupBy("to").agg(F.collect_list("r").alias(name))

    main = records.where(F.col("type").isin("response", "revisit")).select("id", whole.alias("capture"))
    return main.join(beside("request", "requests"), F.col("id") == F.col("to"), "left").drop("to").join(beside("metadata", "metadata"), F.col("id") == F.col("to"), "left").drop("to")


def op5(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = shared_path(spark, "warc")
    write_archives(pages, path)
    field = lambda name: F.element_at(F.col("metadata")[0]["fields"], name)
    kind = pages.schema["page_id"].dataType
    return transactions(read_archives(spark, path, with_payload=False)).select(
        field("pageId").cast(kind).alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"),
        F.col("capture.payload_digest").alias("payload_digest"),
        F.col("capture.type").alias("record_type"),
        field("refersToPageId").cast(kind).alias("refers_to"),
    )


ORACLE = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM q"""
