"""WARC records in a content-addressed archive.

The archive holds two tables: payloads, each stored once under its SHA-256 and compressed, and headers, the exact
header block of every record. A record is its header block joined to the payload of its digest.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import written

_DIGESTED = "page_id long, url string, sha256 string, sha1 string, size long, packed binary"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        payload = [x.as_py() or b"" for x in batch.column(2).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([hashlib.sha256(p).hexdigest() for p in payload], pa.string()),
                pa.array([base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payload], pa.string()),
                pa.array([len(p) for p in payload], pa.int64()),
                pa.array([tool.compress(p) for p in payload], pa.binary()),
            ],
            ["page_id", "url", "sha256", "sha1", "size", "packed"],
        )


def _header(kind, page, url, sha1, size, refers, date):
    """The exact header block of a record, as a column; a revisit carries no payload and names the one it repeats."""
    url = F.regexp_replace(F.coalesce(url, F.lit("")), "[\\r\\n]+", "")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(">")),
        F.concat(F.lit("WARC-Date: "), F.lit(date)),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), sha1),
        F.when(refers.isNotNull(), F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))),
        F.when(refers.isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(refers.isNull(), size).otherwise(F.lit(0)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html) as an archive of WARC records under path/headers and path/payloads.

    The payload is html in UTF-8; null is empty. Of records with equal payloads of at least `least` bytes, the one
    with the smallest page_id is a response and the others are revisits of it; smaller payloads are all responses.
    Equal means equal SHA-256. Rows that share the smallest page_id are all responses; a page without page_id is one
    too, is never revisited, and its record id says null. Line breaks in a url are dropped. Other columns are ignored.
    An empty table gives an empty archive. The date is a parameter, so that reruns write the same bytes.
    """
    pages = pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html")
    digested = pages.mapInArrow(_digest, _DIGESTED)
    named = digested.select("page_id", "url", "sha256", "sha1", "size")
    # written, so that the join can split the records of one common payload over tasks
    first = written(named.groupBy("sha256").agg(F.min("page_id").alias("first")))
    whole = named.join(first, "sha256")
    refers = F.when((F.col("size") >= least) & (F.col("first") != F.col("page_id")), F.col("first"))
    kind = F.when(refers.isNull(), F.lit("response")).otherwise(F.lit("revisit"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    headers = whole.select(_header(kind, page, F.col("url"), F.col("sha1"), F.col("size"), refers, date).alias("header"), "sha256", "url", "page_id")
    headers.write.parquet(f"{path}/headers")
    # a payload's bytes move once, if its record is the first of its digest
    owner = first.select("sha256", F.coalesce("first", F.lit(2**63 - 1)).alias("page_id"))
    bodies = digested.select(F.coalesce("page_id", F.lit(2**63 - 1)).alias("page_id"), "sha256", "packed")
    bodies.join(owner, ["sha256", "page_id"], "left_semi").dropDuplicates(["sha256"]).select("sha256", "packed").write.option("compression", "none").parquet(f"{path}/payloads")


_VERIFIED = "sha256 string, payload_sha1 string, payload_bytes long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        named, sha1, size = batch.column(0).to_pylist(), [], []
        for name, packed in zip(named, batch.column(1).to_pylist()):
            payload = zstandard.decompress(packed)
            if hashlib.sha256(payload).hexdigest() != name:
                raise ValueError(f"the payload stored under {name} has another digest")
            sha1.append(base64.b32encode(hashlib.sha1(payload).digest()).decode())
            size.append(len(payload))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha1, pa.string()), pa.array(size, pa.int64())], ["sha256", "payload_sha1", "payload_bytes"])


def _field(name: str):
    """A field of the header block; lines end with CR LF only, and no other kind of line end counts as one."""
    return F.regexp_extract("header", rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)


def _parsed(headers: DataFrame) -> DataFrame:
    number = lambda name: F.regexp_extract(_field(name), r"<urn:page:(-?\d+)>", 1).try_cast("long")
    return headers.select(
        "header",
        "sha256",
        number("WARC-Record-ID").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To").alias("refers_to"),
        F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        _field("WARC-Target-URI").alias("url"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_digest and payload_bytes of every record.

    Fields come from the stored header blocks. Every stored payload is read once and must have the digest under which
    it is stored, else the job fails; its size and SHA-1 are joined to the records, and a record whose header names
    another SHA-1 fails too.
    """
    stored = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads").mapInArrow(_verify, _VERIFIED)
    records = _parsed(spark.read.schema("header string, sha256 string").parquet(f"{path}/headers")).drop("header")
    whole = records.join(stored, "sha256", "left")
    good = F.when(F.col("payload_sha1") == F.col("payload_digest"), F.col("payload_bytes")).otherwise(F.raise_error(F.concat(F.lit("no payload with the digest of record "), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))).cast("long"))
    return whole.select("page_id", "url", good.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, header, payload and the record's exact bytes; the payload of a revisit is the one it refers to."""
    stored = spark.read.schema("sha256 string, packed binary").parquet(f"{path}/payloads")
    heads = _parsed(spark.read.schema("header string, sha256 string").parquet(f"{path}/headers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payload = [zstandard.decompress(x) for x in batch.column(3).to_pylist()]
            exact = [h.encode() + (p if kind == "response" else b"") + b"\r\n\r\n" for h, kind, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), payload)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(payload, pa.binary()), pa.array(exact, pa.binary())], ["page_id", "header", "payload", "record"])

    return heads.join(stored, "sha256").select("page_id", "header", "record_type", "packed").mapInArrow(run, "page_id long, header string, payload binary, record binary")


def export(spark: SparkSession, path: str, to: str) -> None:
    """Plain WARC files: the records one after another, each with the two line ends that close it."""
    records(spark, path).select(F.expr("decode(substring(record, 1, length(record) - 4), 'UTF-8')").alias("value")).write.option("lineSep", "\r\n\r\n").text(to)
