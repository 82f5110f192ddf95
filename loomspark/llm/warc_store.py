"""Content-addressed WARC archive.

`headers` holds the exact header bytes of each record; `payloads` holds the bytes of each different payload once, under its SHA-256. A
record is rebuilt by joining the two on the digest. Of the records whose payloads are equal and at least REVISIT_BYTES long, the one with
the smallest page_id is a `response`, the others are `revisit` records that name it and carry no bytes; shorter payloads are all
`response`. Reading recomputes every payload's digest and length and fails if one differs.

All of it is DataFrame functions. The payload of a frequent digest is reduced to one on each task before it is shuffled; the joins on
digest are plain sort-merge joins that adaptive execution splits where a digest is frequent.

Cases: a null html is the empty payload. A null url leaves its header out. Repeated rows with the smallest page_id are all responses; a null page_id
sorts last and is a revisit wherever another page holds the payload. Carriage returns and line feeds of urls are percent-coded. Very long payloads are one value. An empty table gives an
empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, written

REVISIT_BYTES = 100
CRLF = "\r\n"


def _id(page: str) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(page).cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, date: str) -> tuple[DataFrame, DataFrame]:
    """The two tables of an archive: headers (page_id, digest, header) and payloads (digest, payload)."""
    html = F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    payloads = rows.groupBy("digest").agg(F.first("payload").alias("payload"))
    narrow = written(rows.select("page_id", "url", "digest", "size"), "digests")  # payloads are hashed once for the headers
    firsts = narrow.where(f"size >= {REVISIT_BYTES}").groupBy("digest").agg(F.min("page_id").alias("first"))
    named = narrow.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _id("page_id")),
        F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _id("first"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("size")).cast("string")),
        F.lit(CRLF),
    ]
    header = F.encode(F.concat_ws(CRLF, *lines), "UTF-8")
    return named.select("page_id", "digest", header.alias("header")), payloads


def write_archive(pages: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    headers, payloads = records(pages, date)
    headers.write.parquet(f"{path}/headers")
    payloads.write.parquet(f"{path}/payloads")


def _field(name: str) -> Column:
    found = F.regexp_extract(F.decode("header", "UTF-8"), f"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(found != "", found)


def _checked(payloads: DataFrame) -> DataFrame:
    actual = F.sha2("payload", 256)
    return payloads.withColumn("actual", F.when(actual == F.col("digest"), actual).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))).cast("string")))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, from its header and the verified payload: page_id, record_type, payload_bytes, payload_digest, refers_to, url, content_length."""
    payloads = _checked(spark.read.parquet(f"{path}/payloads")).select("digest", F.col("actual"), F.octet_length("payload").cast("long").alias("size"))
    headers = spark.read.parquet(f"{path}/headers").select("header", F.replace(_field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("digest"))

    def number(name: str) -> Column:
        return F.regexp_extract(_field(name), "<urn:x-page:(-?[0-9]+)>", 1).try_cast("long")

    return headers.join(payloads, "digest").select(
        number("WARC-Record-ID").alias("page_id"),
        _field("WARC-Type").alias("record_type"),
        F.col("size").alias("payload_bytes"),
        F.col("actual").alias("payload_digest"),
        number("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
        _field("Content-Length").cast("long").alias("content_length"),
    )


def rebuild(spark: SparkSession, path: str, original: bool = False) -> DataFrame:
    """page_id and the record's exact bytes. A revisit has no block; with `original` its payload is put back behind its header."""
    payloads = _checked(spark.read.parquet(f"{path}/payloads")).where("actual IS NOT NULL").select("digest", "payload")
    rows = spark.read.parquet(f"{path}/headers").join(payloads, "digest")
    block = F.col("payload") if original else F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return rows.select("page_id", F.concat(F.col("header"), block, F.lit(b"\r\n\r\n")).alias("record"))


def parse_warc(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file in memory."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not re.fullmatch(r"WARC/1\.[01]", first):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines)
        size = int(fields["Content-Length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        out.append((fields, block))
        at = end + 8 + size
    return out


def round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive of pages in the shared folder and read it back."""
    spark = pages.sparkSession
    path = shared_path(spark, "warc")
    write_archive(pages, path)
    return read_archive(spark, path)
