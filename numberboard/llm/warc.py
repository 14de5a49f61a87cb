"""Content-addressed WARC archive: each payload once by digest, every record's header bytes apart.

``write_archive`` writes two tables: ``payloads`` (digest, payload), one row for each distinct payload,
keyed by SHA-256, and ``headers`` (record_id, digest, header), the exact header bytes of each WARC/1.1
record. ``read_headers`` parses the headers back, ``read_payloads`` checks every payload against its
digest and fails on a mismatch, ``rebuild`` joins both into the original record bytes.

Of records with equal payloads of at least ``min_bytes`` the one with the largest id is the response
and the others are revisits that refer to it; below that size all are responses. Payloads are reduced
to one on the map side, so a payload that a third of all records share moves once for each task.

Defined cases: a null payload is an empty one. A null url leaves out the target line. Line ends in a
url are percent-encoded. Repeated rows of the same id and payload are all responses (none is larger),
stored once. A record without id refers to the largest id of its payload; if there is none it is a
response. An empty table gives empty archives. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from numberboard.sources.workspace import workspace

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"
RECORD_NAME = "urn:page:"

HEADERS_SCHEMA = "record_id long, digest binary, header binary"
PAYLOADS_SCHEMA = "digest binary, holder long, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits, five of them to four letters."""
    digits = F.sha1(payload)
    letters = []
    for k in range(8):
        value = F.conv(F.substring(digits, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(END))


def _name(record_id: Column) -> Column:
    return F.concat(F.lit(f"<{RECORD_NAME}"), F.coalesce(record_id.cast("string"), F.lit("none")), F.lit(">"))


def header_text(date: str) -> Column:
    """Header of a record with columns record_id, url, label, size, refers_to, is_revisit."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    revisit = F.concat(
        F.coalesce(_line("WARC-Refers-To", _name(F.col("refers_to"))), F.lit("")),
        _line("WARC-Profile", F.lit(REVISIT_PROFILE)),
    )
    return F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", F.when(F.col("is_revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _name(F.col("record_id"))),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("label"))),
        F.when(F.col("is_revisit"), revisit).otherwise(""),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(F.col("is_revisit"), 0).otherwise(F.col("size")).cast("string")),
        F.lit(END),
    )


def write_archive(records: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``records`` (record_id long, url, payload binary) as the archive at ``path``."""
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    whole = records.select("record_id", "url", payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("digest"))
    once = whole.groupBy("digest").agg(F.max("record_id").alias("holder"), F.first("payload").alias("payload"))
    once.write.parquet(f"{path}/payloads")
    holders = _payloads(records.sparkSession, path).select("digest", "holder")
    known = whole.select(
        "record_id", "url", "digest", F.octet_length("payload").cast("long").alias("size"), sha1_base32(F.col("payload")).alias("label")
    ).join(holders, "digest")
    revisit = (F.col("size") >= min_bytes) & F.coalesce(F.col("record_id") != F.col("holder"), F.col("holder").isNotNull())
    known = known.withColumn("is_revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("holder")))
    known.select("record_id", "digest", header_text(date).cast("binary").alias("header")).write.parquet(f"{path}/headers")


def _payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAYLOADS_SCHEMA).parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Stored payloads; a payload that doesn't have its digest stops the job."""
    stored = _payloads(spark, path)
    sound = F.unhex(F.sha2("payload", 256)) == F.col("digest")
    checked = F.when(sound, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload doesn't have its digest")).cast("binary"))
    return stored.select("digest", checked.alias("payload"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Headers with what their bytes say: record_type, refers_to, payload_label, content_length."""
    stored = spark.read.schema(HEADERS_SCHEMA).parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        return F.regexp_extract(text, f"(?m)^{name}: ([^\r\n]*)", 1)

    return stored.select(
        "record_id",
        "digest",
        "header",
        field("WARC-Type").alias("record_type"),
        F.regexp_extract(field("WARC-Refers-To"), rf"^<{RECORD_NAME}(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("payload_label"),
        field("Content-Length").cast("long").alias("content_length"),
    )


def rebuild(spark: SparkSession, path: str) -> DataFrame:
    """The original records: record_id and their bytes, header, block (none for a revisit) and two line ends."""
    heads = read_headers(spark, path)
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    joined = heads.join(read_payloads(spark, path), "digest")
    return joined.select("record_id", "record_type", F.concat("header", block, F.lit((END * 2).encode())).alias("record"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, sizes and digests taken anew from the stored payloads; payloads don't move."""
    sizes = read_payloads(spark, path).select(
        "digest", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest")
    )
    return read_headers(spark, path).join(sizes, "digest").select(
        "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages' html as an archive in the shared folder and read its index back."""
    path = workspace(pages.sparkSession, "warc")
    records = pages.select(
        F.col("page_id").cast("long").alias("record_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").cast("binary").alias("payload"),
    )
    write_archive(records, path, min_bytes)
    return read_index(pages.sparkSession, path).withColumnRenamed("record_id", "page_id")
