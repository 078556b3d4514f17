"""Content-addressed archive of WARC records.

An archive is two Parquet tables in one folder:

* ``payloads``: (address, payload), every distinct payload once, addressed by its SHA-256;
* ``records``: (record_no, address, header), the exact header text of every record.

Writing: one narrow pass digests the payloads; each address is checked to stand for one byte string
(its SHA-1 and length must agree over all rows, else the write fails), and the record with the
smallest key is the response, the others revisit it.  Payloads are de-duplicated by an aggregate
that combines copies before the shuffle, so thousands of copies of one page travel once per task.
Reading checks each payload's digest once, joins headers and payloads by address, and parses the headers (payloads
travel only where they are asked for); ``record_bytes`` gives a whole record as it stands in a WARC file.

Headers are those of WARC/1.1: record ids are UUIDs that no other archive has, a revisit names its profile and, in
WARC-Refers-To and WARC-Refers-To-Target-URI, the response.  The rows' keys stand in two further headers of our own.

Cases: a null payload is empty; payloads under ``min_bytes`` are never revisits; a null key sorts
last and is left out of the header; of rows with equal key and payload one is the response; CR, LF
and % in a URL are percent-escaped (a header is one line); an empty table gives empty tables.  Only
key, url and payload columns are read, so other columns of any name don't matter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagsift.session import checkpoint_path

CRLF = "\r\n"
# Digits of conv(..., 32) and the base-32 alphabet of RFC 4648.
_CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(sha1_hex: Column) -> Column:
    """Upper-case base-32 text of a SHA-1 given in hex: 40 bits make 10 hex or 8 base-32 digits."""
    parts = [F.lpad(F.conv(F.substring(sha1_hex, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), _CONV32, _RFC4648)


def _one_line(url: Column) -> Column:
    return F.replace(F.replace(F.replace(url, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")),
                     F.lit("\n"), F.lit("%0A"))


# Fixed value: the profile of a revisit that has the payload of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(archive: str, record_no: Column) -> Column:
    h = F.md5(F.concat(F.lit(f"{archive}/"), record_no.cast("string")))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _header(archive: str, kind: Column, record_no: Column, key: Column, url: Column, digest: Column, first: Column,
            length: Column, date: Column) -> Column:
    """``first``: null, or for a revisit the struct (record_no, key, url) of its response."""
    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))).otherwise("")

    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", kind),
        line("WARC-Record-ID", _record_id(archive, record_no)), line("WARC-Date", date),
        line("WARC-Target-URI", _one_line(url)), line("X-Source-Key", key),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Profile", F.when(first.isNotNull(), F.lit(PROFILE))),
        line("WARC-Refers-To", F.when(first.isNotNull(), _record_id(archive, first["record_no"]))),
        line("WARC-Refers-To-Target-URI", _one_line(first["url"])), line("X-Refers-To-Key", first["key"]),
        line("Content-Length", length), F.lit(CRLF))


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html",
                  min_bytes: int = 0, date: str | Column = "2024-01-01T00:00:00Z") -> None:
    """Write ``pages`` as an archive under ``path`` (a folder on shared storage); ``date``: one for all records, or a column."""
    spark, archive = pages.sparkSession, uuid.uuid4().hex
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    # Record numbers are written before they are used: a recomputed task can't renumber anything.
    pages.select(
        F.monotonically_increasing_id().alias("record_no"), F.col(key).alias("key"), F.col(url).alias("url"),
        (F.lit(date) if isinstance(date, str) else date).cast("string").alias("date"), F.sha2(body, 256).alias("address"), F.sha1(body).alias("sha1"),
        F.octet_length(body).cast("long").alias("length")).write.parquet(f"{path}/staged")
    rows = spark.read.parquet(f"{path}/staged")
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "record_no", "url"))
    groups = rows.groupBy("address").agg(
        first.alias("first"), F.min("sha1").alias("lo"), F.max("sha1").alias("hi"),
        F.min("length").alias("least"), F.max("length").alias("most"))
    clash = (F.col("lo") != F.col("hi")) | (F.col("least") != F.col("most"))
    groups = groups.select("address", F.when(clash, F.raise_error(F.lit("two payloads share an address")))
                           .otherwise(F.col("first.record_no")).cast("long").alias("first_no"), "first")
    revisit = (F.col("record_no") != F.col("first_no")) & (F.col("length") >= min_bytes)
    records = rows.join(groups, "address").select(
        "record_no", "address",
        _header(archive, F.when(revisit, "revisit").otherwise("response"), F.col("record_no"), F.col("key"), F.col("url"),
                base32_sha1(F.col("sha1")), F.when(revisit, F.col("first")),
                F.when(revisit, F.lit(0)).otherwise(F.col("length")), F.col("date")).alias("header"))
    records.write.parquet(f"{path}/records")
    bodies = pages.select(F.sha2(body, 256).alias("address"), body.alias("payload"))
    bodies.groupBy("address").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive: record_no, header, payload (the full one, also for revisits), payload_bytes, and the parsed
    fields record_type, key, url, payload_digest, refers_to."""
    payloads = spark.read.parquet(f"{path}/payloads")
    # Every payload is digested once, and what is checked is what travels.
    good = lambda c, kind: F.when(F.sha2("payload", 256) == F.col("address"), c).otherwise(
        F.raise_error(F.lit("payload does not match its address")).cast(kind))
    payloads = payloads.select("address", good(F.col("payload"), "binary").alias("payload"), good(F.sha1("payload"), "string").alias("sha1"),
                               F.octet_length("payload").cast("long").alias("payload_bytes"))
    whole = spark.read.parquet(f"{path}/records").join(payloads, "address")

    def field(name: str) -> Column:
        found = F.regexp_extract("header", f"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(F.contains(F.col("header"), F.lit(f"{CRLF}{name}: ")), found)

    plain = F.replace(F.replace(F.replace(field("WARC-Target-URI"), F.lit("%0A"), F.lit("\n")),
                                F.lit("%0D"), F.lit("\r")), F.lit("%25"), F.lit("%"))
    digest = base32_sha1(F.col("sha1"))
    return whole.select(
        "record_no", "header", "payload", "payload_bytes", field("WARC-Type").alias("record_type"),
        field("X-Source-Key").alias("key"), plain.alias("url"),
        F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), digest), digest)
        .otherwise(F.raise_error(F.lit("payload does not match the digest in its header")).cast("string"))
        .alias("payload_digest"), field("X-Refers-To-Key").alias("refers_to"))


def record_bytes(records: DataFrame) -> DataFrame:
    """record_no and the record as it stands in a WARC file: header, payload (none in a revisit), two line ends."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return records.select("record_no", F.concat(F.encode("header", "UTF-8"), body,
                                                F.encode(F.lit(CRLF * 2), "UTF-8")).alias("record"))


def archive_folder(spark: SparkSession) -> str:
    return checkpoint_path(spark, f"warc-{uuid.uuid4().hex}")
