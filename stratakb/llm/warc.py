"""WARC records in a content-addressed archive.

``write_archive`` makes two Parquet tables in a folder: ``payloads`` holds each
payload's bytes once under its SHA-256, ``records`` holds the exact header
block of every record. ``read_archive`` joins them back to whole WARC/1.1
records, byte for byte: a response's block is an HTTP message with the payload
as its body, a revisit has no block. ``parse`` reads records from their bytes
alone. The digest is verified twice: payloads with an equal SHA-256 must agree
in length and SHA-1 when written, and a payload that is read back must hash to
its key.

Defined results: a null payload is empty; of records with equal payloads of at
least ``min_bytes`` bytes, those with the smallest id are responses and the
others revisits of it; smaller ones are all responses. A record without id
never is what others refer to unless no equal one has an id; then all are
responses. Repeated rows are records of their own (equal ids: all responses if
the id is the smallest). Line breaks in a url are left out of its header. Extra
columns are not archived; an empty table gives an empty archive.

All of it is DataFrame operations, and nothing is left in the catalog. Payloads
with equal digests are reduced to one before they are shuffled. Reading back,
each response takes its payload by an equi-join, in which adaptive execution
splits a payload that many records hold; revisits take the payload's length and
digest from its response, not the payload itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import drop_path, materialize, scratch, write

CRLF = "\r\n"
HTTP_HEAD = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def keyed(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, key, digest, n) of every page."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8")
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("key"), sha1_base32(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n")
    )


def records(pages: DataFrame, *, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", **columns) -> DataFrame:
    """(page_id, key, header, kind) of every page; the payload takes no part in the join."""
    rows = keyed(pages, **columns).select("page_id", "url", "key", "digest", "n")
    per = rows.groupBy("key").agg(F.min("page_id").alias("first"), F.min("n").alias("n0"), F.max("n").alias("n1"), F.min("digest").alias("d0"), F.max("digest").alias("d1"))
    verified = F.when((F.col("n0") == F.col("n1")) & (F.col("d0") == F.col("d1")), F.col("first")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the SHA-256 "), "key")))
    joined = rows.join(per.select("key", verified.alias("first")), "key", "left")
    joined = joined.withColumn("refers_to", F.when((F.col("n") >= min_bytes) & F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False)), F.col("first")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    original = F.col("refers_to").isNull()
    block = F.octet_length(http_head(F.col("n"))) + F.col("n")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(original, "response").otherwise("revisit")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(original, "").otherwise(F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", uri(F.col("refers_to"))))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(original, block.cast("string")).otherwise("0")),
        F.lit(CRLF),
    )
    return joined.select("page_id", "key", header.alias("header"), F.when(original, "response").otherwise("revisit").alias("kind"))


def http_head(n: Column) -> Column:
    """The head of the HTTP message with a body of n bytes."""
    return F.concat(F.lit(HTTP_HEAD), n.cast("string"), F.lit(CRLF * 2))


def write_archive(pages: DataFrame, path: str, *, min_bytes: int = 0, **columns) -> None:
    """Write the record headers, and every payload once."""
    write(records(pages, min_bytes=min_bytes, **columns), f"{path}/records")
    write(keyed(pages, **columns).select("key", "payload").dropDuplicates(["key"]), f"{path}/payloads")


def read_archive(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(page_id, key, header, payload, record) of all records, or of those of a kind: payload in full, record the bytes of the WARC record."""
    heads, stored = spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/payloads")
    heads = heads if kind is None else heads.where(F.col("kind") == kind)
    checked = stored.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a stored payload doesn't match "), "key")).cast("binary")))
    bytes_ = lambda c: F.encode(c, "utf-8")
    message = F.concat(bytes_(http_head(F.octet_length("payload"))), F.col("payload"))
    block = F.when(F.col("kind") == "response", message).otherwise(bytes_(F.lit("")))
    return heads.join(checked, "key").select("page_id", "key", "header", "payload", F.concat(bytes_(F.col("header")), block, bytes_(F.lit(CRLF * 2))).alias("record"))


def parse(archive: DataFrame, *, record: str = "record") -> DataFrame:
    """archive with record_type, refers_to, digest (as the header states it) and body, all from the record's bytes; a revisit's body is null.

    Positions are found in the bytes read as Latin-1, where a character is a byte.
    """
    raw = F.col(record)
    latin = archive.withColumn("__latin", F.decode(raw, "ISO-8859-1"))
    parts = latin.withColumn("__end", F.instr("__latin", CRLF * 2)).withColumn("__head", F.substring("__latin", F.lit(1), F.col("__end") + 1))
    field = lambda name: F.regexp_extract("__head", rf"(?:^|\n){name}: ([^\r\n]*)\r\n", 1)
    parts = parts.withColumn("__size", field("Content-Length").cast("int")).withColumn("__http", F.call_function("locate", F.lit(CRLF * 2), F.col("__latin"), F.col("__end") + 4) + 4)
    response = field("WARC-Type") == "response"
    body = F.substring(raw, F.col("__http"), F.col("__end") + 4 + F.col("__size") - F.col("__http"))
    refers = F.regexp_extract("__head", r"\nWARC-Refers-To: <urn:page:([^>]*)>\r\n", 1)
    return parts.select(
        *[F.col(f"`{c}`") for c in archive.columns],
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers).alias("refers_to"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("digest"),
        F.when(response, body).alias("body"),
    )


def round_trip(pages: DataFrame, *, page_id: str = "page_id", **how) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, verified) of the pages, archived in the shared folder and read back."""
    spark, kind = pages.sparkSession, pages.schema[page_id].dataType
    path = scratch(spark, "warc")
    write_archive(pages, path, page_id=page_id, **how)
    responses = parse(read_archive(spark, path, "response").select("page_id", "key", "record"))
    responses = responses.select("page_id", "key", F.octet_length("body").cast("long").alias("payload_bytes"), sha1_base32(F.col("body")).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"), "digest")
    responses = materialize(responses, "warc-responses")
    empty = F.encode(F.lit(CRLF * 2), "utf-8")
    heads = spark.read.parquet(f"{path}/records").where("kind = 'revisit'")
    revisits = parse(heads.select("page_id", "key", F.concat(F.encode("header", "utf-8"), empty).alias("record")))
    of = responses.groupBy("key").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    revisits = revisits.join(of, "key").select("page_id", "key", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "digest")
    out = materialize(responses.unionByName(revisits).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", (F.col("digest") == F.col("payload_digest")).alias("verified")), "warc-parsed")
    drop_path(spark, path)
    return out
