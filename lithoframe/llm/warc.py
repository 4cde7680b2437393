"""WARC archives with content-addressed payloads.

Payload bytes are stored once per SHA-256; exact record headers are a table of their own; records are rebuilt by joining
the two. Digests are verified: copies of one SHA-256 must agree in SHA-1 and length to be stored once, and stored bytes
must have their SHA-256 when read; else the job fails. A null payload is empty, a null id sorts last. Rows that repeat an
id and a payload are one record written again and keep one type: all of them are the response if that id is the
smallest of its payload. Payloads of any length are stored
whole. An empty table gives empty archives; columns that are not read do not matter. Hot payloads are
reduced to one row per task before any shuffle, and their records are dealt over several parts where they meet them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, met, written

#: Payloads of fewer bytes never become revisits.
MIN_BYTES = 0
#: Fixed value: the date written to every record, so that archives are reproducible.
RECORD_DATE = "2024-01-01T00:00:00Z"


def base32(hex40: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string: 20 bits at a time."""
    parts = [
        F.translate(F.lpad(F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 32), 4, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
        for i in range(8)
    ]
    return F.concat(*parts)


@dataclass
class Archive:
    """``payloads`` (sha256, payload, smallest id, number of records) and ``headers`` (id, sha256, header) as stored."""

    payloads: DataFrame
    headers: DataFrame
    key: str


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> Archive:
    """Writes both tables to the shared folder."""
    rows = pages.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(url), F.lit("")).alias("uri"),
        F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumns({"sha256": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long"), "sha1": base32(F.sha1("payload"))})
    unlike = (F.min("sha1") != F.max("sha1")) | (F.min("bytes") != F.max("bytes"))
    stored = rows.groupBy("sha256").agg(F.any_value("payload").alias("payload"), F.min("id").alias("first_id"), F.count("*").alias("n"), unlike.alias("unlike"))
    sure = F.when(~F.col("unlike"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("two payloads have the digest "), F.col("sha256"))).cast("binary"))
    store = written(stored.select("sha256", sure.alias("payload"), "first_id", "n"), "payloads")
    rare = store.select("sha256", "first_id")
    facts = met(rows.select("id", "uri", "sha256", "bytes", "sha1"), rare, "sha256", hot_payloads(store), "id")
    response = (F.col("bytes") < min_bytes) | F.col("id").eqNullSafe(F.col("first_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uuid = lambda of: F.regexp_replace(F.md5(F.coalesce(of.cast("string"), F.lit("null")).cast("binary")), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    header = F.concat(
        F.lit("WARC/1.0\r\n"),
        line("WARC-Type", F.when(response, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid(F.col("id")), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("uri", r"[\r\n]", " ")),
        line("WARC-Date", F.lit(RECORD_DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(response, F.lit("")).otherwise(
            F.concat(
                line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
                line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), uuid(F.col("first_id")), F.lit(">"))),
                line("X-Refers-To-Key", F.col("first_id").cast("string")),
            )
        ),
        line("Content-Type", F.lit("text/html; charset=UTF-8")),
        line("Content-Length", F.when(response, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
    )
    headers = written(facts.select("id", "sha256", F.encode(header, "UTF-8").alias("header")), "headers")
    return Archive(store, headers, key)


def hot_payloads(payloads: DataFrame) -> list[str]:
    """Digests that very many records have, of bounded number."""
    return hot_keys(payloads.select("sha256", "n"), payloads.agg(F.sum("n")).head()[0] or 0)


def field(header: Column, name: str) -> Column:
    """The value of a header line, null if there is none."""
    found = F.regexp_extract(F.decode(header, "UTF-8"), rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read(archive: Archive) -> DataFrame:
    """Every record as (key, header, payload, sha256, payload_bytes, payload_digest); a stored payload that does not have its digest raises."""
    good = archive.payloads.where(
        F.when(F.sha2("payload", 256) == F.col("sha256"), True).otherwise(
            F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("sha256"))).cast("boolean")
        )
    ).select("sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("payload_digest"))
    return met(archive.headers, good, "sha256", hot_payloads(archive.payloads), "id").withColumnRenamed("id", archive.key)


def records(archive: Archive) -> DataFrame:
    """Every record as (key, record, payload_bytes, payload_digest); ``record`` has its exact bytes: header, blank line, payload of responses, two line ends."""
    end = F.lit(b"\r\n")
    body = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return read(archive).select(archive.key, F.concat("header", end, body, end, end).alias("record"), "payload_bytes", "payload_digest")


def query(spark, sf_dir: str) -> DataFrame:
    """Archives every page, rebuilds every record and returns what it says."""
    archive = write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    # a record's header ends at its first blank line, which no header line can hold
    header = F.substring_index(F.decode("record", "UTF-8"), "\r\n\r\n", 1)
    said = lambda name: F.nullif(F.regexp_extract(F.col("_header"), rf"\r\n{name}: ([^\r\n]*)", 1), F.lit(""))
    return records(archive).withColumn("_header", header).select(
        "page_id", "payload_bytes", "payload_digest",
        said("WARC-Type").alias("record_type"), said("X-Refers-To-Key").cast("long").alias("refers_to"),
    )


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, {5 * i + 1}, 5))::INT // {1 << shift}) % 32 + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
SQL = f"""
WITH r AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h, min(page_id) OVER (PARTITION BY b) AS first_id FROM r)
SELECT page_id, payload_bytes, {_CHARS} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to FROM f"""
