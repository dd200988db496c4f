"""Content-addressed web archive.

Writing. Every row of (page_id, url, payload) becomes a WARC 1.1 record: a record header, and a block of an HTTP response
header and the payload. Payload bytes are stored once, under their SHA-256; the exact header bytes of each record (both
headers) are stored apart from them, with the digest as link. Of the records with equal payloads of at least
`revisit_from` bytes, that with the smallest page_id is the response, the others are revisits that name it (profile
identical-payload-digest; their block ends with the HTTP header); records with smaller payloads are all responses. Both
stores are Parquet folders. Each task keeps one copy of a payload before payloads move, so copies are never gathered.

Reading. `reconstruct` joins headers and payloads to whole records, as they stand in a WARC file: record header, block,
two line ends; each payload is verified against its digest as it is read, and a payload that doesn't fit or is absent is an
error. `parse` takes whole records apart again: fields, and the payload found by the lengths that the headers give.
`read_archive` gives a row for each record out of the records thus rebuilt and parsed.

Every record has the date given to `write_archive`, as the table has none. A record's id is a UUID made of page_id, url and
digest; page_id also stands in a field of its own (none for null), as the revisit's response does. A url with control
characters is written with these as blanks, and exactly in Base64 in a field of its own; a null url is the empty string.
Null html counts as an empty payload. Rows with a null page_id are kept and never become the response that others name while
another row has an id; where all have none, all are responses. Rows that repeat a page_id and payload give records that
repeat, all of the same type, and their payload is stored once all the same. An empty table gives an empty archive. Extra
columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, table

REVISIT_FROM = 100
DATE = "1970-01-01T00:00:00Z"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CONTROL = r"[\x00-\x1f\x7f]"


def digested(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        payload.alias("payload"),
        F.sha2(payload, 256).alias("payload_digest"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
    )


def record_id(page_id: Column, url: Column, digest: Column) -> Column:
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("none")), digest, url).cast("binary"))
    at = lambda start, n: F.substring(h, start, n)
    # Version 8 (own rule) and the usual variant of a UUID.
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-8"), at(14, 3), F.lit("-a"), at(18, 3), F.lit("-"), at(21, 12), F.lit(">"))


def header(date: str) -> Column:
    """The exact bytes of a record before its payload: record header, empty line, HTTP header, empty line."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    revisit = F.col("record_type") == "revisit"
    length = F.octet_length(http) + F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    first = F.col("first")
    more = F.concat(
        F.lit("WARC-Refers-To: "), record_id(first["page_id"], first["url"], F.col("payload_digest")), F.lit(CRLF),
        F.lit("WARC-Refers-To-Page: "), name("refers_to"), F.lit(CRLF), F.lit("WARC-Profile: " + PROFILE + CRLF),
    )
    odd = F.concat(F.lit("WARC-Target-URI-Base64: "), F.regexp_replace(F.base64(F.encode("url", "UTF-8")), "[\r\n]", ""), F.lit(CRLF))
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.col("record_type"), F.lit(CRLF),
        F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("url"), F.col("payload_digest")), F.lit(CRLF),
        F.lit("WARC-Date: " + date + CRLF),
        F.lit("WARC-Page: "), name("page_id"), F.lit(CRLF),
        F.lit("WARC-Target-URI: "), F.regexp_replace("url", CONTROL, " "), F.lit(CRLF),
        F.when(F.regexp_like("url", F.lit(CONTROL)), odd).otherwise(F.lit("")),
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"), F.lit(CRLF),
        F.when(revisit, more).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), length.cast("string"), F.lit(CRLF + CRLF),
        http,
    )


def write_archive(pages: DataFrame, path: str, revisit_from: int = REVISIT_FROM, date: str = DATE) -> None:
    """Write the header store and the payload store below ``path``."""
    rows = digested(pages)
    # The smallest id, nulls last, with the url of its record.
    firsts = rows.groupBy("payload_digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"))
    records = rows.drop("payload").join(firsts, "payload_digest")
    first_id = F.col("first")["page_id"]
    revisit = (F.col("payload_bytes") >= revisit_from) & ~F.col("page_id").eqNullSafe(first_id) & first_id.isNotNull()
    records = records.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, first_id))
    records.select("payload_digest", "record_type", F.encode(header(date), "UTF-8").alias("header")).write.parquet(f"{path}/headers")
    rows.groupBy("payload_digest").agg(F.first("payload").alias("payload")).write.parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Digest and payload, each payload verified as it is read."""
    rows = spark.read.schema("payload_digest string, payload binary").parquet(f"{path}/payloads")
    right = F.when(F.sha2("payload", 256) == F.col("payload_digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload doesn't fit its digest "), F.col("payload_digest"))).cast("binary")
    )
    return rows.select("payload_digest", right.alias("payload"))


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(record, full_bytes): whole records as in a WARC file, and the length of the page's own payload, also of revisits."""
    heads = spark.read.schema("payload_digest string, record_type string, header binary").parquet(f"{path}/headers")
    kept = read_payloads(spark, path)
    there = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("no payload under "), F.col("payload_digest"))).cast("binary"))
    responses = heads.where("record_type <> 'revisit'").join(kept, "payload_digest", "left").withColumn("payload", there)
    # Revisits need their payload's length only, so the payload itself doesn't move for them.
    sizes = kept.select("payload_digest", F.octet_length("payload").cast("long").alias("full_bytes"))
    revisits = heads.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn(
        "full_bytes", F.coalesce("full_bytes", F.raise_error(F.concat(F.lit("no payload under "), F.col("payload_digest"))).cast("long"))
    )
    end = F.lit(b"\r\n\r\n")
    whole = responses.select(F.concat("header", "payload", end).alias("record"), F.octet_length("payload").cast("long").alias("full_bytes"))
    return whole.unionByName(revisits.select(F.concat("header", end).alias("record"), "full_bytes"))


def parse(records: DataFrame) -> DataFrame:
    """Adds to each row of (record, ...): page_id, record_id, url, date, payload_digest, record_type, refers_to, and payload: the bytes
    after the HTTP header (none on revisits). A record whose lengths don't fit is an error."""
    # A record header is ASCII but for the url; a copy of the first part is enough to read it, and never the payload.
    text = F.substring_index(F.col("record").cast("string"), CRLF + CRLF, 2)
    rows = records.withColumn("_head", text).withColumn("_own", F.substring_index("_head", CRLF + CRLF, 1))
    field = lambda name: F.regexp_extract("_own", f"(?m)^{name}: (.*)$", 1)
    number = lambda name: F.when(field(name).rlike("^-?[0-9]+$"), field(name)).cast("long")
    block = F.octet_length("_own") + 4
    payload_at = F.octet_length("_head") + 4
    length = field("Content-Length").cast("int") - (payload_at - block)
    fits = F.octet_length("record") == payload_at + length + 4
    payload = F.when(fits, F.substring(F.col("record"), payload_at + 1, length)).otherwise(F.raise_error(F.lit("a record's lengths don't fit")).cast("binary"))
    exact = field("WARC-Target-URI-Base64")
    url = F.when(exact != "", F.decode(F.unbase64(exact), "UTF-8")).otherwise(field("WARC-Target-URI"))
    return rows.select(
        *records.columns,
        number("WARC-Page").alias("page_id"), field("WARC-Record-ID").alias("record_id"), url.alias("url"), field("WARC-Date").alias("date"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha256:", "").alias("payload_digest"), field("WARC-Type").alias("record_type"),
        number("WARC-Refers-To-Page").alias("refers_to"), payload.alias("payload"),
    )


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, rebuilt and parsed. A response's digest and length are those of the payload found in it."""
    rows = parse(reconstruct(spark, path))
    revisit = F.col("record_type") == "revisit"
    found = F.when(revisit, F.col("payload_digest")).otherwise(F.sha2("payload", 256))
    size = F.when(revisit, F.col("full_bytes")).otherwise(F.octet_length("payload").cast("long"))
    return rows.select("page_id", "url", size.alias("payload_bytes"), found.alias("payload_digest"), "record_type", "refers_to")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).drop("url")


ORACLE_OP8 = f"""
WITH p AS (
  SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages
), f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= {REVISIT_FROM} AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {REVISIT_FROM} AND page_id <> m THEN m END AS refers_to
FROM f
"""
