"""Content-addressed WARC archive: payload bytes once by SHA-256, exact record headers apart.

An archive is a folder with two Parquet tables. `payloads` has each distinct payload once under its SHA-256.
`headers` has, for each record, the exact header block (CRLF lines up to and with the empty line), the key of
the payload it is about, and whether the payload follows the header in the record (a response) or not (a revisit).
Joining them on the key gives the WARC records back byte by byte; every payload read is hashed again first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import join_skewed, materialize, scratch_path, table

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: RFC 4648 base32 against the digits of conv().
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 160 bits are four times 40 bits of eight digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), DIGITS, BASE32)


def _header(date: str) -> Column:
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = F.col("record_type") == "response"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn("page_id")),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(own, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn("refers_to")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(own, F.col("payload_bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )


def write_archive(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record per row of pages (page_id, url, html) to the archive at path.

    Of the records with one payload of at least min_revisit_bytes bytes, that of the largest page_id is the response and
    the others revisit it. A null html is an empty payload; a null url leaves its header line out; a null page_id is the
    smallest. Of rows that repeat the largest page_id with its payload one is the response, the others revisit it. Other
    columns of pages are ignored. No pages make an archive of no records.
    """
    src = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    src = src.withColumn("key", F.unhex(F.sha2("payload", 256)))
    repeat = F.row_number().over(Window.partitionBy("page_id", "key").orderBy("key"))
    keys = src.select("page_id", "url", "key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    keys = materialize(keys.withColumn("_copy", repeat), "warc-keys")
    owners = keys.groupBy("key").agg(F.max("page_id").alias("_owner"), F.count("*").alias("_count"))

    marked = join_skewed(keys, owners, "key", "_count", keys.count())
    small = F.col("payload_bytes") < min_revisit_bytes
    own = small | (F.col("page_id").eqNullSafe(F.col("_owner")) & (F.col("_copy") == 1))
    marked = marked.withColumn("record_type", F.when(own, "response").otherwise("revisit")).withColumn("refers_to", F.when(~own, F.col("_owner")))
    marked.select(F.encode(_header(date), "UTF-8").alias("header"), "key", own.alias("has_payload")).write.parquet(f"{path}/headers")

    # By page and key, not by key alone: however many pages share a payload, one of them is taken. The join and the
    # window have the same plain keys (a null page as text), so payloads move once.
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    kept = src.select(as_text("page_id").alias("page"), "key", "payload")
    kept = kept.join(owners.select(as_text("_owner").alias("page"), "key"), ["page", "key"], "left_semi")
    kept = kept.withColumn("_copy", F.row_number().over(Window.partitionBy("page", "key").orderBy("key"))).filter("_copy = 1")
    kept.select("key", "payload").write.parquet(f"{path}/payloads")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """key and payload; a payload that doesn't have its digest stops the job."""
    stored = spark.read.schema("key binary, payload binary").parquet(f"{path}/payloads")
    right = F.unhex(F.sha2("payload", 256)) == F.col("key")
    return stored.withColumn("payload", F.when(right, F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not have its digest")).cast("binary")))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """The exact headers with the fields parsed from them: page_id, record_type, refers_to, url, digest.

    A field that a header hasn't, or a page id that is no whole number, is null. An empty archive has no rows.
    """
    stored = spark.read.schema("header binary, key binary, has_payload boolean").parquet(f"{path}/headers")
    text = F.decode("header", "UTF-8")
    field = lambda name: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    page = lambda name: F.regexp_extract(text, rf"\r\n{name}: <urn:page:(-?\d+)>\r\n", 1).try_cast("long")
    return stored.select(
        "*",
        page("WARC-Record-ID").alias("page_id"),
        field("WARC-Type").alias("record_type"),
        page("WARC-Refers-To").alias("refers_to"),
        F.nullif(field("WARC-Target-URI"), F.lit("")).alias("url"),
        F.regexp_extract(text, r"\r\nWARC-Payload-Digest: sha1:([A-Z2-7]{32})\r\n", 1).alias("stated_digest"),
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """The WARC records byte by byte: page_id and record (header, block, two line ends), one for each header.

    A revisit has an empty block; a payload that isn't what its digest says stops the job.
    """
    with_block = read_headers(spark, path).join(read_payloads(spark, path), "key")
    block = F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit(b""))
    return with_block.select("page_id", F.concat(F.col("header"), block, F.lit((CRLF + CRLF).encode())).alias("record"))


def query(spark, sf_dir: str) -> DataFrame:
    """op5: write the archive of `pages` to the shared folder, then read it back."""
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    headers = read_headers(spark, path)
    facts = read_payloads(spark, path).select("key", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    facts = materialize(facts.join(headers.groupBy("key").agg(F.count("*").alias("n_records")), "key"), "warc-facts")
    full = join_skewed(headers.select("key", "page_id", "record_type", "refers_to", "stated_digest"), facts, "key", "n_records", headers.count())
    same = F.col("stated_digest") == F.col("payload_digest")
    digest = F.when(same, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header states another digest")).cast("string"))
    return full.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


#: base32 of the 160 bits: twenty bits, four characters, from every five digits of the hex digest.
SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, sha1(t) AS x, max(page_id) OVER (PARTITION BY t) AS last FROM p),
d AS (SELECT *, [CAST('0x' || substr(x, 5 * g + 1, 5) AS BIGINT) FOR g IN range(8)] AS v FROM h)
SELECT page_id, payload_bytes, array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> s) % 32 + 1 AS INTEGER), 1) FOR s IN [15, 10, 5, 0]], '') FOR n IN v], '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""
