"""Content-addressed WARC archive.

An archive is two tables in a folder: `payloads` holds the bytes of each distinct payload once, under their
SHA-256; `records` holds the exact header block of every WARC record, with the digest of the payload it stands
for. A record as a WARC file would have it is a join of the two. Equal digests count as equal payloads only
with equal length and equal SHA-1 besides, and every payload read back is held against all three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, scratch, small_side, with_row

REVISIT_BYTES = 1000
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ENDS = "\r\n"


def _field(name: str, value: Column) -> Column:
    """A header line; no line at all where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_ENDS)), F.lit(""))


def _uri(url: Column) -> Column:
    """A url in a header line: control characters, which would end the line, become per cent codes."""
    for code in (9, 10, 13, 0):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archives every row. Of equal payloads of `revisit_bytes` or more, the one with the largest page_id (null
    below all; of repeated rows the first read) is a response and the others are its revisits; smaller
    payloads are all responses. Null html counts as empty; a null url gets no target line. An empty table
    makes an empty archive. Columns other than the three are not read."""
    slim = with_row(pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")))
    facts = cut(slim.select("__row", "id", "url", F.octet_length("payload").cast("long").alias("size"), F.sha1("payload").alias("sha1"), F.sha2("payload", 256).alias("sha256")), "warc-facts")
    same = ["sha256", "size", "sha1"]
    first = F.max(F.struct(F.col("id").isNotNull(), F.col("id").alias("id"), (-F.col("__row")).alias("back")))
    groups = cut(facts.groupBy(*same).agg(first.alias("top")).select(*same, F.col("top.id").alias("top_id"), (-F.col("top.back")).alias("owner")), "warc-groups")
    owners = groups.select(F.col("owner").alias("__row"))
    slim.select("__row", "payload").join(small_side(owners, groups.count()), "__row", "left_semi").select(F.sha2("payload", 256).alias("sha256"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    known = facts.join(groups, same)
    revisit = (F.col("size") >= revisit_bytes) & (F.col("__row") != F.col("owner"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{_ENDS}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", name(F.col("id"))),
        _field("WARC-Date", F.lit(_DATE)),
        _field("WARC-Target-URI", _uri(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(revisit, F.concat(_field("WARC-Refers-To", name(F.col("top_id"))), _field("WARC-Profile", F.lit(_PROFILE)))).otherwise(""),
        _field("Content-Type", F.lit("text/html; charset=utf-8")),
        _field("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("size")).cast("string")),
        F.lit(_ENDS),
    )
    known.select("sha256", "size", header.cast("binary").alias("header")).write.parquet(f"{path}/records")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record: header, payload (of a revisit that of the response it stands for), digest.

    Fails if a payload isn't there, or isn't what its digests and its length say.
    """
    payloads = spark.read.parquet(f"{path}/payloads")
    found = spark.read.parquet(f"{path}/records").join(payloads, "sha256", "left")
    right = (F.sha2("payload", 256) == F.col("sha256")) & (F.octet_length("payload") == F.col("size"))
    payload = F.when(F.coalesce(right, F.lit(False)), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload missing or damaged: "), F.col("sha256"))).cast("binary"))
    return found.select("header", payload.alias("payload"), "sha256")


def record_bytes(records: DataFrame) -> DataFrame:
    """The records as they stand in a WARC file: header block, block, two line ends. A revisit has no block."""
    empty = F.col("header").cast("string").contains("\r\nWARC-Type: revisit\r\n")
    block = F.when(empty, F.lit(b"")).otherwise(F.col("payload"))
    return records.select(F.concat("header", block, F.lit((_ENDS * 2).encode())).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """What the headers say, and length and SHA-1 of the payload itself."""
    text = F.col("header").cast("string")
    field = lambda name, value: F.regexp_extract(text, rf"\r\n{name}: {value}\r\n", 1)
    number = lambda name: F.expr(f"try_cast({name} AS BIGINT)")
    found = records.select(
        field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("of"),
        field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("to"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]+)").alias("written"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("found"),
    )
    digest = F.when(F.col("written") == F.col("found"), F.col("found")).otherwise(F.raise_error(F.lit("payload differs from its header")).cast("string"))
    return found.select(number("of").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", number("to").alias("refers_to"))


def op10_warc(spark, sf_dir):
    """All pages archived by content, then read back."""
    path = scratch(spark, "archive")
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return parsed(read_records(spark, path))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
