"""A content-addressed WARC archive: payloads once, record headers exactly, records by joins."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.storage import Scratch, tasks

#: Base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "2024-01-01T00:00:00Z"


def base32(digits_of: str) -> Column:
    """Bare upper-case base32 of a column of 40 hex digits: four characters from every five of them."""
    digits = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(digits_of, at, 5), 16, 10).cast("int")
        digits += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def _lines(*lines: Column) -> Column:
    return F.concat(*(F.concat(x, F.lit("\r\n")) for x in lines), F.lit("\r\n"))


def _one_line(value: Column) -> Column:
    """A header value may not hold line ends: they are written as in URLs."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _name(path: str) -> str:
    return f"weftline_{hashlib.md5(path.encode()).hexdigest()}"


def _write_bucketed(df: DataFrame, path: str) -> None:
    """Parquet below path, bucketed by digest, so that a later join on it moves nothing."""
    df.write.mode("overwrite").format("parquet").bucketBy(tasks(df.sparkSession), "sha256").sortBy("sha256").option("path", path).saveAsTable(_name(path))


def _read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table as bucketed if this session knows it; else its plain files, which a join shuffles."""
    return spark.table(_name(path)) if spark.catalog.tableExists(_name(path)) else spark.read.parquet(path)


def write_archive(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes ``payloads`` (sha256, payload) and exact WARC header blocks, one a record, below path.

    Of records with equal payloads of at least ``least`` bytes the one with the
    largest page_id is the response, the others are revisits of it; shorter
    payloads are responses all. Rows that share the largest page_id are told
    apart by their place, so one of them is the response. A null html is an
    empty payload, a null page_id is smaller than any other; a url may be null,
    and line ends in it are written as %0D and %0A.

    Payload bytes are stored once for each SHA-256 (equal digests are checked to
    mean equal length and SHA-1), and are shuffled once, after each task has
    dropped its own copies. ``headers`` holds the first response of each digest;
    it and ``payloads`` are bucketed by digest alike. ``more_headers`` holds all
    other records, which need no bytes or few, so no bucket grows with a group of copies.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    body = F.coalesce(F.encode("html", "utf-8"), F.lit(b""))
    rows = pages.select("page_id", "url", body.alias("payload"))
    digests = rows.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("hex"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("place"))
    index = scratch.write(digests.select("page_id", "url", "sha256", base32("hex").alias("sha1"), "payload_bytes", "place"), "index")
    rank = F.struct(F.col("page_id").isNotNull().alias("known"), F.coalesce("page_id", F.lit(0)).alias("page_id"), "place")
    # Groups of copies shrink before the shuffle: a row for each digest and task.
    keep = index.groupBy("sha256").agg(F.max(rank).alias("top"), F.countDistinct("sha1", "payload_bytes").alias("forms"))
    keep = keep.select("sha256", F.col("top.place").alias("top_place"), F.when(F.col("top.known"), F.col("top.page_id")).alias("top_page"), F.when(F.col("forms") == 1, True).otherwise(F.raise_error(F.lit("two payloads share a digest")).cast("boolean")).alias("verified"))
    joined = index.join(keep, "sha256").where("verified")
    revisit = (F.col("payload_bytes") >= least) & (F.col("place") != F.col("top_place"))
    uri = _one_line(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))))
    record_id = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(":"), F.col("place").cast("string"), F.lit(">"))
    refers = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("top_page").cast("string"), F.lit("none")), F.lit(":"), F.col("top_place").cast("string"), F.lit(">"))
    common = [F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {EPOCH}"), F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1"))]
    response = _lines(F.lit("WARC/1.1"), F.lit("WARC-Type: response"), *common, F.concat(F.lit("Content-Length: "), F.col("payload_bytes").cast("string")))
    again = _lines(F.lit("WARC/1.1"), F.lit("WARC-Type: revisit"), *common, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), F.concat(F.lit("WARC-Refers-To: "), refers), F.concat(F.lit("WARC-Truncated: length")), F.lit("Content-Length: 0"))
    headers = joined.select("page_id", "place", "sha256", F.when(revisit, again).otherwise(response).cast("binary").alias("header"), (~revisit).alias("has_block"), (F.col("place") == F.col("top_place")).alias("top"))
    headers = scratch.write(headers, "headers")
    _write_bucketed(headers.where("top").drop("top", "has_block"), f"{path}/headers")
    headers.where("not top").drop("top").write.mode("overwrite").parquet(f"{path}/more_headers")
    _write_bucketed(rows.groupBy(F.sha2("payload", 256).alias("sha256")).agg(F.first("payload").alias("payload")), f"{path}/payloads")
    scratch.drop("index")
    scratch.drop("headers")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, place, sha256, head_bytes, record): every record's exact bytes, rebuilt by a join on the digest, and the length of its header.

    What it returns goes on reading the tables as bucketed, but they are taken off the session's catalogue; a later call reads their plain files.
    """
    first, payloads = (_read_bucketed(spark, f"{path}/{name}") for name in ("headers", "payloads"))
    forget_buckets(spark, path)
    more = spark.read.parquet(f"{path}/more_headers")
    record = lambda *block: F.concat("header", *block, F.lit(b"\r\n\r\n")).alias("record")
    names = ["page_id", "place", "sha256", F.octet_length("header").alias("head_bytes")]
    out = first.join(payloads, "sha256").select(*names, record("payload"))
    out = out.unionByName(more.where("not has_block").select(*names, record()))
    return out.unionByName(more.where("has_block").join(payloads, "sha256").select(*names, record("payload")))


def parse_records(records: DataFrame) -> DataFrame:
    """Fields of records from their bytes alone; ``payload_bytes`` and ``payload_digest`` are null for revisits, which have no bytes.

    ``head_bytes`` must be where the first blank line ends. A record whose block
    has another length or another digest than its header states stops the job.
    """
    split = records.select(
        "page_id", "place", "sha256", "head_bytes", F.substring("record", F.lit(1), F.col("head_bytes")).alias("raw"),
        F.expr("octet_length(record) - head_bytes - 4").cast("long").alias("found"), F.sha1(F.expr("substring(record, head_bytes + 1, octet_length(record) - head_bytes - 4)")).alias("hex"),
        (F.substring("record", F.octet_length("record") - 3, F.lit(4)) == F.lit(b"\r\n\r\n")).alias("ended"),
    )
    blank = F.instr(F.decode("raw", "ISO-8859-1"), "\r\n\r\n")  # a character a byte
    split = split.select("page_id", "place", "sha256", "found", F.decode("raw", "UTF-8").alias("head"), base32("hex").alias("digest"), (F.col("ended") & (blank == F.col("head_bytes") - 3)).alias("framed"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    out = split.select(
        "page_id", "place", "sha256", "found", "digest", "framed", field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("uri"), F.regexp_extract("head", r"(?m)^WARC-Payload-Digest: sha1:([A-Z2-7]{32})", 1).alias("stated"),
        F.expr("try_cast(nullif(regexp_extract(head, '(?m)^WARC-Refers-To: <urn:page:(-?[0-9]+):', 1), '') as bigint)").alias("refers_to"), field("Content-Length").cast("long").alias("block_bytes"),
    )
    carried = F.col("record_type") == "response"
    sound = F.col("framed") & (F.col("block_bytes") == F.col("found")) & (~carried | (F.col("stated") == F.col("digest")))
    out = out.where(F.when(sound, True).otherwise(F.raise_error(F.lit("a record does not match its header")).cast("boolean")))
    return out.select("page_id", "place", "sha256", "record_type", "uri", "stated", "refers_to", F.when(carried, F.col("found")).alias("payload_bytes"), F.when(carried, F.col("digest")).alias("payload_digest"))


def resolved(parsed: DataFrame) -> DataFrame:
    """parsed with size and digest of revisits taken from the response that was read for their payload."""
    of = parsed.where("record_type = 'response'").groupBy("sha256").agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("of"))
    same = F.when(F.col("stated") == F.col("of.payload_digest"), True).otherwise(F.raise_error(F.lit("a revisit does not match its response")).cast("boolean"))
    both = parsed.join(of, "sha256").where(same)
    return both.select("page_id", F.col("of.payload_bytes").alias("payload_bytes"), F.col("of.payload_digest").alias("payload_digest"), "record_type", "refers_to", "uri")


def forget_buckets(spark: SparkSession, path: str) -> None:
    """Takes the archive's bucketed tables off the session's catalogue; their files stay."""
    for name in ("headers", "payloads"):
        spark.sql(f"DROP TABLE IF EXISTS {_name(f'{path}/{name}')}")


def archived_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to an archive in the shared folder, reads it back and reports each record."""
    scratch = Scratch(pages.sparkSession, "archive")
    write_archive(pages, scratch.root, least)
    parsed = scratch.write(parse_records(read_records(pages.sparkSession, scratch.root)), "parsed")
    return resolved(parsed)


#: The same rows in DuckDB.
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
m AS (SELECT html, max(page_id) AS top FROM d GROUP BY html)
SELECT page_id, payload_bytes,
  array_to_string([substr('{BASE32}', (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to,
  coalesce(url, 'urn:page:' || page_id) AS uri
FROM d JOIN m USING (html)
"""
