"""A content-addressed WARC archive, with DataFrame functions only.

Two tables hold the archive. `payloads` has each distinct payload once, under its SHA-256 digest, which is
computed again on reading and must agree. `headers` has every record's exact header bytes, in order of nothing, with
its payload's digest. Joining them on the digest gives the original records: header, blank line, payload, blank line.
Files of payloads are buckets of the digest, so payloads are dealt once, on writing, and only headers move on reading.
Records are WARC/1.1: a response, and revisits that refer to it.

Of the records with equal payloads the one with the largest id is the response, the others revisit it. Equal rows
(same id, same payload) are the same record written twice, and have the same type. A null payload is the empty one.
A null id is smaller than any other; if there is no other, all are responses. Payloads below `least_bytes` are
always responses, each referring to the stored copy by digest only. An empty table gives an empty archive. Other columns of the input do not matter.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hot_keys, salted_join, shared_dir, text_column

#: The base32 alphabet of RFC 4648.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a digest of 40 hex digits: each 5 of them are 4 characters."""
    alphabet = F.lit(BASE32)
    parts = []
    for i in range(8):
        number = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substr(alphabet, F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


@dataclass(frozen=True)
class Archive:
    """Where the two tables are, and in how many buckets of the digest the files of payloads are (none: not known)."""

    path: str
    buckets: int | None = None

    def payloads(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("sha256 string, payload binary").parquet(f"{self.path}/payloads")

    def dealt_payloads(self, spark: SparkSession) -> DataFrame:
        """The payloads such that a join on the digest leaves them where they are. Spark knows buckets only of tables in its
        catalogue; the entry goes as soon as the frame has the files."""
        if not self.buckets:
            return self.payloads(spark)
        name, place = _table_name(), f"{self.path}/payloads".replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} (sha256 STRING, payload BINARY) USING parquet CLUSTERED BY (sha256) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")

    def headers(self, spark: SparkSession) -> DataFrame:
        schema = T.StructType().add("page_id", "long").add("url", "string").add("sha256", "string").add("header", "binary")
        return spark.read.schema(schema).parquet(f"{self.path}/headers")


def _table_name() -> str:
    return f"spark_catalog.default.trellis_warc_{uuid.uuid4().hex}"


def _header(record_type: Column, page_id: Column, refers: Column, url: Column, digest: Column, n_bytes: Column) -> Column:
    """The exact header bytes of a record; lines end in CR LF, and line breaks in a URL are escaped."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    target = F.replace(F.replace(F.coalesce(url, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    ident = lambda x: F.concat(F.lit("<urn:page:"), F.coalesce(x.cast("string"), F.lit("none")), F.lit(">"))
    revisit = record_type == "revisit"
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", ident(page_id)),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.when(revisit, F.concat(line("WARC-Refers-To", ident(refers)), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(n_bytes.cast("string"))),
    ).cast("binary")


def write_archive(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> Archive:
    """Writes the archive of a table of pages to `path`."""
    payload = text_column(pages, payload_col).cast("binary")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("_sha1"), F.octet_length(payload).cast("long").alias("_bytes"))
    first = rows.groupBy("sha256").agg(F.max("page_id").alias("_first"))
    records = rows.join(first, "sha256")
    revisit = (F.col("_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("_first"))
    kind = F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    header = _header(kind, F.col("page_id"), F.col("_first"), F.col("url"), base32(F.col("_sha1")), F.col("_bytes"))
    records.select("page_id", "url", "sha256", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # of equal payloads any is as good; each task sends one of them at most, so a payload with many copies is no hot key
    bodies = pages.select(payload.alias("payload")).select(F.sha2("payload", 256).alias("sha256"), "payload")
    bodies = bodies.groupBy("sha256").agg(F.first("payload").alias("payload"))
    spark, name = pages.sparkSession, _table_name()
    buckets = min(int(spark.conf.get("spark.sql.shuffle.partitions")), int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets")))
    bodies.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "sha256").option("path", f"{path}/payloads").saveAsTable(name)
    spark.sql(f"DROP TABLE {name}")
    return Archive(path, buckets)


def verified_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """The stored payloads; a digest that does not agree fails the query."""
    return _verified(archive.payloads(spark))


def _verified(found: DataFrame) -> DataFrame:
    wrong = F.concat(F.lit("payload does not match its digest "), F.col("sha256"))
    sound = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(F.raise_error(wrong).cast("binary"))
    return found.select("sha256", sound.alias("payload"))


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def _parsed(headers: DataFrame) -> DataFrame:
    text = F.decode("header", "UTF-8")
    ident = lambda name: F.regexp_extract(F.coalesce(_field(text, name), F.lit("")), r"^<urn:page:(-?\d+)>$", 1)
    number = lambda x: F.when(x != "", x.cast("long"))
    return headers.select(
        number(ident("WARC-Record-ID")).alias("page_id"),
        _field(text, "WARC-Target-URI").alias("url"),
        "sha256",
        "header",
        F.regexp_extract(F.coalesce(_field(text, "WARC-Payload-Digest"), F.lit("")), "^sha1:(.*)$", 1).alias("payload_digest"),
        _field(text, "WARC-Type").alias("record_type"),
        number(ident("WARC-Refers-To")).alias("refers_to"),
    )


def _with_payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every header, parsed, with its payload. Headers go to the payload's bucket; those of a payload with many records are
    parted, and for them that payload is repeated."""
    rows, stored = _parsed(archive.headers(spark)), _verified(archive.dealt_payloads(spark))
    counts = rows.groupBy("sha256").agg(F.count("*").alias("n"))
    n_rows = rows.count()
    hot, _ = hot_keys(counts, "sha256", n_rows)
    if hot.isEmpty():
        return rows.join(stored, "sha256", "left")
    hot = F.broadcast(hot.select("sha256"))
    many = salted_join(rows.join(hot, "sha256", "left_semi"), verified_payloads(spark, archive).join(hot, "sha256", "left_semi"), "sha256", "header", counts, n_rows, "left")
    return rows.join(hot, "sha256", "left_anti").join(stored, "sha256", "left").unionByName(many)


def read_records(spark: SparkSession, archive: Archive) -> DataFrame:
    """Every record with its parsed header, its whole payload and its exact bytes. A payload that is not there fails the query."""
    missing = F.concat(F.lit("no payload with digest "), F.col("sha256"))
    out = _with_payloads(spark, archive).withColumn("payload", F.coalesce("payload", F.raise_error(missing).cast("binary")))
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    end = F.lit("\r\n").cast("binary")
    return out.withColumn("record", F.concat("header", end, body, end, end))


def read_summaries(spark: SparkSession, archive: Archive) -> DataFrame:
    """As read_records, with the length and SHA-1 of the stored payload in place of the bytes: digests are taken once
    for each payload, before the join, so payloads don't travel. A header that names another digest fails the query."""
    stored = verified_payloads(spark, archive).select("sha256", F.octet_length("payload").cast("long").alias("payload_bytes"), base32(F.sha1("payload")).alias("_digest"))
    out = _parsed(archive.headers(spark)).drop("header").join(stored, "sha256")
    wrong = F.concat(F.lit("header and payload differ in digest at page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    digest = F.when(F.col("_digest") == F.col("payload_digest"), F.col("_digest")).otherwise(F.raise_error(wrong).cast("string"))
    return out.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def read_checked(spark: SparkSession, archive: Archive) -> DataFrame:
    """The columns of read_summaries from every record's rebuilt bytes: of a response the body, cut out of the record by
    its Content-Length, and of a revisit the payload that it refers to. Bytes that don't agree with the header fail the query."""
    rows = read_records(spark, archive)
    length = F.regexp_extract(F.decode("header", "UTF-8"), r"\r\nContent-Length: (\d+)\r\n", 1).cast("int")
    start = F.octet_length("header") + 2
    body = F.substring("record", start + 1, length)
    whole = F.octet_length("record") == start + length + 4
    payload = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(body)
    rows = rows.select("page_id", "url", "payload_digest", "record_type", "refers_to", F.octet_length(payload).cast("long").alias("payload_bytes"), base32(F.sha1(payload)).alias("_digest"), whole.alias("_whole"))
    wrong = F.concat(F.lit("record and header differ at page "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")))
    digest = F.when((F.col("_digest") == F.col("payload_digest")) & F.col("_whole"), F.col("_digest")).otherwise(F.raise_error(wrong).cast("string"))
    return rows.select("page_id", "url", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/trellis/warc-{uuid.uuid4().hex}"
