"""WARC archives with revisit records: equal payloads are stored once.

Pages are joined by payload digest to the original response of their payload; archives are written by Spark's text writer, one record a row,
whose line separator is the record separator of the format, and read back as whole files of bounded record counts.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import new_path, written

#: Groups larger than rows / HOT_SHARE are looked up by broadcast: there are HOT_SHARE of them at most.
HOT_SHARE = 4096
# Fixed values of the archive format.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a 160-bit digest in hex: 5 hex digits make 4 base32 digits."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type and refers_to of each page.

    Only headers (id, digest, length) are grouped. Payloads are equal when SHA-1, a second hash and the length are. Rows with the smallest page_id of a
    payload are responses, so rows that repeat that id are responses too; with a null page_id a row is a response if no row of its payload has an id.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keys = [F.sha1(F.encode("html", "utf-8")).alias("sha1"), F.xxhash64("html").alias("xx"), F.octet_length("html").cast("long").alias("payload_bytes")]
    heads = p.select("page_id", *keys)
    n_rows = heads.count()
    groups = written(
        heads.where(F.col("payload_bytes") >= min_bytes).groupBy("sha1", "xx", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "payloads"
    )
    key = F.struct("sha1", "xx", "payload_bytes")
    hot = groups.where(F.col("n") > n_rows / HOT_SHARE).select(key.alias("k"), F.struct("first").alias("hot"))
    cold = groups.where(F.col("n") <= n_rows / HOT_SHARE).select(F.concat_ws("/", "sha1", "xx", "payload_bytes").alias("k2"), F.struct("first").alias("cold"))
    d = p.select("*", *keys)
    d = d.withColumn("k", key).join(F.broadcast(hot), "k", "left").drop("k")
    # rows that are resolved already are dealt by themselves, so that no key is hot
    alone = F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.monotonically_increasing_id()).cast("string"))
    d = d.withColumn("k2", F.when(F.col("hot").isNull(), F.concat_ws("/", "sha1", "xx", "payload_bytes")).otherwise(alone))
    d = d.join(cold, "k2", "left").withColumn("found", F.coalesce("hot", "cold"))
    revisit = F.col("found").isNotNull() & F.col("found.first").isNotNull() & ~F.col("found.first").eqNullSafe(F.col("page_id"))
    return d.select(
        "page_id",
        "url",
        "html",
        "payload_bytes",
        base32(F.col("sha1")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("found.first")).alias("refers_to"),
    )


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """One WARC/1.1 record a row, without the separator that ends it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.col("payload_bytes").cast("string")), F.lit("\r\n"))
    first = F.col("record_type") == "response"
    block = F.when(first, F.concat(http, F.col("html"))).otherwise(http)
    when = F.date_format(F.current_timestamp() if date is None else date, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", when),
        line("WARC-Target-URI", F.regexp_replace(text(F.col("url")), r"[\x00-\x20\x7F]", "%20")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("X-Page-Id", text(F.col("page_id"))),
        F.when(first, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("refers_to"))), line("X-Refers-To-Page-Id", text(F.col("refers_to"))))),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return pages.withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_file: int = 4000) -> None:
    """Writes resolved pages as gzipped archives; equal inputs give equal records in some order."""
    records(pages).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def _parsed(stream):
    """Headers and block of each record of an archive."""
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            headers[name] = value
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut short")
        yield headers, block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to from the archives; digests of responses are checked."""
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    number = lambda x: int(x) if x else None

    def rows(content: bytes):
        for h, block in _parsed(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)))):
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(head.rpartition(b"Content-Length: ")[2])
            digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
            if h["WARC-Type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError("a payload differs from its digest")
            yield number(h["X-Page-Id"]), size, digest, h["WARC-Type"], number(h.get("X-Refers-To-Page-Id"))

    def run(batches):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        for b in batches:
            for content in b.column("content").to_pylist():
                got = list(zip(*rows(content), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_pydict({n: pa.array(x, k) for n, x, k in zip(names, got, kinds, strict=True)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def deduplicated(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Writes deduplicated archives and reads them back: one row per page."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write_archives(resolved(pages, min_bytes), path)
    return read_archives(spark, path)
