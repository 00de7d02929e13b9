"""Archives without repeated payloads: revisit records for equal payloads, written and read as WARC 1.1.

Headers (id, length, digests) are grouped by payload digest; each repeated payload has one original, and the pages are
joined with it. The archives are written by Spark's text sink: a record is one string and the line separator is the
blank lines that end a record, so any file system Spark knows will do and tasks may be repeated.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusaudit.llm.common import col, field
from corpusaudit.session import ship_with_tasks

ship_with_tasks(__name__)

#: Fixed values of the format.
VERSION = "WARC/1.1"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: Payloads shorter than this are never replaced by a reference.
MIN_BYTES = 1000


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def resolve_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with their payload's bytes, digest, record_type and original (the page a revisit refers to).

    Input: page_id, url, html. Payloads are equal when length, SHA-1 and SHA-256 are; a null payload is empty. Of equal
    payloads of at least ``min_bytes`` the largest page_id is the response; rows that repeat that id are responses too,
    rows without an id never are unless no row has one. Extra columns are not read; very long payloads are
    hashed and kept whole, as one string; an empty table gives no records.
    """
    payload = F.coalesce(col("html"), F.lit(""))
    rows = pages.select(col("page_id").alias("page_id"), col("url").alias("url"), payload.alias("payload")).withColumns(
        {"bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha1("payload"), "strong": F.sha2("payload", 256)}
    )
    repeated = (
        rows.filter(F.col("bytes") >= min_bytes)
        .groupBy("digest", "strong", "bytes")
        .agg(F.count("*").alias("_n"), F.max(F.struct("page_id", "url")).alias("original"))
        .filter((F.col("_n") > 1) & F.col("original.page_id").isNotNull())
        .drop("_n")
    )
    again = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original.page_id"))
    return rows.join(repeated, ["digest", "strong", "bytes"], "left").withColumn("revisit", again)


def records(pages: DataFrame, date: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """One complete record per page (column ``record``, without the blank lines that end it)."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    found = resolve_revisits(pages, min_bytes)

    def uri(url: Column, page: Column) -> Column:
        plain = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "%20")
        return F.when(plain != "", plain).otherwise(F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none"))))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(name + ": "), value, F.lit("\r\n"))

    original = F.col("original")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END)
    )
    refers = F.when(
        F.col("revisit"),
        F.concat(
            line("WARC-Profile", F.lit(IDENTICAL)),
            line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), _record_id(original["page_id"], original["url"], F.col("digest")), F.lit(">"))),
            line("WARC-Refers-To-Target-URI", uri(original["url"], original["page_id"])),
            line("WARC-Refers-To-Date", F.lit(date)),
        ),
    ).otherwise("")
    size = F.octet_length("_http") + F.when(F.col("revisit"), 0).otherwise(F.col("bytes"))
    own = F.when(F.col("page_id").isNotNull(), line("WARC-Page-ID", F.col("page_id").cast("string"))).otherwise("")
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _record_id(F.col("page_id"), F.col("url"), F.col("digest")), F.lit(">"))),
        line("WARC-Target-URI", uri(F.col("url"), F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        own,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        refers,
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", size.cast("string")),
        F.lit("\r\n"),
    )
    body = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    return found.withColumn("_http", http).select(F.concat(head, F.col("_http"), body).alias("record"))


def write_archives(pages: DataFrame, path: str, date: str | None = None, min_bytes: int = MIN_BYTES, per_file: int = 5_000) -> None:
    """Compressed archives of at most ``per_file`` records each below ``path``."""
    writer = records(pages, date, min_bytes).write.option("lineSep", END).option("compression", "gzip")
    writer.option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of one archive. Blocks are cut by Content-Length, so payloads may contain anything."""
    while version := stream.readline():
        if version.strip() != VERSION.encode():
            raise ValueError(f"no record at {version[:40]!r}")
        head: dict[str, str] = {}
        while (text := stream.readline()) != b"\r\n":
            if not text:
                raise ValueError("archive ends within a header")
            name, _, value = text.decode().rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        block = stream.read(int(head["content-length"]))
        if stream.read(len(END)) != END.encode():
            raise ValueError("a record does not end where its length says")
        top, _, payload = block.partition(END.encode())
        full = next(int(x.split(b":")[1]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response" and (len(payload) != full or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"payload of {head['warc-record-id']} is damaged")
        yield {
            "record_id": head["warc-record-id"],
            "record_type": head["warc-type"],
            "uri": head["warc-target-uri"],
            "page_id": int(head["warc-page-id"]) if "warc-page-id" in head else None,
            "payload_bytes": full,
            "payload_digest": digest,
            "refers_to_id": head.get("warc-refers-to"),
            "payload": payload.decode() if head["warc-type"] == "response" else None,
        }


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records below ``path``; responses are checked against length and digest."""
    kinds = {"page_id": "bigint", "payload_bytes": "bigint"}
    names = ["record_id", "record_type", "uri", "page_id", "payload_bytes", "payload_digest", "refers_to_id"] + ["payload"] * payloads
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    arrow = pa.schema([(n, pa.int64() if n in kinds else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                chunk, size = [], 0
                for record in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                    chunk.append(record if payloads else {n: record[n] for n in names})
                    size += record["payload_bytes"] if payloads else 200
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_pylist(chunk, arrow)
                        chunk, size = [], 0
                if chunk:
                    yield pa.RecordBatch.from_pylist(chunk, arrow)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, schema)


def with_referred_page(read: DataFrame) -> DataFrame:
    """Revisit records joined with the responses they refer to: adds refers_to, the response's page_id."""
    targets = read.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.max("page_id").alias("refers_to"))
    return read.join(targets, "refers_to_id", "left")


