"""WARC archives through a chunked record table (operator 5).

Payloads are streamed into rows of record identifier and chunk number, each of a bounded size
and with the SHA-1 and length of the payload so far.  Each chunk becomes a WARC record or, of
a payload with several, a segment (WARC-Segment-Number); Spark's text writer puts them into
archives, and its reader cuts these at the version line, which no chunk can contain: a payload
is cut within each of the version's names that it holds.  Reading back, payloads of one chunk are digested where they
are; only chunks of oversized ones are brought together, sorted, and digested one after the
other, so no task holds a whole oversized record.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is the
response and others are revisits without payload; smaller ones are all responses.

Defined results: a null html is an empty payload; a null page_id is the smallest and is kept;
rows of one page_id stay separate records (of equal payloads the last record is the response);
an empty table gives empty archives; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a chunk at most.
CHUNK = 256 * 1024
#: Fixed values of the format.
NAME = "WARC/1.1"
VERSION = NAME + "\r\n"
GAP = "\r\n\r\n"

CHUNKS = "record_id string, page_id long, url string, chunk int, last boolean, data string, so_far long, sha1 string"


def cut(payload: str | bytes | memoryview, chunk: int = CHUNK) -> Iterator[memoryview]:
    """Chunks of a payload's UTF-8, one at least, as views of it: no copy of the whole is made.

    Chunks end between code points; none contains the version's name, which a line end may follow."""
    view = memoryview(payload.encode() if isinstance(payload, str) else payload).cast("B")
    at, chunk = 0, max(4, chunk)
    while True:
        end = min(len(view), at + chunk)
        while end < len(view) and view[end] & 0xC0 == 0x80:
            end -= 1
        hit = bytes(view[at:end]).find(NAME.encode())
        if hit >= 0:
            end = at + hit + len(NAME) - 1
        yield view[at:end]
        at = end
        if at >= len(view):
            return


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunk_table(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of (record_id, chunk number) with the digest and length of the payload so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        schema = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.string()), ("so_far", pa.int64()), ("sha1", pa.string())])

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for b in batches:
            rows, size = [], 0
            for page_id, url, html in zip(b.column("page_id"), b.column("url"), b.column("html")):
                digest, so_far, k, held = hashlib.sha1(), 0, 0, None
                for raw in cut(html.as_buffer() or b"", chunk):
                    digest.update(raw)
                    so_far += len(raw)
                    data = str(raw, "utf-8")
                    if held:
                        rows.append(held)
                    held = (f"{part:08d}-{n:010d}", page_id.as_py(), url.as_py(), k, False, data, so_far, base32(digest.digest()))
                    k, size = k + 1, size + len(raw)
                    if size > 8 * chunk and rows:
                        yield made(rows)
                        rows, size = [], len(raw)
                rows.append((*held[:4], True, *held[5:]))
                n += 1
            if rows:
                yield made(rows)

    common.small_batches(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, CHUNKS)


def field(name: str, value: Column | str) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value if isinstance(value, Column) else F.lit(value), F.lit("\r\n")), F.lit(""))


def safe(url: Column) -> Column:
    """Percent-encodes blanks, controls and the version's slash, so that the value stays on one line."""
    for char in ("\r", "\n", "\t", " "):
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return F.replace(url, F.lit(NAME), F.lit("WARC%2F1.1"))


def write(pages: DataFrame, path: str, least: int = 0, chunk: int = CHUNK) -> None:
    """Write the archives of all pages under `path`."""
    table = common.written(chunk_table(pages, chunk), "chunks")
    whole = table.where("last").select("record_id", "page_id", "sha1", F.col("so_far").alias("size"))
    newest = F.max_by(F.struct("record_id", "page_id"), F.struct("page_id", "record_id"))
    groups = whole.where(F.col("size") >= least).groupBy("sha1").agg(newest.alias("to"), F.count("*").alias("n")).where("n > 1")
    kinds = whole.join(groups, "sha1", "left").select(
        "record_id",
        F.col("sha1").alias("digest"),
        "size",
        F.when((F.col("size") >= least) & (F.col("to.record_id") != F.col("record_id")), F.col("to.record_id")).alias("to_record"),
        F.when((F.col("size") >= least) & (F.col("to.record_id") != F.col("record_id")), F.col("to.page_id")).alias("to_page"),
    )
    rows = table.join(kinds, "record_id").where("to_record is null or chunk = 0")
    revisit, parted = F.col("to_record").isNotNull(), (F.col("chunk") > 0) | ~F.col("last")
    body = F.when(revisit, "").otherwise(F.col("data"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), c, F.lit(">"))
    record = F.concat(
        F.lit(VERSION),
        field("WARC-Type", F.when(revisit, "revisit").when(F.col("chunk") > 0, "continuation").otherwise("response")),
        field("WARC-Record-ID", urn(F.concat_ws(":", "record_id", F.when(F.col("chunk") > 0, F.col("chunk"))))),
        field("WARC-Date", "1970-01-01T00:00:00Z"),
        field("WARC-Target-URI", safe(F.col("url"))),
        field("X-Page-ID", F.col("page_id").cast("string")),
        field("X-Payload-Length", F.col("size").cast("string")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        field("WARC-Refers-To", urn(F.col("to_record"))),
        field("X-Refers-To-Page-ID", F.when(revisit, F.coalesce(F.col("to_page").cast("string"), F.lit("")))),
        field("WARC-Segment-Number", F.when(~revisit & parted, (F.col("chunk") + 1).cast("string"))),
        field("WARC-Segment-Origin-ID", F.when(F.col("chunk") > 0, urn(F.col("record_id")))),
        field("WARC-Segment-Total-Length", F.when(~revisit & (F.col("chunk") > 0) & F.col("last"), F.col("size").cast("string"))),
        field("Content-Type", "text/html"),
        field("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
        body,
        F.lit("\r\n"),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def header(name: str) -> Column:
    got = F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)\r", 1)
    return F.when(F.col("head").rlike(rf"(?:^|\n){name}: "), got)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records, or segments of records, of the archives, with their payloads."""
    lines = spark.read.option("lineSep", VERSION).text(path).where("value <> ''")
    parts = lines.select(
        F.expr("substring(value, 1, 1 + instr(value, '\r\n\r\n'))").alias("head"),
        F.expr("substring(value, instr(value, '\r\n\r\n') + 4, length(value) - instr(value, '\r\n\r\n') - 7)").alias("payload"),
    )
    got = parts.select(
        header("WARC-Type").alias("type"),
        F.regexp_extract(F.coalesce(header("WARC-Segment-Origin-ID"), header("WARC-Record-ID")), "^<urn:x-page:(.*)>$", 1).alias("record_id"),
        header("X-Page-ID").cast("long").alias("page_id"),
        header("WARC-Target-URI").alias("url"),
        header("X-Payload-Length").cast("long").alias("size"),
        F.substring_index(header("WARC-Payload-Digest"), ":", -1).alias("digest"),
        F.nullif(header("X-Refers-To-Page-ID"), F.lit("")).cast("long").alias("refers_to"),
        header("WARC-Segment-Number").cast("int").alias("segment"),
        header("Content-Length").cast("long").alias("length"),
        "payload",
    )
    whole = F.when(F.octet_length("payload") == F.col("length"), F.col("payload")).otherwise(F.raise_error(F.lit("a record's length is not as its header says")))
    return got.withColumn("payload", whole)


def base32_of_hex(sha1: Column) -> Column:
    """Upper-case base32 of a hex digest: five bytes make eight digits."""
    groups = [F.lpad(F.conv(F.substring(sha1, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload_digests(records: DataFrame) -> DataFrame:
    """(record_id, page_id, type, payload_bytes, payload_digest, refers_to, header's digest and size), payloads digested."""
    keep = ["record_id", "page_id", "type", "size", "digest", "refers_to"]
    single = records.where("segment is null").select(
        *keep,
        F.octet_length("payload").cast("long").alias("own_size"),
        base32_of_hex(F.sha1(F.col("payload").cast("binary"))).alias("own_digest"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, row = None, None, 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({**{k: [row[k]] for k in ("record_id", "page_id", "size", "digest")}, "own_size": [n], "own_digest": [base32(digest.digest())]})

        for b in batches:
            for row_now in b.to_pylist():
                if row_now["record_id"] != now:
                    if now is not None:
                        yield out()
                    now, digest, n = row_now["record_id"], hashlib.sha1(), 0
                row = row_now
                raw = row_now.pop("payload").encode()
                digest.update(raw)
                n += len(raw)
        if now is not None:
            yield out()

    several = (
        records.where("segment is not null")
        .select("record_id", "page_id", "size", "digest", "segment", "payload")
        .repartition(common.parts(records), "record_id")
        .sortWithinPartitions("record_id", "segment")
        .mapInArrow(run, "record_id string, page_id long, size long, digest string, own_size long, own_digest string")
        .select("record_id", "page_id", F.lit("response").alias("type"), "size", "digest", F.lit(None).cast("long").alias("refers_to"), "own_size", "own_digest")
    )
    return single.unionByName(several)


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all pages written as WARC records and read back."""
    path = common.scratch(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    got = payload_digests(read(spark, path))
    sound = (F.col("own_size") == F.col("size")) & (F.col("own_digest") == F.col("digest"))
    revisit = F.col("type") == "revisit"
    return got.select(
        "page_id",
        F.when(revisit | sound, F.col("size")).otherwise(F.raise_error(F.lit("a payload's digest is not as its header says"))).alias("payload_bytes"),
        F.when(revisit, F.col("digest")).otherwise(F.col("own_digest")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


