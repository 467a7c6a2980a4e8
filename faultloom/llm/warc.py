"""WARC archives whose repeated payloads are revisit records.

Records are written by Spark's text writer: a record is a line, the line end is the two line ends
that close a WARC record, and the files are gzip. Record lengths are read from Content-Length, never
guessed from the text, so payloads may hold anything.

Revisit resolution: payload digests and lengths of all records meet by digest, where the smallest
page id of each is the response (combined before the shuffle, so a payload of a third of all pages
is one row per task); its revisits then join it to learn whom and what they refer to. Only digests
with several records take part in that join. Payloads of revisits are not written again; all
headers are new.

Defined cases: a null html is an empty payload, a null url an empty target. Payloads below the
smallest size are all responses. Rows with equal page ids and equal payloads are one response each
(none revisits itself). Rows with a null page id are responses, written without an id, and never
referred to. Other columns are ignored. An empty table makes archives without records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir
from .steps import settle, small_batches

#: records in a file at most; a file is read as one value
RECORDS_PER_FILE = 2048
SMALLEST = 0
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = (
    "page_id long, url string, kind string, payload_bytes long, payload_digest string, refers_to long, payload string"
)


def _uuid(text: Column) -> Column:
    h = F.md5(text)
    return F.concat_ws("-", *(F.substr(h, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def _line(name: str, value: Column) -> Column:
    """A header line, nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))


def _one_line(value: Column) -> Column:
    return F.regexp_replace(value, r"[\r\n]+", " ")


def record(kind: Column, page_id: Column, url: Column, digest: Column | None, size: Column, refers_to: Column, refers_url: Column, body: Column) -> Column:
    """A WARC/1.1 record without the line ends that close it."""
    named = F.coalesce(page_id.cast("string"), F.lit(""))
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), _uuid(F.concat_ws("|", kind, named, url)), F.lit(">"))),
        _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Target-URI", _one_line(url)),
        _line("X-Page-ID", page_id),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)) if digest is not None else F.lit(""),
        _line("X-Payload-Length", size),
        _line("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        _line("WARC-Refers-To-Target-URI", _one_line(refers_url)),
        _line("X-Refers-To-Page-ID", refers_to),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.octet_length(body)),
        F.lit(CRLF),
        body,
    )


def write_archive(records: DataFrame, path: str) -> None:
    """One column of records to gzip files of at most RECORDS_PER_FILE records."""
    (
        records.write.option("lineSep", CRLF * 2)
        .option("compression", "gzip")
        .option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", RECORDS_PER_FILE)
        .text(path)
    )


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = end + 4
        at = body + int(headers["Content-Length"])
        yield headers, data[body:at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {body} is not closed")
        at += 4


def _reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        names = [f.split()[0] for f in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for content in batch.column(0):
                data = zlib.decompress(content.as_py(), 31)
                rows = []
                for h, body in parse(data):
                    kind = h["WARC-Type"]
                    if kind == "response":
                        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if h.get("WARC-Payload-Digest", f"sha1:{digest}") != f"sha1:{digest}":
                            raise ValueError(f"digest of page {h.get('X-Page-ID')} differs")
                        size = len(body)
                    else:
                        digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    page, ref = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    rows.append((
                        page and int(page), h.get("WARC-Target-URI"), kind, size, digest, ref and int(ref),
                        body.decode() if with_payload else None,
                    ))
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return read


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of an archive; digests of payloads are computed and held against their headers."""
    small_batches(spark, 1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).where("length > 0").select("content")
    return files.mapInArrow(_reader(with_payload), RECORD)


def resolve(headers: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """digest, response (its smallest page id), url of that page: digests that several pages share."""
    shared = headers.where(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= smallest))
    return (
        shared.groupBy("payload_digest", "payload_bytes")
        .agg(F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("k"))
        .where("k > 1")
        .select("payload_digest", "payload_bytes", F.col("first.page_id").alias("response"), F.col("first.url").alias("response_url"))
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """A response record for every page."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    one = record(F.lit("response"), F.col("page_id"), url, None, none, none, none, html)
    write_archive(pages.select(one.alias("value")), path)


def write_deduplicated(spark: SparkSession, source: str, path: str, smallest: int = SMALLEST) -> None:
    """The archive at source again, repeated payloads as revisits of the response with the smallest id."""
    shared = settle(resolve(read_archive(spark, source), smallest), "revisits")
    rows = read_archive(spark, source, True).join(shared, ["payload_digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("page_id") != F.col("response"), F.lit(False))
    known = lambda c: F.when(revisit, c)
    one = record(
        F.when(revisit, "revisit").otherwise("response"), F.col("page_id"), F.coalesce("url", F.lit("")), F.col("payload_digest"),
        F.col("payload_bytes"), known(F.col("response")), known(F.col("response_url")),
        F.when(revisit, "").otherwise(F.col("payload")),
    )
    write_archive(rows.select(one.alias("value")), path)


def report(pages: DataFrame) -> DataFrame:
    """op1: archives of all pages written, resolved, written again and read back."""
    spark = pages.sparkSession
    raw, done = work_dir(spark, "warc"), work_dir(spark, "warc")
    write_pages(pages, raw)
    write_deduplicated(spark, raw, done)
    return read_archive(spark, done).select(
        "page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to"
    )
