"""Incremental chunk refresh: documents change, their chunks follow.

The chunk log is append-only. Each batch writes its chunks and the list of documents it touched to
partitions of its own, with their versions; the current chunks of a document are those of the
newest version that came, of equal versions the last. Nothing is rewritten in place, a replay overwrites its own partition, and readers never see a
document without its chunks, because the list is written after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunks import chunk_table
from .ingest import MARK, _start, _write_batch

# how often to look for changed documents while the query runs
REFRESH_INTERVAL = "10 minutes"


def newest(documents: DataFrame, version: str = "updated_timestamp") -> DataFrame:
    """One row per document: the one with the highest version."""
    rest = [c for c in documents.columns if c != "document_id"]
    top = F.max_by(F.struct(*rest), F.col(version)).alias("_top")
    return documents.groupBy("document_id").agg(top).select(
        "document_id", *[F.col(f"_top.{c}").alias(c) for c in rest]
    )


def stream_chunks(
    spark: SparkSession,
    source: str,
    root: str,
    checkpoint: str,
    interval: str | None = REFRESH_INTERVAL,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Follow a folder of parquet document versions (document_id, file_path, content,
    updated_timestamp) and keep the chunk log below root up to date.

    Of a batch each document's newest version counts; a late old version is logged and never
    becomes current. interval=None processes what is there and stops.
    """
    schema = "document_id string, file_path string, content string, updated_timestamp timestamp_ntz"
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        latest = newest(batch)
        _write_batch(chunk_table(latest), f"{root}/chunks", batch_id)
        touched = batch.groupBy("document_id").agg(F.max("updated_timestamp").alias("version"))
        _write_batch(touched, f"{root}/touched", batch_id)

    return _start(stream, write, checkpoint, interval)


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Chunks of every document's newest version among the finished batches."""
    last = _last(spark, root).select("document_id", MARK)
    return spark.read.parquet(f"{root}/chunks").join(last, ["document_id", MARK], "left_semi").drop(MARK)


def _last(spark: SparkSession, root: str) -> DataFrame:
    """document_id, version, batch of the newest version; a null version is older than any other."""
    touched = spark.read.parquet(f"{root}/touched")
    newest_ = F.max(F.struct(F.col("version"), F.col(MARK))).alias("m")
    return touched.groupBy("document_id").agg(newest_).select("document_id", "m.version", F.col(f"m.{MARK}").alias(MARK))


def compact(spark: SparkSession, root: str, new_root: str) -> None:
    """Write the current chunks to a new root as batch -1; later batches can be appended there."""
    chunks = current_chunks(spark, root)
    _write_batch(chunks, f"{new_root}/chunks", -1)
    _write_batch(_last(spark, root).drop(MARK), f"{new_root}/touched", -1)
