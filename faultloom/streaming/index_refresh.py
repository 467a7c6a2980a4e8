"""A text index that follows its documents: every new version emits the postings it adds and removes.

The state of a document is its newest version: its time and its text. A version that is not newer emits nothing,
whenever it comes. The log holds signed rows, so the index is the sum of the log, and tokens that stay where
they are cost nothing. A version without a time is never current. State stays: without it a late old version
could not be told from a new one.

Documents come to Python in groups by a hash of their id, since a group costs milliseconds whatever is in it.
A group's state is that of its documents, and is written anew when one of them changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .ingest import MARK, _start, _write_batch

LOG = "document_id string, version timestamp, token string, places array<int>, sign int"
_STATE = "document_ids array<string>, versions array<long>, contents array<string>"
_CHANGED = "document_id string, version timestamp, before string, after string"
# rows of the log that are handed over at once
ROWS = 1 << 16
# groups that documents come in; a checkpoint keeps the number it began with
GROUPS = 1 << 15
# where a stream keeps its state unless the session says so: on disk, with this much memory for all of it
_STORE = "spark.sql.streaming.stateStore."
STORE = {
    f"{_STORE}providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}rocksdb.changelogCheckpointing.enabled": "true",
    f"{_STORE}rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}rocksdb.maxMemoryUsageMB": "300",
}


def _postings(text: str | None) -> dict[str, list[int]]:
    """token -> its places."""
    out: dict[str, list[int]] = {}
    for i, token in enumerate((text or "").upper().split(" ")):
        out.setdefault(token, []).append(i)
    return out if text is not None else {}


def _rank(at, content) -> tuple | None:
    """What versions of a document are compared by; None for one without a time."""
    if pd.isna(at):
        return None
    text = content if isinstance(content, str) else None
    return at, text is None, text or ""


def _moved(newest: tuple, before: tuple) -> tuple[tuple, bool] | None:
    """The state (version, text) that the newest of the versions that came leaves, if it is newer than the one
    before, and whether the text changes."""
    at, empty, content = newest
    version, content = int(at.value // 1000), None if empty else content
    if before[0] is not None and version <= before[0]:
        return None
    return (version, content), content != before[1]


def _changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One document: the text before and after the newest of the versions that came, if it changes."""
    ranks = [r for f in frames for r in map(_rank, f["updated_timestamp"], f["content"]) if r is not None]
    before = state.get if state.exists else (None, None)
    moved = _moved(max(ranks), before) if ranks else None
    if moved:
        state.update(moved[0])
        if moved[1]:
            yield pd.DataFrame({"document_id": [key[0]], "version": [max(ranks)[0]], "before": [before[1]], "after": [moved[0][1]]})


def _group_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """_changes of all documents of a group, in one frame."""
    newest: dict[str, tuple] = {}
    for f in frames:
        for document, at, content in zip(f["document_id"], f["updated_timestamp"], f["content"]):
            rank = _rank(at, content)
            if rank is not None:
                newest[document] = max(newest.get(document, rank), rank)
    known = {d: (v, c) for d, v, c in zip(*state.get)} if state.exists else {}
    rows, stays = [], True
    for document, rank in newest.items():
        before = known.get(document, (None, None))
        moved = _moved(rank, before)
        if moved:
            known[document], stays = moved[0], False
            if moved[1]:
                rows.append((document, rank[0], before[1], moved[0][1]))
    if not stays:
        state.update(([*known], [v for v, _ in known.values()], [c for _, c in known.values()]))
    if rows:
        yield pd.DataFrame(rows, columns=["document_id", "version", "before", "after"])


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signed postings of changed texts, those of many documents in a batch."""
    for batch in batches:
        sides = list(zip(batch.column("before").to_pylist(), batch.column("after").to_pylist()))
        of, tokens, places, ends, signs = [], [], [], [0], []
        for i, (before, after) in enumerate(sides):
            old, new = _postings(before), _postings(after)
            for sign, own, other in ((-1, old, new), (1, new, old)):
                for token, at in own.items():
                    if other.get(token) != at:
                        of.append(i)
                        tokens.append(token)
                        places += at
                        ends.append(len(places))
                        signs.append(sign)
            if len(of) >= ROWS or (of and i == len(sides) - 1):
                whole = [batch.column(c).take(pa.array(of, pa.int32())) for c in ("document_id", "version")]
                listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(places, pa.int32()))
                columns = [*whole, pa.array(tokens, pa.string()), listed, pa.array(signs, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["document_id", "version", "token", "places", "sign"])
                of, tokens, places, ends, signs = [], [], [], [0], []


def stream_index(
    spark: SparkSession, source: str, root: str, checkpoint: str, interval: str | None = None, files_per_batch: int = 1000
) -> StreamingQuery:
    """Follow a folder of parquet document versions (document_id, content, updated_timestamp) and append the
    changes of the index to a log below root. A replayed batch overwrites its own partition."""
    schema = "document_id string, content string, updated_timestamp timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    changes = (
        stream.filter(F.col("document_id").isNotNull())
        .withColumn("_group", F.pmod(F.xxhash64("document_id"), F.lit(GROUPS)).cast("int")).groupBy("_group")
        .applyInPandasWithState(_group_changes, _CHANGED, _STATE, "append", GroupStateTimeout.NoTimeout)
        .mapInArrow(_unfolded, LOG)
    )
    write = lambda batch, batch_id: _write_batch(batch, f"{root}/postings", batch_id)
    ours = {k: v for k, v in STORE.items() if spark.conf.get(k, None) is None}
    for k, v in ours.items():
        spark.conf.set(k, v)
    try:
        return _start(changes, write, checkpoint, interval)  # the query has a session of its own from here on
    finally:
        for k in ours:
            spark.conf.unset(k)


def current_index(spark: SparkSession, root: str) -> DataFrame:
    """document_id, token, places: the postings that the log leaves."""
    log = spark.read.parquet(f"{root}/postings").drop(MARK)
    left = log.groupBy("document_id", "token", "places").agg(F.sum("sign").alias("n"))
    return left.filter("n > 0").drop("n")
