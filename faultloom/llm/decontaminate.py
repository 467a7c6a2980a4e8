"""Benchmark decontamination: training texts that hold word windows of benchmark items.

The windows of all items form a hash set that every task receives. It is measured first: sets of
more than MAX_WINDOWS go out in several passes of at most that many, each over all texts, so what
is broadcast has a bound at every benchmark size. Training texts are scanned where they lie; a
hash that is found is verified word by word. Nothing of the training texts is shuffled in one pass;
with several, only the spans found are.

Defined cases: a null or empty text, or one without words, has no words and no hits. A null or
wordless item has no windows. Items with fewer words than the window are one window of their own
length. Equal items all count. Rows with a null id keep their result; equal ids are separate rows
in one pass and one row in several. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Block, blocks, byte_table, sequence_hashes
from .steps import by_id, fresh, keyed, settle, small_batches

WINDOW = 10
MAX_WINDOWS = 1_000_000
#: digits, a-z (texts are lower-cased first) and every byte of a non-ASCII character
WORD_BYTES = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])

_WINDOW_SCHEMA = "item string, length int, hash long, words binary"
_HIT_SCHEMA = (
    "_id long, n_words long, spans array<struct<first:int,last:int,start:int,end:int>>, items array<string>"
)


def _joined(block: Block, start: np.ndarray, end: np.ndarray) -> bytes:
    return b" ".join(block.data[s:e].tobytes() for s, e in zip(start, end))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """One row per distinct window of an item: item, length, hash, words joined by blanks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = set()
            for block in blocks(batch.column(1)):
                start, end, first = block.words(WORD_BYTES)
                hashes = block.hashes(start, end)
                for k in range(len(block)):
                    a, b = first[k], first[k + 1]
                    length = min(window, b - a)
                    if length:
                        for i, h in enumerate(sequence_hashes(hashes[a:b], length).view(np.int64)):
                            lo = a + i
                            words = _joined(block, start[lo : lo + length], end[lo : lo + length])
                            rows.add((ids[block.first + k], int(length), int(h), words))
            columns = list(zip(*rows)) or [[], [], [], []]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, kinds)], ["item", "length", "hash", "words"]
            )

    return (
        benchmark.select(F.col(id_col).cast("string").alias("_id"), F.col(text_col).cast("string").alias("_text"))
        .mapInArrow(cut, _WINDOW_SCHEMA)
        .distinct()
    )


class _WindowSet:
    """Sorted hashes with the words and items of each, and a bit table that refuses most others."""

    BITS = 22

    def __init__(self, rows: list):
        held: dict[tuple[int, bytes], set] = {}
        for r in rows:
            held.setdefault((r["hash"] & (1 << 64) - 1, bytes(r["words"])), set()).add(r["item"])
        order = sorted(held)
        self.hash = np.array([h for h, _ in order], dtype=np.uint64)
        self.words = [w for _, w in order]
        self.items = [sorted(i for i in held[k] if i is not None) for k in order]
        self.lengths = sorted({r["length"] for r in rows})
        self.bits = np.zeros(1 << self.BITS, dtype=bool)
        self.bits[self._slot(self.hash)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are in the set, and for each the first entry with that hash."""
        maybe = np.flatnonzero(self.bits[self._slot(h)])
        at = np.searchsorted(self.hash, h[maybe])
        at[at == len(self.hash)] = 0
        good = self.hash[at] == h[maybe]
        return maybe[good], at[good]

    def same(self, entry: int, words: bytes) -> int | None:
        """Of the entries from this one on with its hash, the one with exactly these words."""
        h = self.hash[entry]
        while entry < len(self.hash) and self.hash[entry] == h:
            if self.words[entry] == words:
                return entry
            entry += 1
        return None


def _scan(block: Block, windows: _WindowSet):
    """Words per text, and per text with hits its word spans (merged), byte spans and items."""
    start, end, first = block.words(WORD_BYTES)
    hashes = block.hashes(start, end)
    owner = np.repeat(np.arange(len(block)), np.diff(first))
    hits: dict[int, tuple[list, set]] = {}
    for length in windows.lengths:
        grams = sequence_hashes(hashes, length)
        if not len(grams):
            continue
        at, entry = windows.find(grams)
        inside = owner[at] == owner[at + length - 1]
        for i, e in zip(at[inside], entry[inside]):
            k = windows.same(int(e), _joined(block, start[i : i + length], end[i : i + length]))
            if k is not None:
                spans, items = hits.setdefault(int(owner[i]), ([], set()))
                spans.append((int(i), int(i) + length))
                items.update(windows.items[k])
    found = {}
    for k, (spans, items) in hits.items():
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        text = block.bounds[k]
        found[k] = (
            [
                {"first": a - int(first[k]), "last": b - int(first[k]), "start": int(start[a] - text), "end": int(end[b - 1] - text)}
                for a, b in merged
            ],
            sorted(items),
        )
    return np.diff(first), found


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros(n, dtype=np.int64)
            spans: list = [[]] * n
            items: list = [[]] * n
            for block in blocks(batch.column(1)):
                words, found = _scan(block, shared.value)
                counts[block.first : block.first + len(block)] = words
                for k, (s, i) in found.items():
                    spans[block.first + k], items[block.first + k] = s, i
            span = pa.struct([(x, pa.int32()) for x in ("first", "last", "start", "end")])
            schema = schema or pa.schema(
                [("_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string()))]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))],
                schema=schema,
            )

    return scan


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Per text: _id, n_words, spans (word bounds, byte bounds, merged, ascending), items (sorted)."""
    spark = docs.sparkSession
    small_batches(spark)
    windows = settle(benchmark_windows(benchmark, item_col, item_text_col, window), "windows")
    passes = max(1, -(-windows.count() // max_windows))
    source = keyed(docs, id_col, text_col)
    if passes == 1:
        return source.mapInArrow(_scanner(spark.sparkContext.broadcast(_WindowSet(windows.collect()))), _HIT_SCHEMA)
    # rows are told apart by a number, not by their ids; one part of the windows is held at a time
    numbered = settle(source.withColumn("_row", F.monotonically_increasing_id()), "texts")
    rows, counted = numbered.select(F.col("_row").alias("_id"), "_text"), None
    for p in range(passes):
        part = windows.where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == p).collect()
        shared = spark.sparkContext.broadcast(_WindowSet(part))
        found = settle(rows.mapInArrow(_scanner(shared), _HIT_SCHEMA), "hits")
        shared.destroy()
        counted = found if counted is None else counted.unionByName(found)
    whole = (
        counted.withColumnRenamed("_id", "_row").groupBy("_row")
        .agg(
            F.max("n_words").alias("n_words"),
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        .withColumn("spans", _merged(F.col("spans")))
    )
    return numbered.select("_row", "_id").join(whole, "_row").drop("_row")


def _merged(spans):
    """Neighbouring or overlapping word spans as one; spans come sorted."""
    kind = "array<struct<first:int,last:int,start:int,end:int>>"

    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(
            last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"),
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"),
        )
        return F.when((F.size(done) > 0) & (s["first"] <= F.try_element_at(done, F.lit(-1))["last"]),
                      F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(done, F.array(s)))

    return F.aggregate(spans, F.array().cast(kind), step)


def contaminated_ids(hits: DataFrame) -> DataFrame:
    return hits.where(F.size("spans") > 0).select("_id")


def drop_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents without any hit, all columns; rows with equal, or null, ids go together."""
    hits = settle(contaminated_ids(find_hits(docs, benchmark, id_col, text_col, **kw)), "hits")
    return by_id(docs, hits.distinct(), id_col, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """All documents, hit spans cut out of the text by byte bounds (they lie between characters).

    Ids must be unique; of rows with equal ids only those with the first one's text are cut right.
    """
    hits = find_hits(docs, benchmark, id_col, text_col, **kw).where(F.size("spans") > 0).select("_id", "spans")
    name = fresh(docs, "_spans")
    hits = settle(hits.dropDuplicates(["_id"]).withColumnRenamed("spans", name), "hits")
    raw = F.encode(F.col(text_col), "UTF-8")
    kept = F.aggregate(
        name,
        F.struct(F.lit(1).alias("at"), F.lit("").cast("string").alias("out")),
        lambda s, x: F.struct(
            (x["end"] + 1).alias("at"),
            F.concat(s["out"], F.decode(raw.substr(s["at"], x["start"] + 1 - s["at"]), "UTF-8")).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.decode(raw.substr(s["at"], F.octet_length(raw)), "UTF-8")),
    )
    joined = by_id(docs, hits, id_col, "left").withColumn(text_col, F.when(F.col(name).isNull(), F.col(text_col)).otherwise(kept))
    return joined.select(*docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op9: digest columns of the hits of every document."""
    hits = find_hits(docs, benchmark)
    return hits.select(
        F.col("_id").alias("doc_id"),
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["last"] - s["first"])).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
