"""Suffix-array dedup: bytes covered by long strings that also start earlier in the corpus.

Every LENGTH-byte window of every text belongs to one anchor, its smallest ANCHOR-byte string by
hash (leftmost of equals). Equal windows have equal anchors, so windows that share an anchor, as one
segment of text, meet by the anchor's hash, and no others have to:

1. Anchors that occur once are set aside, by a bit table of fixed size built from those that don't. It is
   built before the frequent strings (below) are known: these move a window's anchor only if one of
   them is in the window, and so in every window equal to it, so that segments with one are kept too.
2. Segments that are wholly equal count once: every window of a later copy starts earlier in the
   first one (combined before the shuffle).
3. Different segments of an anchor go to one task, where shard Burrows-Wheeler transforms are merged
   by interleave refinement (bwtmerge); of each repeated interval the first row stays.

Anchors within passages that very many texts share would gather very many segments. Anchor strings
that are more frequent than a fixed fraction of all segments (so there is a bounded number of them)
come last in the order of anchors; windows at the edge of such a passage then have anchors beyond
the edge.

The order of occurrences is (id, start). Defined cases: a null or empty text has no bytes. Texts
shorter than LENGTH never change. Rows with equal ids and texts are one text: the same start in two
of them is one occurrence, what is cut in one is cut in all. Different texts of one id are documents
of their own, in order of their SHA-256. Rows with a null id are not compared and stay whole. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwtmerge import repeated
from .bytewords import Block, blocks, buffers, keep_memory, range_hashes, window_hashes
from .steps import by_id, fresh, keyed, settle, small_batches

LENGTH = 100
ANCHOR = 32
#: bytes merged at once in a task, more only if one anchor has more
MERGE_BYTES = 1 << 17
#: an anchor is frequent if over one in SHARE of all bytes under shared anchors are its segments'; a share, so
#: that inputs of every size have as many, but never below FREQUENT segments
SHARE, FREQUENT = 1 << 18, 64
#: bytes of texts taken together: about ten arrays of 8 bytes a byte are in use at once and stay in a core's cache
BLOCK = 1 << 16
#: distinct strings a task counts before it hands them on
COUNTED = 1 << 20
#: the bit table has 2 ** BUCKET_BITS rows of 2 ** 15 bits, 16 MB
BUCKET_BITS = 12
BROADCAST_IDS = 1_000_000
_OTHER_BASE = 0x27D4EB2F165667C5


def anchor_hashes(block: Block) -> np.ndarray:
    """Hash of the ANCHOR bytes from every byte on that has so many after it in the block."""
    return window_hashes(block.data, ANCHOR)


class HashSet:
    """A set of hashes, with a table of 64 entries a member that refuses most others before the search."""

    MAX_BITS = 22

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.sort(hashes)
        bits = min(self.MAX_BITS, max(1, len(hashes)).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.bits = np.zeros(1 << bits, dtype=bool)
        self.bits[self.sorted >> self.shift] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where in h the members of the set are."""
        maybe = np.flatnonzero(self.bits[h >> self.shift])
        at = np.searchsorted(self.sorted, h[maybe])
        at[at == len(self.sorted)] = 0
        return maybe[self.sorted[at] == h[maybe]] if len(self.sorted) else maybe[:0]


def segments(block: Block, demoted: HashSet | None, contents: bool = True) -> tuple[np.ndarray, ...]:
    """text, first window (byte in the text), number of windows, anchor hash, content hash, if wanted, and whether
    demoted strings may have given windows another anchor: their own is none and one is in the segment."""
    hashes = anchor_hashes(block)
    n = len(block.data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    order = (hashes >> np.uint64(1)) & np.uint64(0xFFFFFFFF00000000 >> 1)
    low = demoted.places(hashes) if demoted is not None else np.zeros(0, dtype=np.int64)
    order[low] |= np.uint64(1 << 63)
    order |= np.arange(len(order), dtype=np.uint64)
    least, width, need = order, 1, LENGTH - ANCHOR + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: n], least[need - width : need - width + n])
    place = (least[:n] & np.uint64(0x7FFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(block)), np.diff(block.bounds))[:n]
    inside = np.arange(n) + LENGTH <= block.bounds[text + 1]
    begins = np.ones(n, dtype=bool)
    begins[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(begins)
    count = np.diff(np.append(first, n))
    good = inside[first]
    first, count = first[good], count[good]
    content = range_hashes(block.data, first, first + count + LENGTH - 1, _OTHER_BASE) if contents else first[:0]
    moved = np.searchsorted(low, first + count + LENGTH - ANCHOR) > np.searchsorted(low, first)
    moved &= least[first] < np.uint64(1 << 63)
    return text[first], first - block.bounds[text[first]], count, hashes[place[first]], content, moved


class BitTable:
    """Fixed-size filter of anchor hashes: never refuses one that was put in."""

    def __init__(self, rows: list):
        self.bits = np.zeros((1 << BUCKET_BITS, 4096), dtype=np.uint8)
        for r in rows:
            self.bits[r["bucket"]] = np.frombuffer(r["bits"], dtype=np.uint8)

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        bucket = (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        bit = (h >> np.uint64(49 - BUCKET_BITS)).astype(np.int64) & 0x7FFF
        return (self.bits[bucket, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1


def _bit_table(anchors: DataFrame) -> BitTable:
    bucket = F.shiftrightunsigned("h", 64 - BUCKET_BITS)
    bit = F.shiftrightunsigned("h", 49 - BUCKET_BITS).bitwiseAND(F.lit(0x7FFF))
    rows = anchors.select(bucket.alias("bucket"), bit.alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return BitTable(rows.collect())


def _rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_memory()
    for batch in batches:
        for block in blocks(batch.column(1), lower=False, limit=BLOCK):
            yield _rows([segments(block, None, False)[3].view(np.int64)], ["h"])


def _segment_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        demoted, table = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(batch.column(1), lower=False, limit=BLOCK):
                text, first, count, h, content, moved = segments(block, demoted)
                keep = table.may_hold(h) | moved
                yield _rows(
                    [
                        h[keep].view(np.int64), content[keep].view(np.int64), ids[block.first + text[keep]].astype(np.int64),
                        first[keep].astype(np.int32), count[keep].astype(np.int32),
                    ],
                    ["h", "content", "doc", "first", "n"],
                )

    return run


def _frequent_strings(shared):
    """Hash and count of all anchor strings in the segments of the given anchors."""

    def combined(held: list) -> list:
        values, owner = np.unique(np.concatenate([v for v, _ in held]), return_inverse=True)
        return [(values, np.bincount(owner, np.concatenate([k for _, k in held]), len(values)).astype(np.int64))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        held, size = [], 0
        for batch in batches:
            for block in blocks(batch.column(1), lower=False, limit=BLOCK):
                text, first, count, h, _, _ = segments(block, None, False)
                at = np.searchsorted(shared.value, h)
                at[at == len(shared.value)] = 0
                hit = shared.value[at] == h
                if not hit.any():
                    continue
                start = block.bounds[text[hit]] + first[hit]
                covered = np.zeros(len(block.data) + 1, dtype=np.int64)
                np.add.at(covered, start, 1)
                np.add.at(covered, start + count[hit] + LENGTH - ANCHOR, -1)
                hashes = anchor_hashes(block)
                values, k = np.unique(hashes[np.cumsum(covered)[: len(hashes)] > 0], return_counts=True)
                held.append((values, k))
                size += len(values)
                if size > 2 * COUNTED:
                    held = combined(held)
                    size = len(held[0][0])
                    if size > COUNTED:
                        yield _rows([held[0][0].view(np.int64), held[0][1]], ["h", "k"])
                        held, size = [], 0
        if size:
            ((values, k),) = combined(held)
            yield _rows([values.view(np.int64), k], ["h", "k"])

    return run


def _cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted segments of each text."""
    keep_memory()
    for batch in batches:
        data, bounds = buffers(batch.column(1))
        lists = batch.column(2)
        doc = np.repeat(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()))
        base = np.repeat(bounds[:-1], np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        first, n, h = (flat.field(i).to_numpy() for i in range(3))
        size = n.astype(np.int64) + LENGTH - 1
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(base + first - (ends - size), size)
        if len(size):
            packed = data[take]
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            piece = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(doc), pa.array(first), piece], ["h", "doc", "first", "piece"])


def _merge_group(h: np.ndarray, doc: np.ndarray, first: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    at, group = repeated(data, bounds, LENGTH)
    piece = np.searchsorted(bounds, at, side="right") - 1
    owner, start = doc[piece], first[piece] + at - bounds[piece]
    order = np.lexsort((start, owner, group))
    g, o, s = group[order], owner[order], start[order]
    opens = np.ones(len(order), dtype=bool)
    opens[1:] = g[1:] != g[:-1]
    lead = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    later = (o != o[lead]) | (s != s[lead])
    o, s = o[later], s[later]
    by = np.lexsort((s, o))
    o, s = o[by], s[by]
    run = np.ones(len(o), dtype=bool)
    run[1:] = (o[1:] != o[:-1]) | (s[1:] > s[:-1] + 1)
    a = np.flatnonzero(run)
    last = np.append(a, len(o))[1:] - 1
    return _rows([o[a], s[a].astype(np.int32), (s[last] + LENGTH).astype(np.int32)], ["doc", "start", "end"])


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come in order of the anchor hash; whole anchors are gathered up to MERGE_BYTES."""
    keep_memory()
    held: list[pa.RecordBatch] = []
    size = 0

    def merged(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        data, bounds = buffers(table.column("piece"))
        h, doc, first = (table.column(c).to_numpy() for c in ("h", "doc", "first"))
        return _merge_group(h, doc, first.astype(np.int64), data, bounds)

    for batch in batches:
        held.append(batch)
        size += batch.column(3).nbytes
        if size >= MERGE_BYTES:
            table = pa.Table.from_batches(held)
            h = table.column("h").to_numpy()
            whole = int(np.searchsorted(h, h[-1]))
            if whole:
                yield merged(table.slice(0, whole))
                rest = table.slice(whole).combine_chunks()
                held, size = rest.to_batches(), rest.nbytes
    if held:
        yield merged(pa.Table.from_batches(held))


def _joined_spans(spans: list[dict], limit: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((s["start"], min(s["end"], limit)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cutter(whole_characters: bool):
    """Texts without their spans; whole_characters drops what is left of a character cut in two."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            spans = batch.column(2).to_pylist()
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for i, s in enumerate(spans):
                raw = data[bounds[i] : bounds[i + 1]]
                joined = _joined_spans(s or [], len(raw))
                if whole_characters:
                    joined = [(_character(raw, a, -1), _character(raw, b, 1)) for a, b in joined]
                mask = np.ones(len(raw), dtype=bool)
                for a, b in joined:
                    mask[a:b] = False
                left = raw[mask].tobytes() if joined else raw.tobytes()
                sizes.append(len(raw))
                removed.append(len(raw) - len(left))
                runs.append(len(joined))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if whole_characters else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                    pa.array(digests, pa.string()), pa.array(kept, pa.binary()),
                ],
                ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return cut


def _character(raw: np.ndarray, at: int, way: int) -> int:
    """The nearest place at or beyond this one, that way, where a character starts or the text ends."""
    while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += way
    return at


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, spans array<struct<start,end>> (bytes, in no order, may overlap), one row per text that has any."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    small_batches(spark)
    source = keyed(docs, id_col, text_col).where(F.col("_id").isNotNull() & (F.octet_length("_text") >= LENGTH))

    found = source.mapInArrow(_anchor_rows, "h long").groupBy("h").agg(F.count("*").alias("k"))
    anchors = settle(found.where("k > 1"), "anchors")
    limit = max(FREQUENT, ((anchors.agg(F.sum("k")).first()[0] or 0) * (LENGTH + ANCHOR)) // SHARE)
    frequent = [r["h"] for r in anchors.where(F.col("k") > limit).select("h").collect()]
    demoted = None
    if frequent:
        wanted = np.sort(np.array(frequent, dtype=np.int64).view(np.uint64))
        strings = source.mapInArrow(_frequent_strings(send(wanted)), "h long, k long").groupBy("h").agg(F.sum("k").alias("k"))
        found = strings.where(F.col("k") > limit).select("h").collect()
        demoted = HashSet(np.array([r["h"] for r in found], dtype=np.int64).view(np.uint64))

    table = send((demoted, _bit_table(anchors)))
    found = settle(source.mapInArrow(_segment_rows(table), "h long, content long, doc long, first int, n int"), "segments")
    groups = settle(
        found.groupBy("h", "content").agg(F.min(F.struct("doc", "first")).alias("at"), F.max("n").alias("n"), F.count("*").alias("k")),
        "contents",
    )
    copies = (
        found.join(groups.where("k > 1").select("h", "content", "at"), ["h", "content"])
        .where((F.col("doc") != F.col("at.doc")) | (F.col("first") != F.col("at.first")))
        .select("doc", F.col("first").alias("start"), (F.col("first") + F.col("n") + LENGTH - 1).alias("end"))
    )
    mixed = groups.groupBy("h").agg(F.count("*").alias("contents")).where("contents > 1").select("h")
    wanted = settle(
        groups.join(mixed, "h")
        .select(F.col("at.doc").alias("_id"), F.col("at.first").alias("first"), "n", "h")
        .groupBy("_id")
        .agg(F.collect_list(F.struct("first", "n", "h")).alias("wanted")),
        "wanted",
    )
    pieces = (
        _with_texts(source, wanted)
        .select("_id", F.col("_text").cast("binary"), "wanted")
        .mapInArrow(_cut_segments, "h long, doc long, first int, piece binary")
    )
    merged = pieces.repartition("h").sortWithinPartitions("h").mapInArrow(_merge_rows, "doc long, start int, end int")
    spans = copies.unionByName(merged)
    return settle(spans.groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "spans")


def _with_texts(source: DataFrame, rows: DataFrame, kind: str = "inner") -> DataFrame:
    """Texts joined with rows by _id. Texts without a row are told apart by a broadcast of the ids,
    if these are few enough, and are not shuffled then."""
    if rows.count() > BROADCAST_IDS:
        return source.join(rows, "_id", kind)
    ids = F.broadcast(rows.select("_id"))
    joined = source.join(ids, "_id", "left_semi").join(rows, "_id")
    if kind == "inner":
        return joined
    return joined.unionByName(source.join(ids, "_id", "left_anti"), allowMissingColumns=True)


_CUT = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _told_apart(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame | None]:
    """docs, the column that tells its documents apart, and that column by id where it is not the id.

    Where an id has different texts, (id, SHA-256 of the text) are numbered in their order.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    ids = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("h")).where("_id is not null")
    if ids.groupBy("_id").agg((F.min("h") != F.max("h")).alias("several")).where("several").isEmpty():
        return docs, id_col, None
    node, name, mark = fresh(docs, "_node"), fresh(docs, "_id"), fresh(docs, "_digest")
    rows = docs.select(F.col(id_col).cast("long").alias(name), digest.alias(mark)).where(F.col(name).isNotNull()).distinct()
    numbers = settle(rows.orderBy(name, mark).withColumn(node, F.monotonically_increasing_id()), "numbers")
    known = docs.withColumns({name: F.col(id_col).cast("long"), mark: digest}).join(numbers, [name, mark], "left")
    return settle(known.drop(name, mark), "documents"), node, numbers


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: _id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs, node, numbers = _told_apart(docs, id_col, text_col)
    spans = repeated_spans(docs, node, text_col)
    found = _with_texts(keyed(docs, node, text_col), spans, "left").mapInArrow(_cutter(False), _CUT).drop("kept")
    if numbers is None:
        return found
    names = numbers.select(F.col(node).alias("_node"), F.col(numbers.columns[0]).alias("_name"))
    out = found.join(names, F.col("_id") == F.col("_node"), "left")
    return out.select(F.col("_name").alias("_id"), *[c for c in found.columns if c != "_id"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with repeated bytes cut out of the text, all columns; a character cut in two goes whole.

    size_col, if there is such a column, gets the new number of characters.
    """
    columns = docs.columns
    docs, node, _ = _told_apart(docs, id_col, text_col)
    spans = repeated_spans(docs, node, text_col)
    source = keyed(docs, node, text_col)
    ids = F.broadcast(spans.select("_id")) if spans.count() <= BROADCAST_IDS else spans.select("_id")
    changed = source.join(ids, "_id", "left_semi").dropDuplicates(["_id"]).join(spans, "_id")
    name = fresh(docs, "_kept")
    texts = changed.mapInArrow(_cutter(True), _CUT).select("_id", F.decode("kept", "UTF-8").alias(name))
    touched = by_id(by_id(docs, ids, node, "left_semi"), texts, node, "inner").withColumn(text_col, F.col(name))
    if size_col in columns:
        touched = touched.withColumn(size_col, F.length(name).cast(docs.schema[size_col].dataType))
    return by_id(docs, ids, node, "left_anti").select(*columns).unionByName(touched.select(*columns))


def report(docs: DataFrame) -> DataFrame:
    """op7: what repeats take from every document."""
    return measure(docs).withColumnRenamed("_id", "doc_id")
