"""Byte-level BPE: every distinct word is encoded once, its ids go back to where the word stands.

Texts are cut into pre-tokens by the fixed rule of `splits`, in blocks of whole texts. Words take two ways:

* Frequent words (at most `HOT_WORDS` of at most `HOT_BYTES` bytes, so their table has a proven bound)
  are encoded once each and broadcast. No word that a large share of all texts holds is a shuffle key.
* All others are shuffled as rows (block, word, places), with one row per block and word, encoded once per
  distinct word, and shuffled back by block.

A block's own row is its ids with a mark at every rare word's place. Reassembly replaces the mark at each
place by the ids that came back, so positions decide where everything goes. Which words are frequent
never changes a result. Decoding joins the token-byte table, which is as large as the vocabulary, by id.

Defined cases: a null text is empty and has no ids. Every row has its own result, so repeated rows and ids
stay as they are; null ids too. Texts of any length and words of any length are whole. Ids that the
vocabulary has not decode to nothing. Other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import buffers
from .steps import keyed, settle, small_batches

HOT_WORDS, HOT_BYTES = 1 << 19, 64
#: words a task proposes as frequent, and words it counts before it drops the rarest
PROPOSED, COUNTED = 1 << 17, 1 << 20
#: bytes of text in a block; a longer text is a block of its own
BLOCK_BYTES = 1 << 21
#: bytes that are cut at once
PIECE_BYTES = 1 << 19
SPACE, LETTER, NUMBER, OTHER = range(4)


# --- vocabulary -----------------------------------------------------------------

def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64, a blank and its rank in every line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: neighbours merge, the lowest rank first and of equal ones the leftmost."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i; end 0: merged away
    queue = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(queue)

    def offer(a: int, b: int) -> None:
        rank = ranks.get(word[a:b])
        if rank is not None:
            heapq.heappush(queue, (rank, a, b))

    while queue:
        _, a, b = heapq.heappop(queue)
        middle = end[a]
        # a pair stands only while both of its parts do
        if not middle or middle >= b or end[middle] != b:
            continue
        end[a], end[middle] = b, 0
        if b < n:
            before[b] = a
            offer(a, end[b])
        if before[a] >= 0:
            offer(before[a], b)
    out, a = [], 0
    while a < n:
        out.append(ranks[word[a : end[a]]])
        a = end[a]
    return out


# --- pre-tokens -----------------------------------------------------------------

@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text, at = "".join(map(chr, points)), np.array(points)
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, text):
            out[at[m.start() : m.end()]] = kind
    return out


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character starts, and its code point."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    points = lead.astype(np.int32)
    for least, most, mask, length in ((0xC0, 0xE0, 0x1F, 2), (0xE0, 0xF0, 0x0F, 3), (0xF0, 0xF8, 0x07, 4)):
        some = np.flatnonzero((lead >= least) & (lead < most) & (at + length <= len(data)))
        if len(some):
            value = points[some] & mask
            for k in range(1, length):
                value = (value << 6) | (data[at[some] + k] & 0x3F)
            points[some] = value
    return at, points


def splits(data: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens start. opens: where non-empty texts start.

    A pre-token is an English contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers or of
    neither with at most one blank before it, or white space; of white space before something else the
    last character stands alone.
    """
    if not len(data):
        return np.zeros(0, dtype=np.int64)
    at, points = _characters(data)
    kind = _classes()[points]
    n = len(at)
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(at, opens)] = True
    first[[0, n]] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # something after white space: its last character stands apart, a blank goes with what follows
    after = np.flatnonzero(run[1:] & ~first[1:n] & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    mark = np.flatnonzero((points == 0x27) & run & start)
    mark = mark[~first[mark + 1]]
    if len(mark):
        padded = np.concatenate([points, [0, 0]])
        one, two = padded[mark + 1], np.where(first[np.minimum(mark + 2, n)], 0, padded[mark + 2])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(mark), dtype=bool)
        for pair in ("re", "ve", "ll"):
            long |= (one == ord(pair[0])) & (two == ord(pair[1]))
        for chosen, length in ((mark[short], 1), (mark[long], 2)):
            start[chosen + 1] = False
            rest = chosen + 1 + length
            start[rest[rest < n]] = True
    return at[start]


_SAFE = regex.compile(rb"[!-~][ \n]", regex.REVERSE)


def _pieces(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Spans of about PIECE_BYTES that no pre-token crosses: they end with a text, or where white
    space follows a visible ASCII character."""
    a, n = 0, len(data)
    raw = None
    while a < n:
        b = min(a + PIECE_BYTES, n)
        if b < n:
            ends = bounds[np.searchsorted(bounds, b, side="right") - 1]
            if ends > a:
                b = int(ends)
            else:
                raw = raw if raw is not None else data.tobytes()
                m = _SAFE.search(raw, a, b)
                if m is None:
                    m = next(regex.compile(rb"[!-~][ \n]").finditer(raw, b), None)
                b = m.start() + 1 if m else n
                past = bounds[np.searchsorted(bounds, a, side="right")]
                b = min(b, int(past))
        yield a, b
        a = b


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens of many texts in order, and where each text's pre-tokens start among them."""
    data, bounds = buffers(texts)
    opens = np.unique(bounds[:-1][np.diff(bounds) > 0])
    found = [np.zeros(0, dtype=np.int64)]
    for a, b in _pieces(data, bounds):
        own = opens[np.searchsorted(opens, a) : np.searchsorted(opens, b)] - a
        found.append(splits(data[a:b], own) + a)
    starts = np.concatenate(found)
    offsets = np.append(starts, len(data)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.searchsorted(starts, bounds)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts, about BLOCK_BYTES of text at a time."""
    held, size = [], 0
    for batch in batches:
        batch = pa.RecordBatch.from_arrays([batch.column(0), pc.fill_null(batch.column(1), "")], ["id", "text"])
        lengths = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        a = 0
        for i, length in enumerate(lengths):
            if size and size + length > BLOCK_BYTES:
                held.append(batch.slice(a, i - a))
                yield _joined(held)
                held, size, a = [], 0, i
            size += int(length)
        held.append(batch.slice(a))
    if any(b.num_rows for b in held):
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return tuple(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in table.columns)


# --- frequent words -------------------------------------------------------------

def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The most frequent short words of a task with their counts."""
    held, rows = [], 0

    def cut(tables: list[pa.Table], most: int) -> pa.Table:
        table = pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
        if table.num_rows > most:
            counts = table["n"].to_numpy()
            table = table.take(pa.array(np.sort(np.argpartition(-counts, most)[:most])))
        return table

    for _, texts in _blocks(batches):
        counted = words_of(texts)[0].value_counts()
        table = pa.table({"word": counted.field("values"), "n": counted.field("counts")})
        table = table.filter(pc.less_equal(pc.binary_length(table["word"]), HOT_BYTES))
        held.append(table)
        rows += table.num_rows
        if rows > 2 * COUNTED:
            held = [cut(held, COUNTED)]
            rows = held[0].num_rows
    if rows:
        yield from cut(held, PROPOSED).combine_chunks().to_batches(max_chunksize=1 << 14)


def _encode_words(ranks, keep: list[str]):
    """The kept columns and the ids of the column word; equal words that follow each other are encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, b""
        for batch in batches:
            out = []
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, np.array(merge(word, ranks.value), dtype=np.uint32).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.binary())], [*keep, "ids"])

    return run


def _frequent(rows: DataFrame, ranks, most: int) -> pa.Table:
    """word, ids of the most frequent words: at most `most`, of at most HOT_BYTES bytes each.

    The least count comes from a small histogram, so no task sorts or holds the candidates.
    """
    counts = settle(
        rows.mapInArrow(_propose, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words"
    )
    level = F.floor(F.log2("n") * 8).cast("int").alias("level")
    least, total = None, 0
    for found in sorted(counts.groupBy(level).count().collect(), reverse=True):
        total += found["count"]
        if total > most:
            break
        least = found["level"]
    chosen = counts.where(F.lit(False)) if least is None else counts.where(F.floor(F.log2("n") * 8).cast("int") >= least)
    return chosen.select("word").mapInArrow(_encode_words(ranks, ["word"]), "word binary, ids binary").toArrow()


class _Lookup:
    """The frequent words' ids, flat, with one more entry that marks a rare word."""

    def __init__(self, table: pa.Table, mark: int):
        table = table.combine_chunks()
        self.words = table["word"].chunk(0) if table["word"].num_chunks else pa.array([], pa.binary())
        flat = b"".join(table["ids"].to_pylist())
        lengths = pc.binary_length(table["ids"]).to_numpy().astype(np.int64) // 4
        self.length = np.append(lengths, 1)
        self.start = np.concatenate([[0], np.cumsum(lengths)])
        self.flat = np.append(np.frombuffer(flat, dtype=np.uint32), np.uint32(mark))

    def find(self, words: pa.Array) -> np.ndarray:
        """Entry of every word; the last entry is that of rare ones."""
        none = len(self.length) - 1
        return pc.fill_null(pc.index_in(words, value_set=self.words), none).to_numpy().astype(np.int64)


# one table per worker at a time
_open: dict = {}


def _lookup(table, mark: int) -> _Lookup:
    key = id(table.value)
    if _open.get("key") != key:
        _open.update(key=key, keep=table.value, lookup=_Lookup(pa.ipc.open_stream(table.value).read_all(), mark))
    return _open["lookup"]


def _gather(lengths: np.ndarray, starts: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + lengths[i]] for all i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


# --- encoding -------------------------------------------------------------------

def _name(ids: pa.Array, texts: pa.Array) -> bytes:
    """A block is named by its contents: two readings of the same rows agree."""
    data, bounds = buffers(texts)
    h = xxhash.xxh3_128(np.ascontiguousarray(data))
    h.update(bounds.astype(np.int64).tobytes())
    h.update(repr(ids.to_pylist()).encode())
    return h.digest()


def _rare(table, mark: int):
    """(block, word, places) of all words that are not frequent; places count the rare words of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(table, mark)
        for ids, texts in _blocks(batches):
            coded = words_of(texts)[0].dictionary_encode()
            at = coded.indices.to_numpy()
            rare = lookup.find(coded.dictionary) == len(lookup.length) - 1
            which = at[rare[at]]
            if not len(which):
                continue
            order = np.argsort(which, kind="stable").astype(np.int32)
            chosen, counts = np.unique(which, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(counts * 4)]).astype(np.int32)
            places = pa.Array.from_buffers(pa.binary(), len(chosen), [None, pa.py_buffer(offsets), pa.py_buffer(order)])
            words = coded.dictionary.take(pa.array(chosen))
            block = pa.array([_name(ids, texts)] * len(chosen), pa.binary())
            rows = pa.RecordBatch.from_arrays([block, words, places], ["block", "word", "places"])
            for a in range(0, rows.num_rows, 1 << 13):
                yield rows.slice(a, 1 << 13)

    return run


def _skeletons(table, mark: int, width):
    """(block, body): document ids, ids per text, and all ids with the mark for every rare word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _lookup(table, mark)
        pack = zstandard.ZstdCompressor(level=3)
        for ids, texts in _blocks(batches):
            words, opens = words_of(texts)
            coded = words.dictionary_encode()
            entry = lookup.find(coded.dictionary)[coded.indices.to_numpy()]
            lengths = lookup.length[entry]
            flat = _gather(lengths, lookup.start[entry], lookup.flat).astype(width)
            per_text = np.diff(np.concatenate([[0], np.cumsum(lengths)])[opens])
            known = pc.fill_null(ids, 0).to_numpy().astype(np.int64)
            null = pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8)
            body = np.int64(len(texts)).tobytes() + known.tobytes() + null.tobytes() + per_text.astype(np.int64).tobytes() + flat.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([_name(ids, texts)], pa.binary()), pa.array([pack.compress(body)], pa.binary())], ["block", "body"]
            )

    return run


def _reassemble(mark: int, width):
    """doc_id and ids of every text, from rows of a block: its bodies, then what came back of its rare words."""
    def whole(bodies: list[bytes], places: list[bytes], found: list[bytes]) -> Iterator[pa.RecordBatch]:
        body = zstandard.ZstdDecompressor().decompress(bodies[0])
        n = int(np.frombuffer(body, np.int64, 1)[0])
        doc = np.frombuffer(body, np.int64, n, 8)
        null = np.frombuffer(body, np.uint8, n, 8 + 8 * n).astype(bool)
        per_text = np.frombuffer(body, np.int64, n, 8 + 9 * n)
        flat = np.frombuffer(body, width, -1, 8 + 17 * n).astype(np.int64)
        holes = np.flatnonzero(flat == mark)
        # ids of each rare word stand after the known ones; each hole points at its word's
        rare = np.frombuffer(b"".join(found), np.uint32).astype(np.int64)
        sizes = np.array([len(f) // 4 for f in found], dtype=np.int64)
        counts = [len(p) // 4 for p in places]
        at = np.frombuffer(b"".join(places), np.int32)
        owner = np.full(len(holes), -1, dtype=np.int64)
        owner[at] = np.repeat(np.arange(len(found)), counts)
        if len(holes) and owner.min() < 0:
            raise RuntimeError("the rows of a block changed between two readings; encode a written table")
        lengths, starts = np.ones(len(flat), dtype=np.int64), np.arange(len(flat))
        if len(holes):
            lengths[holes] = sizes[owner]
            starts[holes] = len(flat) + (np.cumsum(sizes) - sizes)[owner]
        ids = _gather(lengths, starts, np.concatenate([flat, rare])).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(per_text)])]
        lists = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))
        out = pa.RecordBatch.from_arrays([pa.array(doc, pa.int64(), mask=null), lists], ["doc_id", "ids"])
        for _ in bodies:
            yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, bodies, places, found = None, [], [], []
        for batch in batches:
            for name, body, place, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != block:
                    if bodies:
                        yield from whole(bodies, places, found)
                    block, bodies, places, found = name, [], [], []
                if body is not None:
                    bodies.append(body)
                else:
                    places.append(place)
                    found.append(ids)
        if bodies:
            yield from whole(bodies, places, found)

    return run


def encode(
    docs: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text",
    stable: bool = False, hot_words: int = HOT_WORDS,
) -> DataFrame:
    """doc_id and ids (array<int>) of every row.

    The texts are read three times. stable: they come in the same order each time, as from files; other
    rows are written first.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    if not stable:
        rows = settle(rows, "texts")
    mark = max(ranks.values(), default=0) + 1
    width = np.uint16 if mark < 1 << 16 else np.uint32
    shared = spark.sparkContext.broadcast(ranks)
    sink = pa.BufferOutputStream()
    table = _frequent(rows, shared, hot_words)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    hot = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

    rare = (
        rows.mapInArrow(_rare(hot, mark), "block binary, word binary, places binary")
        .repartition("word").sortWithinPartitions("word")
        .mapInArrow(_encode_words(shared, ["block", "places"]), "block binary, places binary, ids binary")
        .select("block", F.lit(None).cast("binary").alias("body"), "places", "ids")
    )
    none = F.lit(None).cast("binary")
    bodies = rows.mapInArrow(_skeletons(hot, mark, width), "block binary, body binary").select(
        "block", "body", none.alias("places"), none.alias("ids")
    )
    return (
        bodies.unionByName(rare).repartition("block")
        .sortWithinPartitions("block", F.col("body").isNull())
        .mapInArrow(_reassemble(mark, width), "doc_id long, ids array<int>")
    )


# --- decoding -------------------------------------------------------------------

def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded with the bytes its ids stand for, as column decoded.

    The token-byte table, one entry per id of the vocabulary, is a constant and joined by id in the row.
    """
    tokens = [""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token.hex()
    table = F.split(F.lit(",".join(tokens)), ",")
    found = F.transform("ids", lambda i: F.get(table, i))
    return encoded.withColumn("decoded", F.coalesce(F.unhex(F.array_join(found, "")), F.lit(b"")))


def report(docs: DataFrame, path: str) -> DataFrame:
    """op11: digests of the ids of every text and of what they decode to."""
    ranks = read_ranks(path)
    return decode(encode(docs, ranks, stable=True), ranks).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
