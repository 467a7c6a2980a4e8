"""MinHash near-duplicates by tensored banding.

A text is the set of its distinct word shingles. Two small collections of hash tuples are drawn,
each SIDE tuples of TUPLE minhashes; a table is a pair of tuples, one of each collection, so
2 * SIDE * TUPLE minhashes serve SIDE * SIDE tables of 2 * TUPLE minhashes each. Two texts are
candidates when they agree in some tuple of both collections; a link is confirmed on their full
sets. At a similarity of exactly 0.8 the two collections miss a pair once in 2,800 times, at 0.85
once in 45,000; every pair that shares a table is decided exactly:

1. Texts with equal sets are one class, represented by its smallest id (combined before shuffles).
2. In each table entry every class is compared with the entry's smallest, its head, never all with
   all. The comparison also says how many shingles a class shares with the head, and which it has
   besides.
3. Classes of one head that are not in one component yet are told apart by how each differs from
   the core of the head's group, the shingles that most of the group has: what a class lacks of the
   core and what it has besides give the exact overlap of any two. Differences alone that are small
   enough link a class to the one nearest to the core. All other links need so many differences in
   common that two classes meet in the first few of them (a prefix join, by equality on shingles);
   the links found are confirmed on full sets. All other pairs are proven unlinked, so groups of
   near copies need comparisons in proportion to their size.

Defined cases: null, empty or wordless texts have no shingles, n_shingles 0, and are linked with
nothing. Texts with fewer words than a shingle have their whole word sequence as their one shingle.
Rows with equal ids are one node: texts that any of them links are
linked. Rows with a null id get a null component and are kept. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import Block, blocks, byte_table, mix, sequence_hashes
from .graph import components
from .steps import by_id, keyed, settle, small_batches

#: every byte but blank and \\t \\n \\v \\f \\r
WORD_BYTES = byte_table(set(range(256)) - {0x20, *range(0x09, 0x0E)})


@dataclass(frozen=True)
class Tables:
    """Words a shingle, percent of the union shared, tuples a side, minhashes a tuple."""

    words: int = 5
    percent: int = 80
    side: int = 12
    tuple_size: int = 3


#: candidate ids up to this many (8 bytes each) are broadcast to pick their texts, more are joined by shuffle
BROADCAST_IDS = 1_000_000


def shingle_sets(block: Block, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    start, end, first = block.words(WORD_BYTES)
    word = block.hashes(start, end)
    grams = sequence_hashes(word, words)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        else:
            out.append(sequence_hashes(word[a:b], b - a)[:1] if b > a else word[:0])
    return out


def _tuples(sets: list[np.ndarray], how: Tables) -> np.ndarray:
    """For each (non-empty) set 2 * side tuple hashes."""
    n = 2 * how.side * how.tuple_size
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    values = np.concatenate(sets)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((2 * how.side, len(sets)), dtype=np.uint64)
    for t in range(2 * how.side):
        h = np.full(len(sets), t, dtype=np.uint64)
        for k in range(t * how.tuple_size, (t + 1) * how.tuple_size):
            drawn = (values ^ seeds[2 * k]) * (seeds[2 * k + 1] | np.uint64(1))
            drawn ^= drawn >> np.uint64(29)
            h = mix(h * np.uint64(0x100000001B3) + np.minimum.reduceat(drawn, bounds))
        out[t] = h
    return out.T


def _signer(how: Tables):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes, digests, rows = np.zeros(n, dtype=np.int64), [None] * n, [None] * n
            for block in blocks(batch.column(1)):
                sets = shingle_sets(block, how.words)
                full = [k for k, s in enumerate(sets) if len(s)]
                if not full:
                    continue
                tuples = _tuples([sets[k] for k in full], how).view(np.int64)
                for k, t in zip(full, tuples):
                    row = block.first + k
                    sizes[row], rows[row] = len(sets[k]), t
                    digests[row] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes), pa.array(digests, pa.binary()), pa.array(rows, pa.list_(pa.int64()))],
                ["_id", "n", "digest", "tuples"],
            )

    return sign


def _verifier(how: Tables):
    def one(text: str | None) -> np.ndarray:
        block = next(blocks(pa.array([text or ""], pa.string())))
        return shingle_sets(block, how.words)[0]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            a, b, more = (batch.column(i).to_pylist() for i in range(3))
            sets_b = [s for block in blocks(batch.column(4)) for s in shingle_sets(block, how.words)]
            rows = []
            for i, s in enumerate(sets_b):
                if left is None or a[i] != last:
                    last, left = a[i], one(batch.column(3)[i].as_py())
                at = np.searchsorted(left, s)
                at[at == len(left)] = 0
                shared = left[at] == s if len(left) else np.zeros(len(s), dtype=bool)
                both = int(shared.sum())
                linked = 100 * both >= how.percent * (len(left) + len(s) - both)
                besides = lacks = None
                if more[i]:
                    kept = np.ones(len(left), dtype=bool)
                    kept[at[shared]] = False
                    besides, lacks = s[~shared].view(np.int64), left[kept].view(np.int64)
                rows.append((a[i], b[i], linked, both, len(s), besides, lacks))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["a", "b", "linked", "shared", "n", "besides", "lacks"]
            )

    return verify


def _compare(pairs: DataFrame, texts: DataFrame, how: Tables) -> DataFrame:
    """a, b, linked, n (of b), besides (shingles b has and a has not), lacks, shared; these where more is true."""
    full = pairs.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b").join(
        texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a"
    )
    made = full.select("a", "b", "more", "ta", "tb").mapInArrow(
        _verifier(how), "a long, b long, linked boolean, shared long, n long, besides array<long>, lacks array<long>"
    )
    return settle(made, "compared")


def _entries(signed: DataFrame, how: Tables) -> DataFrame:
    """key, _id: one row per class and table."""
    half = how.side
    return (
        signed.select("_id", F.slice("tuples", 1, half).alias("u"), F.slice("tuples", half + 1, half).alias("v"))
        .select("_id", "v", F.explode("u").alias("u"))
        .select("_id", "u", F.explode("v").alias("v"))
        .select(F.xxhash64("u", "v").alias("key"), "_id")
    )


_SIGNED = "_id long, n long, digest binary, tuples array<long>"


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Tables = Tables()) -> DataFrame:
    """Per row of docs: _id, n_shingles, component_id (the smallest id that links lead to)."""
    small_batches(docs.sparkSession)
    source = keyed(docs, id_col, text_col)
    signed = settle(source.mapInArrow(_signer(how), _SIGNED), "signed")
    texts = signed.where("n > 0 and _id is not null").groupBy("_id").agg((F.min("digest") != F.max("digest")).alias("several"))
    if texts.where("several").isEmpty():
        return _components_of(source, signed, how)
    return _with_links_of_ids(source, how)


def _with_links_of_ids(source: DataFrame, how: Tables) -> DataFrame:
    """classes where an id has different texts: rows are the nodes, and the rows of an id are linked."""
    numbered = settle(source.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.when(F.col("_id").isNotNull(), F.col("_row")).alias("_row"), "_id", "_text")
    single = rows.select(F.col("_row").alias("_id"), "_text")
    found = _components_of(single, settle(single.mapInArrow(_signer(how), _SIGNED), "signed"), how).where("_id is not null")
    met = settle(found.withColumnRenamed("_id", "_row").join(numbered.select("_row", "_id"), "_row"), "rows")
    worded = met.where("n_shingles > 0")
    least = worded.groupBy("_id").agg(F.min("component_id").alias("a"))
    labels = components(worded.join(least, "_id").select("a", F.col("component_id").alias("b")))
    joined = worded.join(labels.select(F.col("node").alias("component_id"), "label"), "component_id", "left").select(
        "_row", F.coalesce("label", "component_id").alias("label"), "_id"
    )
    names = joined.groupBy("label").agg(F.min("_id").alias("component"))
    named = joined.join(names, "label").select("_row", "component")
    whole = met.join(named, "_row", "left").select("_id", "n_shingles", F.coalesce("component", "_id").alias("component_id"))
    nameless = rows.where("_row is null").select("_id", "_text").mapInArrow(_signer(how), _SIGNED)
    return whole.unionByName(nameless.select("_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


def _components_of(source: DataFrame, signed: DataFrame, how: Tables) -> DataFrame:
    """classes where an id has one text."""
    full = signed.where("n > 0 and _id is not null")
    first = settle(full.groupBy("digest").agg(F.min("_id").alias("_id")), "first")
    chosen = full.join(first, ["digest", "_id"], "left_semi").select("_id", "n", "tuples").dropDuplicates(["_id"])
    sizes = settle(chosen, "classes")
    shared = _entries(sizes, how).groupBy("key").agg(F.min("_id").alias("head"), F.count("*").alias("k")).where("k > 1")
    entries = settle(_entries(sizes, how).join(shared.select("key", "head"), "key"), "entries")
    ids = settle(entries.select("_id").distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    texts = settle(source.join(F.broadcast(ids) if few else ids, "_id", "left_semi").dropDuplicates(["_id"]), "texts")
    pairs = entries.where("head <> _id").select(F.col("head").alias("a"), F.col("_id").alias("b")).distinct()
    several = pairs.groupBy("a").agg((F.count("*") > 1).alias("more"))
    compared = _compare(pairs.join(several, "a"), texts, how)
    links = compared.where("linked").select("a", "b")
    labels = components(links)
    near, alike = _by_differences(compared, labels, how)
    near = settle(near, "near")
    alike = settle(alike.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
    if not (near.isEmpty() and alike.isEmpty()):
        links = links.unionByName(near).unionByName(_compare(alike, texts, how).where("linked").select("a", "b"))
        labels = components(links)
    return (
        signed.join(first.select("digest", F.col("_id").alias("node")), "digest", "left")
        .join(labels, "node", "left")
        .select(
            "_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("_id").isNotNull(), F.coalesce("label", "node", "_id")).alias("component_id"),
        )
    )


def _by_differences(compared: DataFrame, labels: DataFrame, how: Tables) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) by size of differences alone, and pairs (a, b, more) that their differences link.

    With the core C of a head's group, l the shingles of C a class lacks and e all its differences
    (those, and what it has besides C), |x & y| = |C| - l_x - l_y + |e_x & e_y|. A link needs it to
    be p / (100 + p) of |x| + |y|, so |e_x & e_y| has to reach
    need = p / (100 + p) * (|x| + |y|) - |C| + l_x + l_y = w_x + w_y - |C|, w = l + p / (100 + p) * n.
    Where need <= 0 for a pair, it is so for each of the two with the class of the smallest w.
    """
    p = how.percent
    named = (
        compared.where(F.col("besides").isNotNull())
        .join(labels.select(F.col("node").alias("b"), "label"), "b", "left")
        .withColumn("label", F.coalesce("label", "b"))
    )
    mixed = (
        named.groupBy("a", "label").agg(F.count("*").alias("k"), F.max(F.col("shared") + F.size("lacks")).alias("head_size"))
        .groupBy("a").agg(
            F.max_by("label", F.struct("k", "label")).alias("main"), F.count("*").alias("labels"), F.sum("k").alias("members"),
            F.max("head_size").alias("head_size"),
        )
        .where("labels > 1").drop("labels")
    )
    members = settle(named.join(mixed, "a"), "members")

    def common(column: str, name: str) -> DataFrame:
        """By head, the shingles in this column of at least half of its group."""
        held = members.select("a", "members", F.explode(column).alias("s")).groupBy("a", "s").agg(F.count("*").alias("k"), F.max("members").alias("m"))
        return held.where("2 * k >= m").groupBy("a").agg(F.collect_list("s").alias(name))

    none = F.array().cast("array<bigint>")
    cores = settle(
        mixed.select("a").join(common("besides", "plus"), "a", "left").join(common("lacks", "minus"), "a", "left")
        .select("a", F.coalesce("plus", none).alias("plus"), F.coalesce("minus", none).alias("minus")),
        "cores",
    )
    lacking = F.concat(F.array_except("lacks", "minus"), F.array_except("plus", "besides"))
    extra = F.concat(F.array_except("besides", "plus"), F.array_except("minus", "lacks"))
    known = settle(
        members.join(cores, "a").select(
            "a", "b", "label", "main", (F.col("head_size") - F.size("minus") + F.size("plus")).alias("core"),
            # (100 + p) * w, a whole number
            (F.size(lacking) * (100 + p) + F.col("n") * p).alias("w"), # what hardly any other class has comes first, so prefixes rarely meet by chance
            F.concat(F.array_sort(extra), F.array_sort(lacking)).alias("e"),
        ),
        "differences",
    )
    nearest = known.groupBy("a").agg(F.min(F.struct("w", "b")).alias("best")).select("a", F.col("best.b").alias("x"), F.col("best.w").alias("wx"))
    near = (
        known.join(nearest, "a").where((F.col("w") + F.col("wx") <= F.col("core") * (100 + p)) & (F.col("b") != F.col("x")))
        .select(F.least("x", "b").alias("a"), F.greatest("x", "b").alias("b")).distinct()
    )

    def prefixed(who: str) -> DataFrame:
        at = F.posexplode("e").alias(f"at_{who}", "s")
        return known.select("a", F.col("b").alias(who), F.col("label").alias(f"l{who}"), F.col("w").alias(f"w{who}"),
                            F.size("e").alias(f"n{who}"), *(["core"] if who == "x" else []), "main", at)

    need = F.ceil((F.col("wx") + F.col("wy") - F.col("core") * (100 + p)) / (100 + p))
    met = (
        # of two components one is not the largest
        prefixed("x").where("lx <> main").drop("main").join(prefixed("y").drop("main"), ["a", "s"])
        .where((F.col("lx") != F.col("ly")) & (need >= 1) & (F.col("at_x") <= F.col("nx") - need) & (F.col("at_y") <= F.col("ny") - need))
        # a pair that has several heads is settled under one of them
        .groupBy("x", "y").agg(F.min(F.struct("a", need.alias("need"))).alias("m")).select("m.a", "x", "y", "m.need")
    )
    ex = known.select("a", F.col("b").alias("x"), F.col("e").alias("ex"))
    ey = known.select("a", F.col("b").alias("y"), F.col("e").alias("ey"))
    linked = met.join(ex, ["a", "x"]).join(ey, ["a", "y"]).where(F.size(F.array_intersect("ex", "ey")) >= F.col("need"))
    pairs = linked.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.lit(False).alias("more")).distinct()
    return near, pairs


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: Tables = Tables()) -> DataFrame:
    """Of every component the document with the smallest id, all columns; null ids stay."""
    found = classes(docs, id_col, text_col, how)
    gone = settle(found.where(F.col("_id") != F.col("component_id")).select("_id").distinct(), "gone")
    return by_id(docs, gone, id_col, "left_anti")


#: what the contract of op5 fixes
CONTRACT = Tables(words=2)


def report(docs: DataFrame) -> DataFrame:
    """op5: the component of every document."""
    return classes(docs, how=CONTRACT).select(
        F.col("_id").alias("doc_id"),
        "n_shingles",
        "component_id",
        F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
