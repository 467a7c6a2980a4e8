"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the 64-bit hashes of its distinct words, the first bytes of longer words, word pairs,
word triples and pairs with one word between. Training goes over at most TRAIN_ROWS labelled texts,
those with the smallest id hash, so its data is bounded at every corpus size; their features are
made where the texts lie and meet in one task. Each coordinate has its own rate, L1 leaves few
weights, and only those are broadcast. Scoring is one pass over whole texts without a shuffle.

Defined cases: a null or empty text has no feature and gets the score of the bias. A label other
than 0 counts as 1, a null label is no label, of several labels of one id the largest counts.
Rows with a null id are scored, are not held out and are never learnt from. Equal ids with
different texts are scored one by one. Without any labelled text every score is PRIOR. Other
columns of the tables are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import Block, blocks, byte_table, mix
from .steps import fresh, keyed, small_batches

TRAIN_ROWS = 6000
THRESHOLD = 0.3
PRIOR = 0.01
STEM_BYTES = (4, 5, 6, 7, 8)
#: a-z (after lower-casing), digits and every byte of a non-ASCII character
WORD_BYTES = byte_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])


@dataclass(frozen=True)
class Ftrl:
    """Step sizes, penalties, passes, and in how many texts a feature must occur."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.1
    passes: int = 6
    least_texts: int = 2


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (feature hashes, text of each) for every kind of feature."""
    start, end, first = block.words(WORD_BYTES)
    owner = np.repeat(np.arange(len(block)), np.diff(first))
    word = block.hashes(start, end)
    yield word, owner
    for stem in STEM_BYTES:
        long = end - start > stem
        yield ~block.hashes(start[long], start[long] + stem), owner[long]
    for offsets, salt in (((0, 1), 2), ((0, 1, 2), 3), ((0, 2), 4)):
        reach = offsets[-1]
        n = max(0, len(word) - reach)
        h = np.full(n, salt, dtype=np.uint64)
        for o in offsets:
            h = mix(h * np.uint64(0x100000001B3) + word[o : o + n])
        whole = owner[:n] == owner[reach : reach + n]
        yield h[whole], owner[:n][whole]


def _distinct(block: Block) -> list[np.ndarray]:
    """The distinct features of every text of the block."""
    keys, owner = (np.concatenate(x) for x in zip(*features(block)))
    order = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[order], np.arange(len(block) + 1))
    return [np.unique(keys[order[a:b]]) for a, b in zip(bounds[:-1], bounds[1:])]


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [k for block in blocks(batch.column(1)) for k in _distinct(block)]
        if rows:
            bounds = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
            values = pa.array(np.concatenate(rows).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(bounds), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], ["_id", "label", "keys"])


def fit(texts: list[np.ndarray], labels: np.ndarray, how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes with a weight, their weights, and the bias; texts in the given order."""
    all_keys = np.concatenate(texts) if texts else np.zeros(0, dtype=np.uint64)
    keys, counts = np.unique(all_keys, return_counts=True)
    del all_keys
    keys = keys[counts >= how.least_texts]
    indexed = []
    for t in texts:
        at = np.searchsorted(keys, t)
        at[at == len(keys)] = 0
        indexed.append(at[keys[at] == t] if len(keys) else at[:0])
    rate = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    bias = math.log(rate / (1 - rate))
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    bias_n = 1.0

    def weights(at):
        zi, ni = z[at], n[at]
        w = -(zi - np.sign(zi) * how.l1) / ((how.beta + np.sqrt(ni)) / how.alpha + how.l2)
        return np.where(np.abs(zi) <= how.l1, 0.0, w)

    for _ in range(how.passes):
        for at, y in zip(indexed, labels):
            w = weights(at)
            p = 1 / (1 + math.exp(-min(max(bias + float(w.sum()), -30.0), 30.0)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / how.alpha
            z[at] += g - sigma * w
            n[at] += g * g
            bias_n += g * g
            bias -= how.alpha / (how.beta + math.sqrt(bias_n)) * g
    w = weights(np.arange(len(keys)))
    used = w != 0
    return keys[used], w[used], bias


def _trainer(how: Ftrl):
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, texts = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            lists = batch.column(2)
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            bounds = lists.offsets.to_numpy()
            texts += [values[a:b].copy() for a, b in zip(bounds[:-1], bounds[1:])]
        if not ids:
            return
        order = np.argsort(mix(np.array(ids, dtype=np.int64).view(np.uint64)), kind="stable")
        keys, w, bias = fit([texts[i] for i in order], np.array(labels, dtype=float)[order], how)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*keys.view(np.int64), None], pa.int64()), pa.array([*w, bias], pa.float64())], ["key", "weight"]
        )

    return train


class Weights:
    """Feature hashes in order, their weights, a bit table that refuses most other hashes."""

    BITS = 22

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], bias
        self.bits = np.zeros(1 << self.BITS, dtype=bool)
        self.bits[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS)).astype(np.int64)

    def scores(self, block: Block) -> np.ndarray:
        """Probability of label 1 for every text of the block."""
        total = np.full(len(block), self.bias)
        if len(self.keys):
            pairs = []
            for h, owner in features(block):
                maybe = np.flatnonzero(self.bits[self._slot(h)])
                at = np.searchsorted(self.keys, h[maybe])
                at[at == len(self.keys)] = 0
                good = self.keys[at] == h[maybe]
                pairs.append(owner[maybe[good]] * len(self.keys) + at[good])
            seen = np.unique(np.concatenate(pairs))
            np.add.at(total, seen // len(self.keys), self.weights[seen % len(self.keys)])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    rows: int = TRAIN_ROWS,
    how: Ftrl = Ftrl(),
) -> Weights:
    """Learn from the labelled texts that are not held out, at most so many."""
    small_batches(docs.sparkSession)
    sample = (
        labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max((F.col("_label") != 0).cast("int")).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(rows)
    )
    model = (
        keyed(docs, id_col, text_col)
        .join(F.broadcast(sample), "_id")
        .dropDuplicates(["_id"])
        .mapInArrow(_feature_rows, "_id long, label int, keys array<long>")
        .repartition(1)
        .mapInArrow(_trainer(how), "key long, weight double")
        .collect()
    )
    bias = next((r["weight"] for r in model if r["key"] is None), math.log(PRIOR / (1 - PRIOR)))
    model = [r for r in model if r["key"] is not None]
    keys = np.array([r["key"] for r in model], dtype=np.int64).view(np.uint64)
    return Weights(keys, np.array([r["weight"] for r in model]), bias)


def score(docs: DataFrame, weights: Weights, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with one more column: the probability of label 1, from the text alone."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for block in blocks(batch.column(at)):
                out[block.first : block.first + len(block)] = shared.value.scores(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def keep_civil(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score stays below the threshold, all columns."""
    name = fresh(docs, "_score")
    scored = score(docs, train(docs, labels, id_col, text_col), text_col, name)
    return scored.where(F.col(name) < threshold).drop(name)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op2: the score of every document."""
    weights = train(docs, labels)
    return score(keyed(docs, "doc_id", "text"), weights, "_text").select(
        F.col("_id").alias("doc_id"),
        held_out("_id").alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
