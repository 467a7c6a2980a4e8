"""Language identification: a byte convolutional network in numpy.

Filters of several widths run over one-hot bytes: a filter is one table of 256 weights for each of
its places, so a convolution is a sum of table rows. The largest response of every filter in a
window of WINDOW bytes is kept, cut off at zero, and a softmax layer reads the languages from these.
A text is all its windows; its language has the largest probability summed over windows by their
bytes. Training goes over at most TRAIN_TEXTS labelled texts, those with the smallest id hash, and
at most WINDOWS_PER_TEXT evenly spread windows of each, in one task; prediction is one pass without
a shuffle over whole texts.

Defined cases: a null text, or one without a letter, is UNDETERMINED with score 0. A language of
null or '' is no label. Of several labels of equal ids each row counts. Rows with a null id are
predicted, not held out and never learnt from. Without any labelled text everything is
UNDETERMINED. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import Block, blocks
from .steps import small_batches

UNDETERMINED = "und"
#: labelled texts learnt from, whole
TRAIN_TEXTS = 2000
WINDOW = 256
WIDTHS = (5, 4, 3, 2)  # wide first: the first places belong to all filters, later ones to fewer
FILTERS = 8  # of each width
REACH = WIDTHS[0] - 1
_AT_ONCE = 64  # windows


@dataclass
class Network:
    """tables[j]: weights of place j, for the filters that are wide enough; the first columns of all."""

    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    @staticmethod
    def fresh(languages: list[str], rng: np.random.Generator) -> "Network":
        counts = [FILTERS * sum(w > j for w in WIDTHS) for j in range(WIDTHS[0])]
        tables = [rng.normal(0, 0.3, (256, n)).astype(np.float32) for n in counts]
        every = FILTERS * len(WIDTHS)
        return Network(
            languages, tables, np.zeros(every, np.float32), rng.normal(0, 0.3, (every, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        )

    def responses(self, windows: np.ndarray) -> np.ndarray:
        """Filter responses at every place of windows (n, WINDOW + REACH)."""
        out = self.tables[0][windows[:, :WINDOW]]
        for j, table in enumerate(self.tables[1:], 1):
            out[:, :, : table.shape[1]] += table[windows[:, j : j + WINDOW]]
        return out

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(windows).max(axis=1) + self.bias, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self.pooled(windows[i : i + _AT_ONCE]) for i in range(0, len(windows), _AT_ONCE)]
        return _softmax(np.concatenate(parts) @ self.weights + self.offset)


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (0 beyond the end of a text), the text of each, and how many of its bytes it starts."""
    count = -(-np.diff(block.bounds) // WINDOW)
    text = np.repeat(np.arange(len(block)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = block.bounds[text] + k * WINDOW
    place = start[:, None] + np.arange(WINDOW + REACH)
    inside = place < block.bounds[text + 1][:, None]
    padded = np.append(block.data, np.zeros(1, dtype=np.uint8))
    return np.where(inside, padded[np.minimum(place, len(block.data))], 0), text, np.minimum(block.bounds[text + 1] - start, WINDOW)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 3, seed: int = 7) -> Network:
    """Adam on the cross entropy; windows in the given order, shuffled by the seed."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(languages, rng)
    params = [*net.tables, net.bias, net.weights, net.offset]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, rate = 0, 0.01
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), _AT_ONCE):
            x, y = windows[order[at : at + _AT_ONCE]], labels[order[at : at + _AT_ONCE]]
            n = len(x)
            raw = net.responses(x)
            where = raw.argmax(axis=1)
            top = np.take_along_axis(raw, where[:, None, :], axis=1)[:, 0, :] + net.bias
            hidden = np.maximum(top, 0)
            p = _softmax(hidden @ net.weights + net.offset)
            p[np.arange(n), y] -= 1
            p /= n
            back = (p @ net.weights.T) * (top > 0)
            grads = []
            rows = np.arange(n)[:, None]
            for j, table in enumerate(net.tables):
                m = table.shape[1]
                g = np.zeros_like(table)
                np.add.at(g, (x[rows, where[:, :m] + j], np.arange(m)), back[:, :m])
                grads.append(g)
            grads += [back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, s in zip(params, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        rate *= 0.6
    return net


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pickle

    rows = []
    for batch in batches:
        ids, langs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for block in blocks(batch.column(1), lower=False):
            x, text, _ = windows_of(block)
            rows += [(ids[block.first + t], i, langs[block.first + t], w) for i, (t, w) in enumerate(zip(text, x))]
    if rows:
        rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r[1]))
        languages = sorted({r[2] for r in rows})
        labels = np.array([languages.index(r[2]) for r in rows])
        net = fit(np.array([r[3] for r in rows]), labels, languages)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], ["net"])


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """The network, a few hundred kilobytes whatever the corpus; None without labelled texts."""
    import pickle

    small_batches(docs.sparkSession)
    labelled = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    ).where(F.col("_id").isNotNull() & (F.col("_lang") != "") & F.col("_text").rlike(r"\p{L}") & ~held_out("_id"))
    # ids first, so that no more texts move than are learnt from
    chosen = labelled.select("_id").orderBy(F.xxhash64("_id"), "_id").limit(TRAIN_TEXTS)
    found = (
        labelled.join(F.broadcast(chosen.distinct()), "_id", "left_semi").repartition(1).mapInArrow(_trainer, "net binary").collect()
    )
    return pickle.loads(found[0]["net"]) if found else None


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, lang_pred, score of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, -1), np.zeros(n)
            for block in blocks(batch.column(1), lower=False) if net else ():
                x, text, size = windows_of(block)
                if len(x):
                    total = np.zeros((len(block), len(net.languages)))
                    np.add.at(total, text, net.probabilities(x) * size[:, None])
                    full = total.sum(axis=1)
                    rows = block.first + np.flatnonzero(full > 0)
                    part = total[full > 0] / full[full > 0][:, None]
                    best[rows], score[rows] = part.argmax(axis=1), part.max(axis=1)
            names = np.array([*(net.languages if net else []), UNDETERMINED], dtype=object)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names[best], pa.string()), pa.array(score)],
                                             ["_id", "letters", "lang", "p"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"),
        F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("letters"),
    )
    out = rows.mapInArrow(run, "_id long, letters boolean, lang string, p double")
    return out.select(
        "_id", F.when(F.col("letters"), F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letters"), F.least("p", F.lit(1.0))).otherwise(0.0).alias("score"),
    )


def report(docs: DataFrame) -> DataFrame:
    """op3: the predicted language of every document."""
    return predict(docs, train(docs)).select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "lang_pred", "score")
