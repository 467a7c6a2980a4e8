"""Hard-negative mining in integer vectors with sort-tile-recursive packed R-trees.

Rows are dealt to tasks by ranges of (label, widest coordinate, id) and packed there into trees of at most
`TREE_ROWS` rows: sorted by one coordinate, cut into slabs, each slab sorted by the next, down to leaves of
`LEAF` rows. A tree is stored as its rows in that order; `FAN` neighbours share a parent. The box of a node
gives an interval of inner products with an anchor, coordinate by coordinate. A search takes the box with the
highest upper end first and drops boxes outside the score window or strictly below the k-th score so far.

Anchors are a given share of all rows and meet every tree whose box can matter to them: trees of their label
for positives, trees whose interval meets a score window for negatives. A task holds one tree and streams the
anchors that visit it; k rows per anchor and tree remain.

Defined cases: rows with a null id or label, a null vector, or a null or non-finite component take no part.
Components are rounded down after scaling and held within +-2^24, so sums are exact. Shorter vectors count as
filled up with zeros. Every row is a row: repeated ones are found as often as they stand, an anchor never
finds rows of its own id as positives. Ties go by id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import settle, small_batches

TREE_ROWS, TREE_BYTES = 1 << 16, 32 << 20
#: rows a tree has at least, unless fewer trees than tasks would be left
TASK_ROWS = 1 << 10
LEAF, FAN = 64, 16
LARGEST = 1 << 24
_LOW, _HIGH = -(1 << 62), 1 << 62


# --- packing ------------------------------------------------------------------------

def _tiled(points: np.ndarray, rows: np.ndarray, dims: list[int]) -> list[np.ndarray]:
    """The rows in leaf order: slabs by the first coordinate, each tiled by the next ones."""
    leaves = -(-len(rows) // LEAF)
    if leaves <= 1 or not dims:
        return [rows]
    rows = rows[np.argsort(points[rows, dims[0]], kind="stable")]
    levels = min(len(dims), max(1, (leaves - 1).bit_length()))
    slabs = leaves if levels == 1 else max(2, int(np.ceil(leaves ** (1 / levels) - 1e-9)))
    size = -(-leaves // slabs) * LEAF
    return [r for a in range(0, len(rows), size) for r in _tiled(points, rows[a : a + size], dims[1:])]


def pack(labels: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The order of rows in a tree: by label, tiled within it by the coordinates that spread most."""
    rows = np.argsort(labels, kind="stable")
    dims = list(np.argsort(points.min(axis=0) - points.max(axis=0), kind="stable")) if len(rows) else []
    cuts = np.flatnonzero(np.diff(labels[rows])) + 1
    return np.concatenate([t for run in np.split(rows, cuts) for t in _tiled(points, run, dims)])


class Tree:
    """Rows in packed order, and for every level the boxes and labels of its nodes, leaves first."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray):
        exact = float(np.abs(points).max(initial=0)) * LARGEST * points.shape[1] < 1 << 53
        self.ids, self.labels = ids, labels
        self.points = points.astype(np.float64 if exact else np.int64)
        self.levels = []
        low, high, least, most = self.points, self.points, labels, labels
        size = LEAF
        while True:
            at = np.arange(0, len(low), size)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            least, most = np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((low, high, least, most))
            size = FAN
            if len(low) == 1:
                break

    def _bounds(self, level: int, a: int, b: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.levels[level][0][a:b], self.levels[level][1][a:b]
        return low @ up + high @ down, high @ up + low @ down

    def search(self, anchor: np.ndarray, label: int, own: int | None, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """Per window (low, high) the k best (score, id), score within it. own: the anchor's id, for rows of its
        label but that id; None: rows of other labels."""
        anchor = anchor.astype(self.points.dtype)
        up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
        found: list[list[tuple[int, int]]] = [[] for _ in windows]
        floor = np.array([w[0] for w in windows], dtype=np.int64)  # the least score that still counts
        ceiling = np.array([w[1] for w in windows], dtype=np.int64)
        queue: list[tuple[float, int, int]] = []

        def offer(level: int, a: int, b: int) -> None:
            low, high = self._bounds(level, a, b, up, down)
            least, most = self.levels[level][2][a:b], self.levels[level][3][a:b]
            fits = (least <= label) & (label <= most) if own is not None else (least != label) | (most != label)
            fits &= ((high[:, None] >= floor) & (low[:, None] <= ceiling)).any(axis=1)
            for i in np.flatnonzero(fits):
                heapq.heappush(queue, (-high[i], level, a + int(i)))

        offer(len(self.levels) - 1, 0, 1)
        while queue:
            best, level, node = heapq.heappop(queue)
            if -best < floor.min():
                break
            size = FAN if level else LEAF
            a = node * size
            if level:
                offer(level - 1, a, min(a + size, len(self.levels[level - 1][0])))
                continue
            part = slice(a, a + size)
            scores = self.points[part] @ anchor
            if own is not None:
                fits = (self.labels[part] == label) & (self.ids[part] != own)
            else:
                fits = self.labels[part] != label
            for w in range(len(windows)):
                for i in np.flatnonzero(fits & (scores >= floor[w]) & (scores <= ceiling[w])):
                    found[w].append((-int(scores[i]), int(self.ids[a + i])))
                if len(found[w]) > k:
                    found[w].sort()
                    del found[w][k:]
                if len(found[w]) == k:
                    floor[w] = max(floor[w], -max(found[w])[0])
        return [[(-s, i) for s, i in sorted(f)] for f in found]


# --- trees as a table -----------------------------------------------------------------

_TREES = (
    "tree long, rows long, ids binary, labels binary, points binary, low array<long>, high array<long>, kinds array<long>"
)
_TREES_ARROW = pa.schema([
    ("tree", pa.int64()), ("rows", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("points", pa.binary()),
    ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int64())),
])


def _matrix(lists: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows, filled up with zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), dims), dtype=np.int32)
    values = lists.flatten().to_numpy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _plant(dims: int, most: int):
    def tree(name: int, held: list) -> pa.RecordBatch:
        ids, labels, points = (np.concatenate(x) for x in zip(*held))
        order = pack(labels, points)
        ids, labels, points = ids[order], labels[order], points[order]
        row = dict(tree=name, rows=len(ids), ids=ids.tobytes(), labels=labels.tobytes(), points=points.tobytes(),
                   low=points.min(axis=0).tolist(), high=points.max(axis=0).tolist(), kinds=np.unique(labels).tolist())
        return pa.RecordBatch.from_pylist([row], schema=_TREES_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held, rows = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, most - rows)
                held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), dims)))
                a, rows = a + part.num_rows, rows + part.num_rows
                if rows == most:
                    yield tree(name, held)
                    name, held, rows = name + 1, [], 0
        if rows:
            yield tree(name, held)

    return run


def plant(vectors: DataFrame, tree_rows: int = TREE_ROWS) -> tuple[DataFrame, int]:
    """The trees of all rows vec_id, label, vector (array<long>), written as a table, and the length of vectors.

    No tree or box is dropped and no row is left out, however rows are spread over labels or coordinates.
    """
    spark = vectors.sparkSession
    spread = vectors.select(F.posexplode_outer("vector").alias("at", "x")).groupBy("at").agg(
        F.var_pop("x").alias("spread"), F.count(F.lit(1)).alias("n")
    ).collect()  # a row per coordinate
    coordinates = [r for r in spread if r["at"] is not None]
    dims = max((r["at"] for r in coordinates), default=0) + 1
    rows = max((r["n"] for r in coordinates), default=0)
    widest = max(coordinates, key=lambda r: (r["spread"], -r["at"]), default={"at": 0})["at"]
    most = max(LEAF, min(tree_rows, TREE_BYTES // (8 * dims)))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(-(-rows // most), min(tasks, -(-rows // TASK_ROWS)), 1)
    first = F.coalesce(F.get("vector", F.lit(widest)), F.lit(0))
    dealt = vectors.select("vec_id", "label", "vector").repartitionByRange(parts, "label", first, "vec_id")
    return settle(dealt.mapInArrow(_plant(dims, most), _TREES), "trees"), dims


# --- searching --------------------------------------------------------------------------

_FOUND = "anchor long, low long, high long, vec_id long, score long"


def _search(dims: int, k: int, same: bool):
    schema = pa.schema([("anchor", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, tree = None, None
        for batch in batches:
            out = []
            points = _matrix(batch.column("vector").fill_null([]), dims) if batch.num_rows else None
            for i, row in enumerate(batch.drop_columns(["vector"]).to_pylist()):
                if row["points"] is not None:
                    name = row["tree"]
                    tree = Tree(
                        np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64),
                        np.frombuffer(row["points"], np.int32).reshape(-1, dims),
                    )
                elif row["tree"] == name:
                    windows = [(_LOW, _HIGH)] if same else [(w["low"], w["high"]) for w in row["windows"]]
                    best = tree.search(points[i], row["label"], row["vec_id"] if same else None, windows, k)
                    for (low, high), hits in zip(windows, best):
                        out += [dict(anchor=row["anchor"], low=low, high=high, vec_id=v, score=s) for s, v in hits]
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _interval(low: str, high: str, largest: bool) -> Column:
    """The greatest or least inner product of the anchor's vector with a box."""
    pick = F.greatest if largest else F.least
    terms = F.zip_with(
        F.arrays_zip(F.col(low).alias("l"), F.col(high).alias("h")), F.col("vector"),
        lambda box, x: F.coalesce(pick(box["l"] * x, box["h"] * x), F.lit(0)),
    )
    return F.aggregate(terms, F.lit(0).cast("long"), lambda a, x: a + x)


def _visits(queries: DataFrame, trees: DataFrame, matters: Column) -> DataFrame:
    """Queries beside each tree where they matter. Only the trees' boxes take part, not their rows."""
    boxes = trees.select("tree", "low", "high", "kinds")
    numbered = settle(boxes.withColumn("number", F.row_number().over(Window.orderBy("tree"))), "boxes")
    every = F.explode(F.sequence(F.lit(1), F.lit(numbered.count()))).alias("number")
    return queries.select("*", every).join(numbered, "number").where(matters)


def _best(queries: DataFrame, trees: DataFrame, matters: Column, dims: int, k: int, same: bool) -> DataFrame:
    """anchor, low, high, vec_id, score: the k best of each anchor and window over all trees, with their rank."""
    columns = ["tree", "anchor", "vec_id", "label", "vector", *([] if same else ["windows"])]
    visits = _visits(queries, trees, matters).select(*columns)
    both = trees.select("tree", "ids", "labels", "points").unionByName(visits, allowMissingColumns=True)
    found = (
        both.repartition("tree").sortWithinPartitions("tree", F.col("points").isNull())
        .mapInArrow(_search(dims, k, same), _FOUND)
    )
    rank = F.row_number().over(Window.partitionBy("anchor", "low", "high").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
    tree_rows: int = TREE_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors and anchors: vec_id, label (long), vector (array<long>). An anchor's positives are the best rows
    of its label; a positive's negatives are the best rows of other labels whose score is from low to high
    percent of the positive's.
    """
    small_batches(vectors.sparkSession, 1024)
    c = F.col
    trees, dims = plant(vectors, tree_rows)
    if trees.isEmpty():
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    asked = settle(anchors.select("vec_id", "label", "vector", F.monotonically_increasing_id().alias("anchor")), "anchors")
    near = _best(asked, trees, F.array_contains("kinds", c("label")), dims, positives, True)
    near = settle(near.select("anchor", c("vec_id").alias("positive_id"), c("score").alias("positive_score")), "positives")

    # whole numbers: a least score rounds up, a greatest one down
    bottom = F.expr(f"-floor(-positive_score * {low} / 100BD)").cast("long")
    top = F.expr(f"floor(positive_score * {high} / 100BD)").cast("long")
    scopes = near.select("anchor", F.struct(bottom.alias("low"), top.alias("high")).alias("w")).where("w.low <= w.high")
    windows = scopes.groupBy("anchor").agg(F.collect_set("w").alias("windows"))
    queries = asked.join(windows, "anchor")
    other = (F.size("kinds") > 1) | (F.element_at("kinds", 1) != c("label"))
    queries = settle(queries, "queries")
    far = _best(queries, trees, other & _meets(), dims, negatives, False).select(
        "anchor", "low", "high", "rank", c("vec_id").alias("negative_id"), c("score").alias("negative_score")
    )
    return (
        near.withColumns({"low": bottom, "high": top}).join(far, ["anchor", "low", "high"]).join(asked.select("anchor", c("vec_id").alias("anchor_id")), "anchor")
        .select("anchor_id", "positive_id", c("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
    )


def _meets() -> Column:
    """Some window of the anchor meets the interval of the box."""
    return F.exists("windows", lambda w: (_interval("low", "high", True) >= w["low"]) & (_interval("low", "high", False) <= w["high"]))


def integers(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """vec_id, label, vector (array<long>) of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    whole = lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(v * scale))).cast("long")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.alias("vector"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    return kept.withColumn("vector", F.transform("vector", whole))


def report(embeddings: DataFrame) -> DataFrame:
    """op13: hard negatives of every hundredth row, with some labels moved on."""
    rows = integers(embeddings)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = settle(rows.withColumn("label", moved), "vectors")
    return mine(rows, rows.where("vec_id % 100 = 0"))
