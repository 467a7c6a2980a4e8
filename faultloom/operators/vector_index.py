"""A stored vector index: rows filed under the nearest of a set of centroids, searched list by list.

Centroids are fitted on a bounded sample (`SAMPLE` rows with the smallest hash of their id); every row is
filed. A search reads the lists whose centroids are nearest to the query and scores their rows exactly, so
similarities are those of vectors.vector_topk and only rows of other lists can be missed. How many lists to
read is measured when the index is made: so many that they hold `RECALL` of the sample's own neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import _meet, _unit

# rows that centroids are fitted on, and of these the ones whose neighbours are looked up
SAMPLE, JUDGED = 1 << 16, 512
# rows of the sample in a task that fits centroids
FIT_ROWS = 1 << 12
# most lists: their centroids go to every task
MOST_LISTS = 4096
# rows of a list that meet queries in one task
BLOCK_ROWS = 1 << 15
RECALL = 0.97


@dataclass(frozen=True)
class VectorIndex:
    """Rows (list, block, vec_id, vector), the lists with their centroids, and how many of them a search reads."""

    rows: DataFrame
    lists: DataFrame
    probes: int


def _nearest(centroids: np.ndarray, n: int):
    """Adds the n nearest lists of every vector, nearest first."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            order = np.argsort(-(_unit(f["vector"]) @ centroids.T), axis=1, kind="stable")[:, :n] if len(f) else []
            yield f.assign(lists=[list(map(int, o)) for o in order])

    return run


def _filed(df: DataFrame, id_name: str, centroids: np.ndarray, n: int) -> DataFrame:
    return df.mapInPandas(_nearest(centroids, n), f"{id_name} long, vector array<double>, lists array<int>")


def _shaped(df: DataFrame, id_name: str, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias(id_name), vector.alias("vector")).filter("vector is not null")


def write_index(
    vectors: DataFrame, root: str, id_col: str = "vec_id", vector_col: str = "embedding",
    lists: int | None = None, recall: float = RECALL, sample: int = SAMPLE, k: int = 10,
) -> VectorIndex:
    """File all vectors below root. lists: about the square root of the rows unless given. Null vectors are left out."""
    spark = vectors.sparkSession
    rows = _shaped(vectors, "vec_id", id_col, vector_col)
    total = rows.count()
    lists = min(MOST_LISTS, lists or max(1, math.isqrt(total)), max(1, total))
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).persist()
    try:
        judged = [r.vector for r in drawn.limit(min(sample, JUDGED * 8)).collect()]
        if judged and lists > 1:
            size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("size")
            tasks = -(-min(sample, total) // FIT_ROWS)
            # the first rows of all come in one partition; the length is a column, or every component would add it up
            spread = drawn.repartition(tasks, "vec_id") if tasks > 1 else drawn
            scaled = F.transform("vector", lambda x: F.when(F.col("size") > 0, x / F.col("size")).otherwise(x))
            unit = spread.select("vector", size).select(array_to_vector(scaled).alias("features"))
            centroids = _unit(KMeans(k=lists, seed=7, maxIter=10).fit(unit).clusterCenters())
        else:
            centroids = _unit(judged[:1] or [[1.0]])
    finally:
        drawn.unpersist()
    probes = _probes(_unit(judged), centroids, recall, k) if judged else 1
    filed = _filed(rows, "vec_id", centroids, 1).select(F.col("lists")[0].alias("list"), "vec_id", "vector")
    filed.repartitionByRange("list", "vec_id").sortWithinPartitions("list", "vec_id").write.parquet(f"{root}/rows")
    stored = spark.read.schema(filed.schema).parquet(f"{root}/rows")
    counts = stored.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    made = spark.createDataFrame([(i, [float(x) for x in v], probes) for i, v in enumerate(centroids)], "list int, centroid array<double>, probes int")
    made.join(counts, "list", "left").coalesce(1).write.parquet(f"{root}/lists")
    return open_index(spark, root)


def open_index(spark: SparkSession, root: str) -> VectorIndex:
    """An index that write_index wrote."""
    lists = spark.read.parquet(f"{root}/lists")
    return VectorIndex(spark.read.parquet(f"{root}/rows"), lists, lists.first().probes)


def _probes(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int) -> int:
    """Lists to read so that they hold that share of the sample's neighbours within the sample."""
    asked = sample[:JUDGED]
    near = asked @ sample.T
    near[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-near, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not best.size:
        return 1
    of = np.argmax(sample @ centroids.T, axis=1)
    place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1, kind="stable")
    return int(np.quantile(np.take_along_axis(place, of[best], axis=1), recall, method="higher")) + 1


def index_topk(
    index: VectorIndex, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    skip_same: bool = False, probes: int | None = None,
) -> DataFrame:
    """The k most similar rows in the lists nearest to each query: query_id, rank, vec_id, similarity.

    A list with many rows is cut into blocks; a task holds one block and the queries that read its list.
    """
    found = index.lists.orderBy("list").collect()  # at most MOST_LISTS
    centroids = np.array([r.centroid for r in found])
    blocks = index.lists.select("list", F.ceil(F.col("n") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")).filter("blocks > 0")
    asked = _filed(_shaped(queries, "query_id", id_col, vector_col), "query_id", centroids, min(probes or index.probes, len(found)))
    read = (
        asked.select("query_id", "vector", F.explode("lists").alias("list")).join(blocks, "list")
        .select("query_id", "vector", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )
    block = F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block")
    stored = index.rows.join(blocks, "list").select("list", block, "vec_id", "vector")
    met = read.groupBy("list", "block").cogroup(stored.groupBy("list", "block")).applyInPandas(
        _meet(k, skip_same), "query_id long, vec_id long, similarity double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)
