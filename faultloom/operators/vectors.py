"""Exact vector search. Vectors are input; nothing here computes embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settle

# size of a block of vectors as Spark estimates it; two blocks meet in a task
BLOCK_BYTES = 16 << 20
# query and corpus vectors that are multiplied at once: 4 MB of scores
TILE_QUERIES, TILE_VECTORS = 256, 2048
# queries and documents of a block of blended scores; a task holds such a pair
BLEND_QUERIES, BLEND_DOCUMENTS = 1024, 2048
# most bands that text scores are cut into
BANDS = 8


def _unit(rows) -> np.ndarray:
    m = np.asarray(list(rows), dtype=np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _meet(k: int, skip_same: bool):
    """The k best of one corpus block for every query of one query block, tile by tile.

    The corpus is taken in order of its ids, so of equal scores the one found first stays, and a tile matters
    only where it is over the k-th best so far: few scores are left to sort.
    """

    def meet(queries: pd.DataFrame, corpus: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(corpus):
            corpus = corpus.sort_values("vec_id", kind="stable")
            vectors, vec_ids = _unit(corpus["vector"]), corpus["vec_id"].to_numpy()
            for a in range(0, len(queries), TILE_QUERIES):
                part = queries.iloc[a : a + TILE_QUERIES]
                matrix, query_ids = _unit(part["vector"]), part["query_id"].to_numpy()
                of, ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=vec_ids.dtype)
                scores, floor = np.empty(0), np.full(len(part), -np.inf)
                for b in range(0, len(vectors), TILE_VECTORS):
                    new_ids = vec_ids[b : b + TILE_VECTORS]
                    new = matrix @ vectors[b : b + TILE_VECTORS].T
                    if skip_same:
                        ends = [np.searchsorted(new_ids, query_ids, side) for side in ("left", "right")]
                        for i in np.flatnonzero((ends[1] > ends[0]) & (query_ids == query_ids)):
                            new[i, ends[0][i] : ends[1][i]] = -np.inf
                    rows, columns = _over(new, floor, k)
                    if not len(rows):
                        continue
                    # rounded so that the order of additions cannot decide a tie
                    of, ids = np.r_[of, rows], np.r_[ids, new_ids[columns]]
                    scores = np.r_[scores, np.round(new[rows, columns], 9)]
                    best = np.lexsort((ids, -scores, of))
                    first = np.searchsorted(of[best], np.arange(len(part)))
                    best = best[np.arange(len(best)) - first[of[best]] < k]
                    of, ids, scores = of[best], ids[best], scores[best]
                    full = np.flatnonzero(np.bincount(of, minlength=len(part)) == k)
                    floor[full] = scores[np.searchsorted(of, full) + k - 1]
                out.append(pd.DataFrame({"query_id": query_ids[of], "vec_id": ids, "similarity": scores}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})

    return meet


def _over(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the scores that can be among the k best of their row, where floor is the k-th so far.

    A rounded score is over the floor, itself rounded, only if the score is. Of a row with more than k such
    scores only those that round to the k-th of them or higher count.
    """
    over = scores > floor[:, None]
    many = np.flatnonzero(np.count_nonzero(over, axis=1) > k)
    if len(many):
        some = np.where(over[many], scores[many], -np.inf)
        kth = np.partition(some, some.shape[1] - k, axis=1)[:, -k]
        over[many] = some >= kth[:, None] - 2e-9
    return np.nonzero(over)


def _blocks(df: DataFrame, block_bytes: int) -> int:
    """Blocks of about that size, by the optimizer's estimate; runs no job. Spark has no estimate for
    rows made by code and then names a huge size; these go to as many blocks as a shuffle makes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, -(-size // block_bytes))


def vector_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    skip_same: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The k most similar corpus vectors (cosine) of every query: query_id, rank, vec_id, similarity.

    Exact. Both sides are dealt to blocks by a hash of their id; every pair of blocks meets in a
    task of its own, which holds these two blocks, and k rows per query and corpus block remain.
    """
    shape = lambda df, name: df.select(
        F.col(id_col).cast("long").alias(name), F.col(vector_col).alias("vector")
    ).filter(F.col("vector").isNotNull())
    asked, stored = shape(queries, "query_id"), shape(corpus, "vec_id")
    rows, columns = _blocks(asked, block_bytes), _blocks(stored, block_bytes)
    own = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("_row", own("query_id", rows)).withColumn("_column", every(columns))
    right = stored.withColumn("_column", own("vec_id", columns)).withColumn("_row", every(rows))
    # a pair is little to read and much to multiply: pairs that are few MB together must not share a task
    pairs = lambda df: df.repartition(2 * rows * columns, "_row", "_column").groupBy("_row", "_column")
    found = pairs(left).cogroup(pairs(right)).applyInPandas(
        _meet(k, skip_same), "query_id long, vec_id long, similarity double"
    )
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


_DOCUMENTS = "query_id long, document_id string, similarity double, relevance_score double, hybrid_score double"


def _blend(k: int, weight: float):
    """The k best blends of one block of documents for every query of one block of queries."""

    def meet(row) -> pd.DataFrame:
        names, at = np.unique(np.array(row.names, dtype=object), return_inverse=True)
        told = np.zeros(len(names))
        told[at] = [np.nan if x is None else x for x in row.scores]
        queries, known = np.asarray(row.asked, dtype=bool), np.asarray(row.held, dtype=bool)
        near = np.full((len(queries), len(names)), np.nan)
        if queries.any() and known.any():
            matrix = _unit(np.asarray(row.query_values, dtype=np.float64).reshape(queries.sum(), -1))
            stored = _unit(np.asarray(row.values, dtype=np.float64).reshape(known.sum(), -1))
            order = np.argsort(at[known], kind="stable")
            of = at[known][order]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            # rounded so that the order of additions cannot decide a tie; a document's best vector counts
            found = np.maximum.reduceat(np.round(matrix @ stored[order].T, 9), first, axis=1)
            near[np.ix_(queries, of[first])] = found
        score = np.round(np.nan_to_num(near) * weight + np.nan_to_num(told) * (1 - weight), 9)
        score[np.isnan(near) & np.isnan(told)[None, :]] = -np.inf
        best = np.argsort(-score, axis=1, kind="stable")[:, :k]
        take = lambda m: np.take_along_axis(np.broadcast_to(m, score.shape), best, axis=1).ravel()
        out = pd.DataFrame({
            "query_id": np.repeat(np.asarray(row.query_ids), best.shape[1]), "document_id": names[best.ravel()],
            "similarity": take(near), "relevance_score": take(told), "hybrid_score": take(score),
        })
        return out[np.isfinite(out["hybrid_score"])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                yield meet(row)

    return run


def _packed(df: DataFrame, size: int, own: str, ids: str, values: str, has: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows (text, id, vector) in blocks of about `size` by a hash of the id: one row per text and block."""
    c = F.col
    counts = df.groupBy("text").agg(F.countDistinct(own).alias("_n"))
    blocks = F.ceil(c("_n") / F.lit(size)).cast("int")
    dealt = df.join(counts, "text").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64(own), c("blocks")).cast("int"))
    rows = dealt.groupBy("text", "block", "blocks").agg(
        F.array_sort(F.collect_list(F.struct(own, *extra, c("vector").isNotNull().alias("has"), "vector"))).alias("_rows")
    )
    return rows.select(
        "text", "block", "blocks", c(f"_rows.{own}").alias(ids), c("_rows.has").alias(has),
        *[c(f"_rows.{x}").alias(f"{x}s") for x in extra],
        F.flatten(F.array_compact(c("_rows.vector"))).alias(values),
    )


def _round(queries: DataFrame, members: DataFrame, k: int, weight: float) -> DataFrame:
    """The k best members of its text for every query, each pair of blocks in a row of its own."""
    left = settle(_packed(queries, BLEND_QUERIES, "query_id", "query_ids", "query_values", "asked"), "queries")
    wanted = left.select("text", F.col("blocks").alias("rows")).distinct()
    right = settle(_packed(members.join(wanted.select("text"), "text", "left_semi"), BLEND_DOCUMENTS,
                           "document_id", "names", "values", "held", ("score",)), "members")
    other = right.select("text", F.col("blocks").alias("columns")).distinct()
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    pairs = left.join(other, "text").withColumnRenamed("block", "row").withColumn("column", each("columns")).drop("blocks", "columns")
    placed = right.join(wanted, "text").withColumnRenamed("block", "column").withColumn("row", each("rows")).drop("blocks", "rows")
    met = pairs.join(placed, ["text", "row", "column"]).drop("text", "row", "column")
    return met.mapInPandas(_blend(k, weight), _DOCUMENTS)


def blended_topk(
    queries: DataFrame, stored: DataFrame, said: DataFrame, k: int = 10, weight: float = 0.5
) -> DataFrame:
    """The k best blends of similarity and text score of every query, by a rank join.

    queries: query_id, query_text, vector; stored: document_id, vector; said: query_text, document_id,
    relevance_score. Exact. The documents that a text scores are taken in bands, highest scores first; each
    band meets the queries that ask for the text and are still open. A query closes when its k-th blend is
    over what a document of the next band could reach with a similarity of 1. Queries that stay open meet
    all vectors at the end; a document already seen there keeps its full score, which is no lower.
    A document's best vector counts.
    """
    c = F.col
    number = lambda name: F.when(~F.isnan(name), c(name)).alias(name)
    asked = settle(queries.select(c("query_id").cast("long").alias("query_id"), c("query_text").alias("text"),
                                  c("vector").cast("array<double>").alias("vector")), "queries")
    held = stored.filter(c("vector").isNotNull()).select("document_id", c("vector").cast("array<double>").alias("vector"))
    members = settle(
        said.select(c("query_text").alias("text"), "document_id", c("relevance_score").alias("score")).join(held, "document_id", "left"),
        "members",
    )
    tops = members.groupBy("score").count().agg(F.percentile_approx("score", [i / BANDS for i in range(1, BANDS + 1)], 10_000)).first()[0]
    tops = sorted(set(tops or []), reverse=True)
    best, open_ = None, asked
    rank = Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), "document_id")

    def merged(found: DataFrame) -> DataFrame:
        found = found.select("query_id", "document_id", number("similarity"), number("relevance_score"), "hybrid_score")
        full = F.max(F.struct("hybrid_score", "relevance_score", "similarity")).alias("m")
        rows = (found if best is None else best.drop("rank").unionByName(found)).groupBy("query_id", "document_id").agg(full)
        rows = rows.select("query_id", "document_id", "m.similarity", "m.relevance_score", "m.hybrid_score")
        return settle(rows.withColumn("rank", F.row_number().over(rank)).filter(c("rank") <= k), "best")

    for i, top in enumerate(tops):
        below = tops[i + 1] if i + 1 < len(tops) else None
        band = members.filter(c("score") <= top) if below is None else members.filter((c("score") <= top) & (c("score") > below))
        best = merged(_round(open_.filter(c("text").isNotNull()), band, k, weight))
        reach = weight + (1 - weight) * max(below or 0.0, 0.0) + 1e-8
        closed = best.filter((c("rank") == k) & (c("hybrid_score") > reach)).select("query_id")
        open_ = settle(open_.join(closed, "query_id", "left_anti"), "open")
    # one text for all, made from a column: an equality of constants would be planned as a nested loop
    same = lambda name: F.coalesce(F.substring(c(name).cast("string"), 1, 0), F.lit(""))
    everyone = held.filter("document_id is not null").withColumns({"text": same("document_id"), "score": F.lit(None).cast("double")})
    rest = open_.filter(c("vector").isNotNull()).withColumn("text", same("query_id"))
    best = merged(_round(rest, everyone, k, weight))
    return best.select("query_id", "rank", "document_id", "similarity", "relevance_score", "hybrid_score")
