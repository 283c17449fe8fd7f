"""Exact top-k inner products by KD-trees over shards.

Rows are dealt to shards by a hash, queries to blocks; a cell is one block against one shard, so neither side meets the
other row by row in a join, and a cell holds a bounded number of rows. In a cell a KD-tree over the shard, split at
medians, has a tight box for each node; the box bounds the inner product with a query, nodes are visited best first,
and a query stops when no box can beat its k-th score. Each block first visits one shard; the k-th scores found there
are propagated to all its other cells as the bar to beat.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import materialize, table, tune

K, LEAF = 20, 128
SHARD_ROWS, BLOCK_QUERIES = 8192, 1024


class KdTree:
    """Median splits of the widest side; nodes in arrays, each with its rows' tight box and smallest id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows = np.arange(len(ids))
        ids, vectors = ids[order], vectors[order]
        self.low, self.high, self.first, self.spans, self.children = [], [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            own = self.rows[a:b]
            part = vectors[own]
            low, high = part.min(0), part.max(0)
            node = len(self.spans)
            self.low.append(low)
            self.high.append(high)
            self.first.append(int(ids[own].min()))
            self.spans.append((a, b))
            self.children.append([-1, -1])
            if parent >= 0:
                self.children[parent][side] = node
            wide = int((high - low).argmax())
            if b - a > LEAF and high[wide] > low[wide]:
                middle = (b - a) // 2
                self.rows[a:b] = own[np.argpartition(part[:, wide], middle)]
                stack += [(a, a + middle, node, 0), (a + middle, b, node, 1)]
        self.ids, self.vectors = ids[self.rows], vectors[self.rows]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The most that a row in each node's box can score with each query."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, own: int, bounds: np.ndarray, k: int, bar: tuple[int, int] | None) -> list[tuple[int, int]]:
        """(score, -id) of up to k best rows but the query's own that beat bar, (score, -id) too."""
        best: list[tuple[int, int]] = []
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if bar is not None and (-bound, -self.first[node]) <= bar:
                if -bound < bar[0]:
                    break
                continue
            left, right = self.children[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            a, b = self.spans[node]
            scores = self.vectors[a:b] @ query
            at = np.arange(b - a) if bar is None else np.flatnonzero(scores >= bar[0])
            at = at[self.ids[a:b][at] != own]
            if len(at) > 2 * k:
                at = at[np.lexsort((self.ids[a:b][at], -scores[at]))[:k]]
            for score, name in zip(scores[at].tolist(), self.ids[a:b][at].tolist(), strict=True):
                found = (int(score), -name)
                if bar is not None and found <= bar:
                    continue
                if len(best) < k:
                    heapq.heappush(best, found)
                else:
                    heapq.heappushpop(best, found)
                if len(best) == k and (bar is None or best[0] > bar):
                    bar = best[0]
        return best


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    m = flat.reshape(len(column), -1)
    exact = m.size == 0 or float(np.abs(m).max()) ** 2 * m.shape[1] < 2**52
    return m.astype(np.float64) if exact else m


def _searched(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            tree = KdTree(rows["vec_id"].to_numpy(), _matrix(rows["v"]))
            q = _matrix(queries["v"])
            if q.dtype != tree.vectors.dtype:
                q, tree.vectors, tree.low, tree.high = (x.astype(np.int64) for x in (q, tree.vectors, tree.low, tree.high))
            bounds = tree.bounds(q)
            for i, (own, score, name) in enumerate(zip(*(queries[c].to_pylist() for c in ("vec_id", "bar_score", "bar_id")), strict=True)):
                bar = None if score is None else (score, -name)
                out += [(own, -minus, s) for s, minus in tree.search(q[i], own, bounds[i], k, bar)]
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def prepared(vectors: DataFrame, factor: int) -> DataFrame:
    """vec_id and v, the components times factor rounded down; rows with a null id or vector, no component, or one that is null or not finite take no part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(F.lit(factor) * c.cast("double")).cast("long"))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = K, factor: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row where is_query holds, all if there are fewer.

    Ties go to the smaller vec_id. A row never finds rows of its own vec_id; vectors meet those of their own length only;
    of repeated rows each is a candidate; of several vectors with a query's vec_id the shortest, then smallest, is the query. An empty table gives no rows. Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    tune(spark)
    rows = materialize(prepared(vectors, factor).withColumn("dim", F.size("v")), "topk-rows")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("least")).select("vec_id", "least.v", "least.dim")
    shards = max(1, math.ceil(rows.count() / SHARD_ROWS))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)).cast("int"))
    home = F.col("block") % shards
    cell, found = ["dim", "shard", "block"], "query_id long, vec_id long, score long"

    def against(q: DataFrame, r: DataFrame) -> DataFrame:
        q, r = (x.select(*(F.col(c).alias(c) for c in x.columns)) for x in (q, r))  # both come from the same rows
        return q.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(_searched(k), found)

    at_home = rows.where(F.col("shard") < blocks).withColumn("block", F.explode(F.expr(f"filter(sequence(0, {blocks - 1}), b -> b % {shards} = shard)")))
    no_bar = queries.withColumn("shard", home).withColumn("bar_score", F.lit(None).cast("long")).withColumn("bar_id", F.lit(None).cast("long"))
    first = materialize(against(no_bar, at_home), "topk-first")
    if shards == 1:
        best = first
    else:
        bars = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("score", (-F.col("vec_id")).alias("minus"))).alias("last")).where(F.col("n") >= k)
        barred = queries.join(bars.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").select("vec_id", "v", "dim", "block", F.col("last.score").alias("bar_score"), (-F.col("last.minus")).alias("bar_id"))
        other = barred.withColumn("shard", F.explode(F.expr(f"filter(sequence(0, {shards - 1}), s -> s != block % {shards})")))
        everywhere = rows.withColumn("block", F.explode(F.expr(f"filter(sequence(0, {blocks - 1}), b -> b % {shards} != shard)")))
        best = first.unionByName(against(other, everywhere))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP5_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), queries AS (
  SELECT * FROM whole WHERE vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(v), v) = 1
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM queries q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
