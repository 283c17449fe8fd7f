"""Retrieval of demonstrations by vectors: cosine top-K, reliability re-ranking, nearest members of groups.

A task holds one block of targets, and all demonstrations run past it in slices, multiplied as matrices; only each
target's best K stay. So the demonstrations are shuffled once a block of targets, and nothing else is but results.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import spans

BLOCK = 2048
#: Targets that a task of neighbours() holds at most: with their best K of 50, some 170 MB at 64 components.
HELD = 1 << 16
#: Targets and demos multiplied at a time, and pairs whose cosines are computed one by one at a time.
ROWS, SLICE, PAIRS = 256, 1 << 14, 1 << 17
#: By how much a product of matrices in single precision can miss the cosine of two unit vectors, for each component; what lies that near is computed one by one.
SLACK = 2.0**-22


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.array([np.linalg.norm(x) for x in m])[:, None]


class _Best:
    """The k best demos so far of each target of a block, by cosine and then id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, leave_one_out: bool):
        self.ids, self.own, self.k, self.apart = ids, _unit(vectors), k, leave_one_out
        self.single = self.own.astype(np.float32)
        self.cosine, self.demo = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.slack = SLACK * (self.own.shape[1] + 8)

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        d = _unit(vectors)
        single, order = d.astype(np.float32), np.argsort(ids, kind="stable")
        for at in range(0, len(self.ids), ROWS):
            part = slice(at, at + ROWS)
            near = self.single[part] @ single.T
            if self.apart:
                first, last = (np.searchsorted(ids[order], self.ids[part], side) for side in ("left", "right"))
                for i in np.flatnonzero(last > first):
                    near[i, order[first[i] : last[i]]] = -np.inf
            # the k-th best of what a target has, or of this slice, is reached by what may stay
            least = self.cosine[part, -1] - self.slack
            if np.isneginf(least).any() and len(ids) > self.k:
                few = np.flatnonzero(np.isneginf(least))
                least[few] = np.partition(near[few], len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2 * self.slack
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            t, j = np.nonzero(near >= np.maximum(least, np.float32(-2))[:, None])  # left out by -inf
            # whole targets at a time; one target has a slice of pairs at most
            ends = np.searchsorted(t, np.arange(len(near)), "right")
            begin = 0
            while begin < len(t):
                end = int(ends[max(t[begin], int(np.searchsorted(ends, begin + PAIRS, "right")) - 1)])
                self._keep(at + t[begin:end], j[begin:end], ids, d)
                begin = end

    def _keep(self, t: np.ndarray, j: np.ndarray, ids: np.ndarray, d: np.ndarray) -> None:
        # one product at a time: equal vectors then have equal cosines, wherever they stand in a matrix
        cosine, demo = np.vecdot(self.own[t], d[j]), ids[j]
        met = np.unique(t)
        t = np.concatenate([t, np.repeat(met, self.k)])
        cosine, demo = np.concatenate([cosine, self.cosine[met].ravel()]), np.concatenate([demo, self.demo[met].ravel()])
        order = np.lexsort((demo, -cosine, t))
        place = np.arange(len(order)) - np.searchsorted(t[order], t[order])
        kept = order[place < self.k]  # each target had k places before, so it has k now
        self.cosine[met], self.demo[met] = cosine[kept].reshape(-1, self.k), demo[kept].reshape(-1, self.k)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.ids), ROWS):
            there = self.cosine[at : at + ROWS] > -np.inf
            n = there.sum(1)
            rank = np.broadcast_to(np.arange(1, self.k + 1, dtype=np.int32), there.shape)
            columns = (np.repeat(self.ids[at : at + ROWS], n), self.demo[at : at + ROWS][there], self.cosine[at : at + ROWS][there], rank[there], np.repeat(n, n))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["target", "demo", "similarity", "neighbor_rank", "there"])


def _past(k: int, leave_one_out: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (block, is_demo, id, v) in the order of block, its targets first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, best, slices = None, [], None, []

        def met() -> None:
            nonlocal best, held, slices
            if best is None and held:
                best, held = _Best(*_joined(held), k, leave_one_out), []
            if best is not None and slices:
                best.meet(*_joined(slices))
            slices = []

        for batch in batches:
            blocks, is_demo = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("block", "is_demo"))
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (is_demo[1:] != is_demo[:-1])) + 1
            for a, b in itertools.pairwise([0, *cuts.tolist(), len(blocks)]):
                if a == b:
                    continue
                if blocks[a] != block:
                    met()
                    if best is not None:
                        yield from best.rows()
                    block, held, best = blocks[a], [], None
                part = batch.slice(a, b - a)
                vectors = part.column("v")
                found = part.column("id").to_numpy(), vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
                if not is_demo[a]:
                    held.append(found)
                elif held or best is not None:
                    for c in range(0, b - a, SLICE):
                        slices.append(tuple(x[c : c + SLICE] for x in found))
                        if sum(len(x[0]) for x in slices) >= SLICE:
                            met()
        met()
        if best is not None:
            yield from best.rows()

    return run


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    ids, vectors = zip(*parts, strict=True)
    return np.concatenate(ids), np.concatenate(vectors).astype(np.float64)


def neighbours(targets: DataFrame, demos: DataFrame, k: int = 50, leave_one_out: bool = True, complete: bool = False) -> DataFrame:
    """target, demo, similarity, neighbor_rank: the k most similar demos (id, v) of each target (id, v).

    The cosine is in double precision and ranks as it is, without rounding; ties go to the smaller id. A vector is
    valid, see checks.finite_vector_ok. A target with fewer than k demos keeps what there is, unless they must be complete:
    then it is an error. Every target meets every demo. Targets are dealt to blocks of some HELD at most, and to more of
    BLOCK at least as long as there are cores without one; the demos are shuffled once for each block.
    """
    spark = targets.sparkSession
    n = targets.count()
    blocks = max(1, math.ceil(n / HELD), min(math.ceil(n / BLOCK), 2 * spark.sparkContext.defaultParallelism))
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    rows = [x.select(block.alias("block"), F.lit(is_demo).alias("is_demo"), "id", "v") for x, block, is_demo in ((targets, own, False), (demos, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), True))]
    dealt = rows[0].unionByName(rows[1]).repartitionById(blocks, "block").sortWithinPartitions("block", "is_demo")
    found = dealt.mapInArrow(_past(k, leave_one_out), "target long, demo long, similarity double, neighbor_rank int, there long")
    if complete:
        short = F.raise_error(F.concat(F.lit("target "), F.col("target").cast("string"), F.lit(" has only "), F.col("there").cast("string"), F.lit(f" demos of {k}"))).cast("int")
        found = found.withColumn("neighbor_rank", F.when(F.col("there") >= k, F.col("neighbor_rank")).otherwise(short))
    return found.drop("there").where(F.col("neighbor_rank") <= k)


def reranked(found: DataFrame, reliability: DataFrame, k: int = 16) -> DataFrame:
    """found with reliability and selected_rank: among the neighbours the k most reliable, then most similar, then smallest id; others null."""
    both = found.join(reliability, "demo")
    order = Window.partitionBy("target").orderBy(F.col("reliability").desc(), F.col("similarity").desc(), "demo")
    rank = F.row_number().over(order)
    return both.withColumn("selected_rank", rank).withColumn("selected_rank", F.when(F.col("selected_rank") <= k, F.col("selected_rank")))


def _nearest_cell(candidates: pa.Table, tokens: pa.Table) -> pa.Table:
    out = ([], [], [], [])
    if candidates.num_rows and tokens.num_rows:
        ids = tokens["token"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, w = ids[order], _matrix(tokens["v"])[order]
        for name, v in zip(candidates["candidate"].to_pylist(), _matrix(candidates["v"]), strict=True):
            distance = np.sqrt(((w - v) ** 2).sum(1))
            at = int(distance.argmin())
            out[1].append(name)
            out[2].append(float(distance[at]))
            out[3].append(int(ids[at]))
        out[0].extend(candidates["group"].to_pylist())
    kinds = (candidates.schema.field("group").type, pa.int64(), pa.float64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["group", "candidate", "distance", "token"])


def nearest_in_group(candidates: DataFrame, tokens: DataFrame, k: int = 5) -> DataFrame:
    """group, candidate, distance, token, rank: each candidate's nearest token (first on ties), and the k nearest candidates of a group.

    Candidates rank by their distance as it is, then by candidate_rank, where they have that column, then by name.

    candidates (group, candidate, v) and tokens (group, token, v) meet within their group only. A group's tokens are
    dealt to the blocks that its size needs, so a cell is bounded and gives one row a candidate, not one a pair. The
    distance is Euclidean.
    """
    t_blocks = tokens.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("tbs"))
    c_blocks = candidates.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("cbs"))
    blocks = t_blocks.join(c_blocks, "group")
    deal = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = candidates.join(blocks, "group").withColumn("cb", deal("candidate", "cbs")).withColumn("tb", every("tbs")).select("group", "candidate", "v", "cb", "tb")
    t = tokens.join(blocks, "group").withColumn("tb", deal("token", "tbs")).withColumn("cb", every("cbs")).select("group", "token", "v", "cb", "tb")
    n = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cell = ["group", "cb", "tb"]
    c, t = (x.select(*(F.col(y).alias(y) for y in x.columns)).repartition(n, *cell) for x in (c, t))
    group = dict(candidates.dtypes)["group"]
    near = c.groupBy(*cell).cogroup(t.groupBy(*cell)).applyInArrow(_nearest_cell, f"group {group}, candidate long, distance double, token long")
    best = near.groupBy("group", "candidate").agg(F.min(F.struct("distance", "token")).alias("best")).select("group", "candidate", "best.distance", "best.token")
    ranked = "candidate_rank" in candidates.columns
    if ranked:
        best = best.join(candidates.select("group", "candidate", "candidate_rank"), ["group", "candidate"])
    order = Window.partitionBy("group").orderBy("distance", *["candidate_rank"] * ranked, "candidate")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pooled(words: DataFrame, pieces: DataFrame, key: str) -> DataFrame:
    """key, start, end, v: each word's mean of the vectors of the pieces that overlap it; words without a piece are left out.

    words (key, start, end) and pieces (key, p_start, p_end, v) meet within the same stretch of a sentence. A word's sums
    are made from elements, so no array of arrays is gathered.
    """
    met = spans.interval_join(words, pieces, key, ("start", "end"), ("p_start", "p_end"))
    each = met.select(key, "start", "end", F.posexplode("v").alias("__at", "__x")).groupBy(key, "start", "end", "__at").agg(F.avg("__x").alias("__x"))
    return each.groupBy(key, "start", "end").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "__x"))), lambda s: F.round(s["__x"], 9)).alias("v"))
