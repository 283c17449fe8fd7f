"""Seeded draws as rows: what random.Random(seed) gives by choice() and shuffle(), made by many tasks.

A draw below a bound takes the leading bits of the stream's next number and rejects what isn't below it. So where a draw
stands in the stream depends on all rejections before it. Tasks make disjoint stretches of the stream, each reached by a
jump; a prefix sum over how many draws each stretch accepts tells with which draw the next one begins. Where the bound
itself falls from draw to draw, what a stretch accepts depends a little on where it begins: the counts are made again
until no beginning changes, and each time at least one stretch more is settled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import twister
from spanloom.sources.shared import fresh_path

#: Numbers of a stretch, unless there would be more than STRETCHES of them; numbers that a task holds at a time.
STRETCH, STRETCHES, SLICE = 1 << 18, 4096, 1 << 20


@dataclass(frozen=True)
class Run:
    """So many draws, the first below bound; falling: each bound is one less than that before."""

    draws: int
    bound: int
    falling: bool = False

    def numbers(self) -> float:
        """About how many numbers of the stream these draws take."""
        if not self.falling:
            return self.draws * 2.0 ** self.bound.bit_length() / self.bound
        total, high = 0.0, self.bound
        while high >= 2:
            low = max(2, 1 << (high.bit_length() - 1))
            total += 2.0 ** high.bit_length() * math.log((high + 0.5) / (low - 0.5))
            high = low - 1
        return total


def choices(n: int, times: int) -> list[Run]:
    """choice() from n elements, so many times."""
    return [Run(times, n)]


def shuffles(*sizes: int) -> list[Run]:
    """shuffle() of lists of these sizes, one after the other: draw t of a list of n goes below n - t."""
    return [Run(n - 1, n, True) for n in sizes if n > 1]


class Bounds:
    """The bound of each draw of a sequence of runs; behind the last one its bound stays."""

    def __init__(self, runs: list[Run]):
        if any(r.bound >= 1 << 32 for r in runs):
            raise ValueError("a bound of 2^32 or more takes two numbers a draw")
        self.ends = np.cumsum([r.draws for r in runs])
        self.begins = self.ends - [r.draws for r in runs]
        self.bound = np.array([r.bound for r in runs], dtype=np.int64)
        self.step = np.array([int(r.falling) for r in runs], dtype=np.int64)
        self.total = int(self.ends[-1])

    def at(self, t: np.ndarray) -> np.ndarray:
        t = np.minimum(t, self.total - 1)
        run = np.searchsorted(self.ends, t, "right")
        return self.bound[run] - self.step[run] * (t - self.begins[run])


def accepted(numbers: np.ndarray, first: int, bounds: Bounds) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the draws that a slice of the stream accepts when draw first is next, and their values.

    Draws are guessed and made again from the first wrong one on: at least one more is right each time.
    """
    numbers = numbers.astype(np.uint64)
    draw = first + np.arange(len(numbers), dtype=np.int64) * 3 // 4
    value, ok, at = np.zeros(len(numbers), dtype=np.int64), np.zeros(len(numbers), dtype=bool), 0
    while at < len(numbers):
        bound = bounds.at(draw[at:])
        value[at:] = numbers[at:] >> (32 - np.frexp(bound.astype(np.float64))[1]).astype(np.uint64)
        ok[at:] = value[at:] < bound
        true = draw[at] + np.cumsum(ok[at:]) - ok[at:]
        wrong = np.flatnonzero(true != draw[at:])
        draw[at:] = true
        at = at + int(wrong[0]) if len(wrong) else len(numbers)
    return draw[ok], value[ok]


@dataclass
class Stream:
    """How a seed's stream is dealt: stretches of size numbers, and the first draw of each."""

    seed: int
    bounds: Bounds
    size: int
    begins: list[int]

    def __post_init__(self):
        self.first, self.ladder = twister.seeded(self.seed), twister.ladder(self.size, len(self.begins))

    def slices(self, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Draws and values of stretch k, slice by slice."""
        numbers = twister.Numbers(twister.window_of(self.first, self.ladder, k))
        draw = self.begins[k]
        for at in range(0, self.size, SLICE):
            draws, values = accepted(numbers.next(min(SLICE, self.size - at)), draw, self.bounds)
            draw += len(draws)
            yield draws, values

    def rows(self, spark: SparkSession) -> DataFrame:
        """A row a stretch, one in a task as far as there are tasks."""
        n = len(self.begins)
        return spark.range(0, n, 1, min(n, max(spark.sparkContext.defaultParallelism, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))


def stream(spark: SparkSession, seed: int, runs: list[Run]) -> Stream:
    """The stream of a seed, dealt so that all draws of the runs are in it. The driver holds two numbers a stretch."""
    bounds = Bounds(runs)
    numbers = sum(r.numbers() for r in runs)
    while True:
        need = int(numbers + 8 * math.sqrt(numbers) + 64)
        size = min(need, max(STRETCH, -(-need // STRETCHES)))
        found = Stream(seed, bounds, size, [round(k * size / need * bounds.total) for k in range(-(-need // size))])
        while True:
            counts = dict(found.rows(spark).mapInArrow(_counting(found), "k long, n long").collect())
            begins = [0, *np.cumsum([counts[k] for k in range(len(counts))]).tolist()]
            settled, found.begins = begins[:-1] == found.begins, begins[:-1]
            if settled or len({(r.bound, r.falling) for r in runs}) == 1 and not runs[0].falling:
                break
        if begins[-1] >= bounds.total:
            return found
        numbers *= 2


def _counting(found: Stream):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([sum(len(d) for d, _ in found.slices(k)) for k in ks], pa.int64())], ["k", "n"])

    return run


def drawn(spark: SparkSession, seed: int, runs: list[Run]) -> DataFrame:
    """draw, value: all draws of the runs, numbered from 0."""
    if not sum(r.draws for r in runs):
        return spark.createDataFrame([], "draw long, value long")
    found = stream(spark, seed, runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                for draws, values in found.slices(k):
                    kept = draws < found.bounds.total
                    yield pa.RecordBatch.from_arrays([pa.array(draws[kept]), pa.array(values[kept])], ["draw", "value"])

    return found.rows(spark).mapInArrow(run, "draw long, value long")


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with place, numbered from 0 in order. They are written once, in range partitions; the driver holds a count for each of these.

    Rows of equal order follow one another as they come: order should name a key.
    """
    spark = rows.sparkSession
    path = fresh_path(spark, "placed")
    near = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    near.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(path)
    written = spark.read.parquet(path)
    counts = dict(written.groupBy("__part").count().collect())
    before = dict(zip(sorted(counts), [0, *np.cumsum([counts[p] for p in sorted(counts)]).tolist()], strict=False))
    if not before:
        return written.withColumn("place", F.lit(0).cast("long")).drop("__part", "__row")
    offset = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))[F.col("__part")]
    return written.withColumn("place", offset + F.col("__row")).drop("__part", "__row")


def shuffled_first(rows: DataFrame, key: str, first: Column, size: int, seed: int = 0) -> DataFrame:
    """size rows with drawn, numbered from 0: the rows where first holds, shuffled, and then the others, shuffled by the same generator.

    Each list is in the order of key before it is shuffled. Only the places that are asked for are followed back through
    the exchanges of a shuffle, from the last one to the first; each is met about log(n) times, so as often all
    exchanges are scanned. A null of first counts as false. The driver holds size places.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("__list", F.when(F.coalesce(first, F.lit(False)), 0).otherwise(1))
    counts = dict(marked.groupBy("__list").count().collect())
    sizes = [counts.get(0, 0), counts.get(1, 0)]
    all_of = placed(marked, "__list", key)
    draws = [max(0, n - 1) for n in sizes]
    path = fresh_path(spark, "exchanges")
    t, second = F.col("draw"), F.col("draw") >= draws[0]
    i = F.when(second, sizes[1] - 1 - (t - draws[0])).otherwise(sizes[0] - 1 - t)
    drawn(spark, seed, shuffles(*sizes)).select(second.cast("int").alias("list"), i.alias("i"), F.col("value").alias("j")).where("i != j").write.parquet(path)
    exchanges = spark.read.parquet(path)
    wanted = [(0, p) for p in range(min(size, sizes[0]))]
    wanted += [(1, p) for p in range(min(size - len(wanted), sizes[1]))]
    # the last exchange that a place p takes part in with its own turn is i = p
    place = {w: w[1] for w in wanted}
    own = exchanges.where(F.struct("list", "i").isin([F.struct(F.lit(a), F.lit(p).cast("long")) for a, p in wanted])) if wanted else exchanges.where("false")
    place |= {(r["list"], r["i"]): r["j"] for r in own.collect()}
    at = {w: w[1] for w in wanted}
    open_ = list(wanted)
    while open_:
        frontier = spark.createDataFrame([(a, p, place[a, p], at[a, p]) for a, p in open_], "list int, p long, j long, at long")
        met = exchanges.join(F.broadcast(frontier), ["list", "j"]).where("i > at").groupBy("list", "p").agg(F.min("i").alias("i"))  # size rows at most
        moved = {(r["list"], r["p"]): r["i"] for r in met.collect()}
        place |= moved
        at |= moved
        open_ = list(moved)
    chosen = spark.createDataFrame([(a, place[a, p] + (sizes[0] if a else 0), k) for k, (a, p) in enumerate(wanted)], "list int, place long, drawn int")
    return all_of.join(F.broadcast(chosen.drop("list")), "place").drop("place", "__list")


def replicate_sums(rows: DataFrame, key: str, columns: list[str], replicates: int, seed: int, resident: int = 1 << 20) -> tuple[DataFrame, int]:
    """replicate and the sums of columns over as many rows as there are, drawn with replacement, and the number of rows.

    Rows are in the order of key. A task holds a block of up to resident rows' numbers (8 bytes each), which it gets by a
    shuffle, makes its share of the stretches and adds up what they draw of its block. So with more blocks each stretch is
    made as often; the driver holds two numbers a stretch and no row.
    """
    spark = rows.sparkSession
    all_of = placed(rows.select(key, *columns), key)
    n = all_of.count()
    if not n:
        return spark.createDataFrame([], "replicate long, " + ", ".join(f"{c} long" for c in columns)), 0
    found = stream(spark, seed, choices(n, n * replicates))
    resident = max(64, resident)
    blocks, shares = -(-n // resident), min(len(found.begins), 2 * spark.sparkContext.defaultParallelism)
    task = (F.col("share") * blocks + F.floor(F.col("place") / resident)).cast("int")
    shared = all_of.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    dealt = shared.select(task.alias("task"), "place", *(F.col(c).cast("long").alias(c) for c in columns)).repartitionById(shares * blocks, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[x.to_numpy() for x in batch.columns] for batch in batches if batch.num_rows]
        if not held:
            return
        share, block = divmod(int(held[0][0][0]), blocks)
        first, count = block * resident, sum(len(x[0]) for x in held)
        table = np.empty((count, len(columns)), dtype=np.int64)
        while held:
            _, place, *figures = held.pop()
            table[place - first] = np.column_stack(figures)
        for k in range(share, len(found.begins), shares):
            for draws, values in found.slices(k):
                kept = (draws < found.bounds.total) & (values >= first) & (values < first + count)
                if kept.any():
                    of, begins = np.unique(draws[kept] // n, return_index=True)
                    sums = np.add.reduceat(table[values[kept] - first], begins, axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(of), *(pa.array(c) for c in sums.T)], ["replicate", *columns])

    parts = dealt.mapInArrow(run, "replicate long, " + ", ".join(f"{c} long" for c in columns))
    return parts.groupBy("replicate").agg(*(F.sum(c).alias(c) for c in columns)), n


def interval(values: Column, n: int, low: float = 0.025, high: float = 0.975) -> list[Column]:
    """Two of n collected values, in order: those at these shares of the last place, rounded down."""
    ordered = F.sort_array(F.collect_list(values))
    return [F.get(ordered, F.lit(int(q * (n - 1)))) for q in (low, high)]

