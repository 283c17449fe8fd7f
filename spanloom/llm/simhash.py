"""SimHash near-duplicates by binary tries of fingerprints joined with themselves.

Fingerprints link at MOST_BITS or fewer differing bits. Such a pair agrees on one of MOST_BITS + 1 blocks of bits, so
each fingerprint enters MOST_BITS + 1 tries, rotated so that a block comes first, and a task holds the subtree below
one block value. In it pairs of nodes are traversed together, level by level: differing bits add up along the way, and
a pair is pruned when they exceed the budget; small nodes are compared row by row. Subtrees with very many fingerprints are split by further bits into
pairs of subtrees whose prefixes differ by no more than the budget. A task reports a spanning forest of its links; a
star contraction joins them into components. Exact copies are one fingerprint all along and rejoin at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, table, text_udf, tune

SEED, SHINGLE, MOST_BITS = 42, 3, 2
#: First bit and width of each block, from the top.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints of a subtree from which it is split, and bits by which it is split at most.
CELL, SPLIT_BITS = 4096, 12
#: Node pairs that are traversed at a time, and pairs of rows up to which two nodes are compared row by row.
FRONT, LEAF = 50_000, 32
#: Node pairs of LEAF or fewer whose rows are compared at a time, and pairs that are found before they are given out.
LEAVES, HELD = 1 << 12, 1 << 12
#: Pairs that are joined to trees at a time.
JOINED = 1 << 16
#: Rows whose bits are added up at a time, as counts of a byte.
SLICE = 255


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included. Words between ASCII white space, A-Z in lower case; shingles of width words, or all words if fewer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined, width, digest = b" ".join(words), min(width, len(words)), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - width + 1]
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), dtype="<u8", count=len(starts))


class Majority:
    """The bits that are set in over half of all rows of hashes."""

    def __init__(self, words: int = 1):
        self.rows, self.counts = 0, np.zeros(64 * words, dtype=np.int64)

    def add(self, hashes: np.ndarray) -> Majority:
        """hashes: (rows, words)."""
        self.rows += len(hashes)
        for at in range(0, len(hashes), SLICE):
            bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + SLICE]).view(np.uint8), axis=1, bitorder="little")
            self.counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
        return self

    def words(self) -> np.ndarray:
        return np.packbits(2 * self.counts > self.rows, bitorder="little").view("<u8")


def fingerprint(text: str | None) -> int:
    """Unsigned; zero for a text without words."""
    return int(Majority().add(shingle_hashes(text)[:, None]).words()[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprinter():
    """Column function: text to its fingerprint as a signed long. A null text has the fingerprint zero."""
    return text_udf(lambda: lambda texts: [_signed(fingerprint(t)) for t in texts], "long", pa.int64())


class Forest:
    """Trees of n rows that pairs join one by one: the joins so far, and each row's tree."""

    def __init__(self, n: int):
        self.root, self.tree, self.joins = list(range(n)), np.arange(n), []
        self.changes = np.arange(n)

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def add(self, pairs: np.ndarray) -> None:
        before = len(self.joins)
        for x, y in pairs[self.tree[pairs[:, 0]] != self.tree[pairs[:, 1]]].tolist():
            i, j = self.top(x), self.top(y)
            if i != j:
                self.root[max(i, j)] = min(i, j)
                self.joins.append((x, y))
        if len(self.joins) > before:
            self.tree = np.array([self.top(i) for i in range(len(self.root))])
            self.changes = np.append(0, np.cumsum(self.tree[1:] != self.tree[:-1]))

    def apart(self, nodes: np.ndarray) -> np.ndarray:
        """The pairs of nodes (a, b, c, d, _), whose rows are a to b and c to d, that one tree doesn't hold yet."""
        a, b, c, d = nodes.T[:4]
        return nodes[(self.changes[a] != self.changes[b - 1]) | (self.changes[c] != self.changes[d - 1]) | (self.tree[a] != self.tree[c])]


def _traverse(keys: np.ndarray, first_bit: int, budget: int | np.ndarray, left: int | None, spent: int, more: np.ndarray | None, most: int, take: Callable[[np.ndarray], None], forest: Forest | None = None) -> None:
    """Gives take() the pairs of trie_links(), some at a time; with a forest only those that it doesn't hold in one tree by then."""
    n = len(keys)
    allowed = np.broadcast_to(budget, 65)
    found, held = [], 0

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        nonlocal found, held
        if forest:
            open_ = forest.tree[x] != forest.tree[y]
            x, y = x[open_], y[open_]
        differ = np.bitwise_count(keys[x] ^ keys[y])
        near = (x < y) & (differ <= allowed[64])
        x, y = x[near], y[near]
        if more is not None:
            near = differ[near] + np.bitwise_count(more[x] ^ more[y]).sum(1, dtype=np.int64) <= most
            x, y = x[near], y[near]
        found.append(np.column_stack([x, y]))
        held += len(x)
        if held >= HELD:
            take(np.concatenate(found))
            found, held = [], 0

    start = np.array([[0, n, 0, n, spent]] if left is None else [[0, left, left, n, spent]], dtype=np.int64)
    stack = [(first_bit, start)]
    zeros: dict[int, np.ndarray] = {}
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONT:
            stack += [(depth, pairs[FRONT:]), (depth, pairs[:FRONT])]
            continue
        if forest:
            pairs = forest.apart(pairs)
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        leaves = pairs[small]
        for i in range(0, len(leaves), LEAVES):
            some = leaves[i : i + LEAVES]
            a, b, c, d, _ = (forest.apart(some) if forest else some).T
            many = (b - a) * (d - c)
            at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            wide = np.repeat(d - c, many)
            compare(np.repeat(a, many) + at // wide, np.repeat(c, many) + at % wide)
        if depth == 64:  # equal keys
            for node in pairs[~small]:
                if forest and not len(forest.apart(node[None])):
                    continue
                i, j, k, m, _ = node.tolist()
                step = max(1, LEAVES * LEAF // (m - k))
                for x in range(i, j, step):
                    rows = np.arange(x, min(x + step, j))
                    compare(np.repeat(rows, m - k), np.tile(np.arange(k, m), len(rows)))
            continue
        a, b, c, d, e = pairs[~small].T
        if not len(a):
            continue
        if depth not in zeros:
            bit = (keys >> np.uint64(63 - depth)) & np.uint64(1)
            zeros[depth] = np.append(0, np.cumsum(bit == 0))
        z = zeros[depth]
        p, q = a + z[b] - z[a], c + z[d] - z[c]
        own = a == c
        other = ~own
        below = [np.column_stack([a, p, c, q, e]), np.column_stack([p, b, q, d, e])]
        below += [np.column_stack([a, p, q, d, e + 1]), np.column_stack([p[other], b[other], c[other], q[other], e[other] + 1])]
        below = np.concatenate(below)
        below = below[(below[:, 4] <= allowed[depth + 1]) & (below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])]
        if len(below):
            stack.append((depth + 1, below))
    if held:
        take(np.concatenate(found))


def trie_links(keys: np.ndarray, first_bit: int, budget: int | np.ndarray = MOST_BITS, left: int | None = None, spent: int = 0, more: np.ndarray | None = None, most: int = 0) -> np.ndarray:
    """Pairs of positions in keys, sorted, that differ in budget bits or fewer; with an array, in budget[d] at most among the first d bits.

    All keys share the bits above first_bit; or, if left is given, the first left keys share theirs, the others theirs,
    both differ in spent bits there, and only pairs across are wanted. If keys have more words behind them (rows, words),
    most bits may differ in all.
    """
    found = [np.zeros((0, 2), dtype=np.int64)]
    _traverse(keys, first_bit, budget, left, spent, more, most, found.append)
    return np.concatenate(found)


def trie_forest(keys: np.ndarray, first_bit: int, budget: int | np.ndarray = MOST_BITS, left: int | None = None, spent: int = 0, more: np.ndarray | None = None, most: int = 0) -> list[tuple[int, int]]:
    """Some of the pairs of trie_links() that join the same rows to trees, without holding them all: what a tree holds isn't met again."""
    forest = Forest(len(keys))
    _traverse(keys, first_bit, budget, left, spent, more, most, forest.add, forest)
    return forest.joins


def spanning(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The pairs that join two trees when they are added one by one."""
    forest = Forest(n)
    for at in range(0, len(pairs), JOINED):
        forest.add(pairs[at : at + JOINED])
    return forest.joins


def _turned(bits: int):
    """fp with the bits from there on first."""
    return F.col("fp") if not bits else F.shiftleft("fp", bits).bitwiseOR(F.shiftrightunsigned("fp", 64 - bits))


def _cells(fps: DataFrame) -> DataFrame:
    """trie, block, extra, low, mask, key: each fingerprint in each cell where it may have partners."""
    tries = fps.select(F.explode(F.array(*(F.struct(F.lit(t).alias("trie"), F.lit(w).alias("width"), _turned(s).alias("key")) for t, (s, w) in enumerate(BLOCKS)))).alias("t")).select("t.*")
    tries = tries.withColumn("block", F.expr("shiftrightunsigned(key, 64 - width)"))
    sizes = tries.groupBy("trie", "block").agg(F.count("*").alias("n")).where("n > 1")
    tries = tries.join(sizes, ["trie", "block"])
    extra = F.least(F.lit(SPLIT_BITS), F.when(F.col("n") > CELL, F.ceil(F.log2(F.col("n") / CELL))).otherwise(0)).cast("int")
    masks = [sorted(sum(1 << i for i in c) for k in range(MOST_BITS + 1) for c in combinations(range(bits), k)) for bits in range(SPLIT_BITS + 1)]
    all_masks = F.array(*(F.array(*map(F.lit, m)).cast("array<long>") for m in masks))
    split = tries.withColumn("extra", extra).withColumn("prefix", F.expr("case when extra = 0 then 0L else shiftrightunsigned(shiftleft(key, width), 64 - extra) end"))
    split = split.withColumn("mask", F.explode(all_masks[F.col("extra")]))
    return split.select("trie", "block", "width", "extra", F.least("prefix", F.col("prefix").bitwiseXOR(F.col("mask"))).alias("low"), "mask", (F.col("prefix") == F.least("prefix", F.col("prefix").bitwiseXOR(F.col("mask")))).alias("left"), "key")


def _array(column: pa.Array) -> np.ndarray:
    """A list column, whose lists have one length, as a matrix."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], others: tuple[str, ...]) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """Rows that lie together and agree in names: their values, and the arrays of others."""
    cell, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns, rest = ([_array(batch.column(batch.schema.get_field_index(n))) for n in some] for some in (names, others))
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            this = tuple(int(c[a]) for c in columns)
            if this != cell:
                if cell is not None:
                    yield cell, [np.concatenate(x) for x in zip(*parts, strict=True)]
                cell, parts = this, []
            parts.append([x[a:b] for x in rest])
    if cell is not None:
        yield cell, [np.concatenate(x) for x in zip(*parts, strict=True)]


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links (u, v) of each cell; its rows follow one another."""
    for (trie, _, width, extra, _, mask), (keys, sides) in runs(batches, ("trie", "block", "width", "extra", "low", "mask"), ("key", "left")):
        if len(keys) < 2:
            continue
        keys = keys.view(np.uint64)
        order = np.lexsort((keys, ~sides))
        keys, left = keys[order], int(sides.sum())
        if mask and not 0 < left < len(keys):
            continue
        pairs = spanning(trie_links(keys, width + extra, left=left if mask else None, spent=mask.bit_count()), len(keys))
        if pairs:
            turn = np.uint64(BLOCKS[trie][0])
            back = keys >> turn | keys << np.uint64((64 - int(turn)) % 64) if turn else keys
            at = np.array(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(back[at[:, k]].view(np.int64)) for k in (0, 1)], ["u", "v"])


def links(fps: DataFrame) -> DataFrame:
    """u, v: links between the distinct values of fp (long) that join what near-duplicates join."""
    cells = _cells(fps.select("fp").distinct())
    cell = ["trie", "block", "extra", "low", "mask"]
    # a number of its own: else cells of few bytes, but much work, are put together in one task
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(partitions, *cell).sortWithinPartitions(*cell).mapInArrow(_cell_links, "u long, v long")


def stars(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root for each node of edges (u, v): root is the smallest node reachable; roots themselves are left out.

    Alternates large and small stars: each node's larger neighbours, then its smaller ones, are hung on the smallest
    that it knows, until nothing changes. Every round is written to the shared folder.
    """
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), name)
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(rows: DataFrame, linked: Callable[[DataFrame], DataFrame] = links) -> DataFrame:
    """fp, component_id, keeper for each distinct fp of rows (doc_id, fp, row): the smallest doc_id reachable by what linked gives, and its row."""
    fps = materialize(rows.groupBy("fp").agg(F.min(F.col("doc_id")).alias("doc_id"), F.min(F.struct("doc_id", "row")).alias("first")), "simhash-fps")
    roots = fps.join(stars(linked(fps), "simhash-stars"), fps["fp"] == F.col("node"), "left").select("fp", "doc_id", "first", F.coalesce("root", "fp").alias("root"))
    best = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("first").alias("first"))
    return roots.select("fp", "root").join(best, "root").select("fp", "component_id", F.col("first.row").alias("keeper"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs.

    Null and empty texts, and texts of white space, have the fingerprint zero and link like any other. Repeated rows
    share a component; a null doc_id is never a component's id unless it has no other; an empty table gives no rows.
    Only doc_id and text are read, so other columns may have any name.
    """
    tune(docs.sparkSession)
    rows = materialize(docs.select("doc_id", fingerprinter()(F.col("text")).alias("fp")).withColumn("row", F.lit(0)), "simhash-rows")
    return rows.join(components(rows), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, of each component: that of the smallest doc_id, null first."""
    tune(docs.sparkSession)
    fp, row = (next(n for k in range(len(docs.columns) + 1) if (n := f"{x}_{k}") not in docs.columns) for x in ("__fp", "__row"))
    numbered = materialize(docs.withColumn(fp, fingerprinter()(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "simhash-numbered")
    keep = components(numbered.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"))).select(F.col("keeper").alias(row)).distinct()
    return numbered.join(keep, row, "left_semi").select(*docs.columns)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
