"""Near copies at a Jaccard similarity, by SimHash tries of wide fingerprints joined with themselves.

Documents are sets of word shingles. Two sets at SIMILARITY differ in each bit of their SimHash with a known
probability, about 0.15 at 0.8. So fingerprints are wide, and every trie is led by its own bits of them: documents that
agree in a trie's first bits lie in one subtree, in which pairs of nodes are traversed as in simhash.py, with the error
budget that the bits seen so far allow. The number of tries is such that a pair at SIMILARITY shares no subtree with a
probability of at most MISSED.

Copies in large groups would all meet one another. So a subtree reports a spanning forest of what it finds, and the
forests join documents into groups that hold all links. Only members of groups get still wider fingerprints, by which
each group gives the shortest spanning forest; its links are held against the exact similarity and join members under
roots. Links may then be left between members with different roots only, whose fingerprints are near enough; these are
held against the exact similarity too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import materialize, text_udf, tune
from .simhash import SEED, Majority, components, runs, shingle_hashes, stars, trie_forest

SHINGLE, SIMILARITY = 5, 0.8
#: Probability that a pair at SIMILARITY shares no subtree, at most, and that it differs in more bits than are allowed.
MISSED, STRAYED = 1e-3, 1e-6
#: Documents that a subtree is to hold on average, that a task holds of one, and members of a group, at a time.
HOLDS, CELL, MEMBERS = 512, 4096, 1024
#: Words of a fingerprint that all tries compare, and words of a member's fingerprint.
KEY, WIDE = 4, 32
#: Shingles that are spread to wide fingerprints, and pairs that are given out, at a time.
SLICE, PAIRS = 1 << 12, 1 << 16


def allowance(bits: int, differ: float, miss: float) -> int:
    """The fewest differing bits that a pair exceeds with a probability of miss at most."""
    total, p = 0.0, (1 - differ) ** bits
    for k in range(bits):
        total += p
        if 1 - total <= miss:
            return k
        p *= (bits - k) / (k + 1) * differ / (1 - differ)
    return bits


@dataclass(frozen=True)
class Plan:
    """What holds for a number of documents: the bits that lead to a subtree, the tries, and the words that lead."""

    width: int
    similarity: float
    prefix: int
    tries: int
    lead: int

    @classmethod
    def of(cls, documents: int, width: int = SHINGLE, similarity: float = SIMILARITY) -> Plan:
        prefix = max(4, math.ceil(math.log2(max(1, documents) / HOLDS)))
        meets = (1 - cls.bit_differs(similarity)) ** prefix
        tries = math.ceil(math.log(MISSED) / math.log1p(-meets))
        return cls(width, similarity, prefix, tries, math.ceil(tries * prefix / 64))

    @staticmethod
    def bit_differs(similarity: float) -> float:
        """For sets of one size; other sizes make it less."""
        return math.acos(2 * similarity / (1 + similarity)) / math.pi

    def budget(self) -> np.ndarray:
        """Differing bits allowed among the first 0 to 64 bits of a key."""
        return np.array([allowance(d, self.bit_differs(self.similarity), MISSED) for d in range(65)])

    def most(self, words: int) -> int:
        """Differing bits allowed in so many words."""
        return allowance(64 * words, self.bit_differs(self.similarity), STRAYED)


def shingle_set(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def wide_fingerprint(own: np.ndarray, words: int, first: int = 0) -> list[int]:
    """Signed: that many words of the SimHash of a set, from word first on."""
    odd = np.arange(first + 1, first + words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C16) | np.uint64(1)
    total = Majority(words)
    for at in range(0, len(own), SLICE):
        h = (own[at : at + SLICE, None] + odd) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(29)) * odd
        total.add(h ^ h >> np.uint64(32))
    return total.words().view(np.int64).tolist()


def signature(text: str | None, width: int, words: int) -> list[int]:
    """Signed: a hash of the shingle set, its size, and the words of its fingerprint."""
    own = shingle_set(text, width)
    return [xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63), len(own), *wide_fingerprint(own, words)]


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both + 1e-9 >= similarity * (len(a) + len(b) - both)


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (batch.column(batch.schema.get_field_index(n)) for n in ("u", "v", "a", "b"))
            good = [jaccard_reaches(np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8"), similarity) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([u, v, pa.array(good, pa.bool_())], ["u", "v", "good"])

    return run


def _entries(nodes: DataFrame, plan: Plan) -> DataFrame:
    """cell, key, fp, root: a row for each node and trie; each node is its own root."""

    def cell(trie: int) -> Column:
        word, bit = divmod(trie * plan.prefix, 64)
        own, after = F.col("sig")[word], F.col("sig")[word + 1]
        lead = own if not bit else F.shiftleft(own, bit).bitwiseOR(F.shiftrightunsigned(after, 64 - bit))
        return F.shiftrightunsigned(lead, 64 - plan.prefix) + F.lit(trie << 48)

    key = F.slice("sig", plan.lead + 1, KEY).alias("key")
    return nodes.select(F.explode(F.array(*map(cell, range(plan.tries)))).alias("cell"), key, "fp", F.col("fp").alias("root"))


def _dealt(entries: DataFrame, most: int) -> DataFrame:
    """entries (cell, fp, root and others) with pair, own, left: the rows that meet have one cell and pair.

    A cell of over most rows is dealt to chunks, and each pair of chunks is a group of its own; but chunks of one root's
    rows don't meet, so a large group of copies meets what else is in the cell, and not itself.
    """
    whole = {"pair": F.lit(0).cast("long"), "own": F.lit(True), "left": F.lit(True)}
    columns = [*entries.columns, *whole]
    large = materialize(entries.groupBy("cell").agg(F.count("*").alias("rows")).where(F.col("rows") > most), "similar-large")
    if large.isEmpty():
        return entries.withColumns(whole)
    split = entries.join(large, "cell")
    hot = split.groupBy("cell", "root").agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > most)
    rest = hot.groupBy("cell").agg(F.sum("hot_rows").alias("all_hot"))
    chunks_of = lambda n: F.greatest(F.lit(1), F.ceil(n / F.lit(most)))
    split = split.join(hot, ["cell", "root"], "left").join(rest, "cell", "left")
    is_hot = F.col("hot_rows").isNotNull()
    number = F.when(is_hot, F.pmod(F.xxhash64("fp"), chunks_of(F.col("hot_rows")))).otherwise(F.pmod(F.xxhash64("root"), chunks_of(F.col("rows") - F.coalesce("all_hot", F.lit(0)))))
    split = split.withColumn("hot", F.when(is_hot, F.col("root"))).withColumn("chunk", F.xxhash64(F.coalesce("hot", F.lit(0)), is_hot, number))
    split = materialize(split.select(*entries.columns, "hot", "chunk"), "similar-split")
    chunks = split.select("cell", "hot", "chunk").distinct()
    a, b = (chunks.select("cell", *(F.col(c).alias(f"{c}_{x}") for c in ("hot", "chunk"))) for x in "ab")
    apart = F.col("hot_a").isNull() | F.col("hot_b").isNull() | (F.col("hot_a") != F.col("hot_b"))
    pairs = a.join(b, "cell").where((F.col("chunk_a") <= F.col("chunk_b")) & apart)
    pairs = materialize(pairs.select("cell", "chunk_a", "chunk_b", F.xxhash64("chunk_a", "chunk_b").alias("pair"), (F.col("chunk_a") == F.col("chunk_b")).alias("own")), "similar-chunks")
    first = split.join(pairs.select("cell", F.col("chunk_a").alias("chunk"), "pair", "own"), ["cell", "chunk"]).withColumn("left", F.lit(True))
    second = split.join(pairs.where("not own").select("cell", F.col("chunk_b").alias("chunk"), "pair", "own"), ["cell", "chunk"]).withColumn("left", F.lit(False))
    small = entries.join(large, "cell", "left_anti").withColumns(whole)
    return small.select(*columns).unionByName(first.select(*columns)).unionByName(second.select(*columns))


def _met(entries: DataFrame, most: int, others: tuple[str, ...], pairs: Callable[..., Iterator[np.ndarray]]) -> DataFrame:
    """u, v: what pairs(own, left, fp, root, *others) gives, as positions, for the rows of each cell, over most rows in chunks."""
    group = ["cell", "pair", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, own), (left, fp, root, *rest) in runs(batches, tuple(group), ("left", "fp", "root", *others)):
            if len(fp) > 1:
                for at in pairs(bool(own), left, fp, root, *rest):
                    u, v = fp[at[:, 0]], fp[at[:, 1]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    # a number of its own: else cells of few bytes, but much work, are put together in one task
    partitions = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _dealt(entries, most).repartition(partitions, *group).sortWithinPartitions(*group).mapInArrow(run, "u long, v long").distinct()


def _subtree(plan: Plan):
    budget, most = plan.budget(), plan.most(KEY)

    def pairs(own: bool, left: np.ndarray, fp: np.ndarray, root: np.ndarray, key: np.ndarray) -> Iterator[np.ndarray]:
        """A spanning forest of the pairs within the budget."""
        key = key.view(np.uint64)
        order = np.lexsort((key[:, 0], ~left))
        if joins := trie_forest(key[order, 0], 0, budget, left=None if own else int(left.sum()), more=key[order, 1:], most=most):
            yield order[np.array(joins)]

    return pairs


def _fits(n: np.ndarray, size: int, similarity: float) -> np.ndarray:
    return np.minimum(n, size) + 1e-9 >= similarity * np.maximum(n, size)


def _shortest_forest(plan: Plan):
    most = plan.most(WIDE)

    def pairs(own: bool, left: np.ndarray, fp: np.ndarray, root: np.ndarray, n: np.ndarray, wide: np.ndarray) -> Iterator[np.ndarray]:
        """The forest of least differing bits among the pairs that may be similar: each member in turn is hung on its nearest."""
        wide = wide.view(np.uint64)
        best, to, open_, out = np.full(len(fp), most + 1), np.zeros(len(fp), dtype=np.int64), np.ones(len(fp), dtype=bool), []
        for _ in range(len(fp)):
            i = int(np.where(open_, best, most + 2).argmin())
            if best[i] <= most:
                out.append((to[i], i))
            open_[i] = False
            differ = np.bitwise_count(wide ^ wide[i]).sum(1, dtype=np.int64)
            nearer = open_ & (differ < best) & _fits(n, n[i], plan.similarity)
            if not own:
                nearer &= left != left[i]
            best[nearer], to[nearer] = differ[nearer], i
        if out:
            yield np.array(out)

    return pairs


def _all_apart(plan: Plan):
    most = plan.most(WIDE)

    def pairs(own: bool, left: np.ndarray, fp: np.ndarray, root: np.ndarray, n: np.ndarray, wide: np.ndarray) -> Iterator[np.ndarray]:
        """All pairs with different roots that may be similar."""
        wide, out, held = wide.view(np.uint64), [], 0
        for i in range(len(fp) - 1):
            later = slice(i + 1, None)
            near = (root[later] != root[i]) & _fits(n[later], n[i], plan.similarity)
            if not own:
                near &= left[later] != left[i]
            j = i + 1 + np.flatnonzero(near)
            j = j[np.bitwise_count(wide[j] ^ wide[i]).sum(1, dtype=np.int64) <= most]
            out.append(np.column_stack([np.full(len(j), i), j]))
            held += len(j)
            if held >= PAIRS:
                yield np.concatenate(out)
                out, held = [], 0
        if held:
            yield np.concatenate(out)

    return pairs


def links(numbered: DataFrame, sig: str, row: str, plan: Plan) -> DataFrame:
    """u, v: links between the distinct sets of numbered (text, sig, row) that join all that are similar."""
    s = F.col(sig)
    nodes = numbered.where(s[1] > 0).select(s[0].alias("fp"), s.alias("sig"), F.col(row).alias("row")).groupBy("fp").agg(F.first("sig").alias("sig"), F.min("row").alias("row"))
    nodes = materialize(nodes.select("fp", F.slice("sig", 3, plan.lead + KEY).alias("sig"), "row"), "similar-nodes")
    found = stars(_met(_entries(nodes, plan), CELL, ("key",), _subtree(plan)), "similar-found")
    grouped = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("fp"), F.col("root").alias("cell"))
    wanted = nodes.join(grouped, "fp").select("fp", "cell", F.col("row").alias(row))

    def member(text: str | None) -> dict:
        own = shingle_set(text, plan.width)
        return {"n": len(own), "wide": wide_fingerprint(own, WIDE, plan.lead + KEY), "own": own.tobytes()}

    kind = pa.struct([("n", pa.int64()), ("wide", pa.list_(pa.int64())), ("own", pa.binary())])
    as_member = text_udf(lambda: lambda texts: [member(t) for t in texts], "struct<n: long, wide: array<long>, own: binary>", kind)
    members = materialize(numbered.select(row, "text").join(wanted, row).select("fp", "cell", as_member(F.col("text")).alias("m")).select("fp", "cell", "m.*"), "similar-members")
    left, right = members.select(F.col("fp").alias("u"), F.col("own").alias("a")), members.select(F.col("fp").alias("v"), F.col("own").alias("b"))

    def verified(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_verified(plan.similarity), "u long, v long, good boolean"), "similar-verified")

    group, others = members.select("cell", "fp", F.col("fp").alias("root"), "n", "wide"), ("n", "wide")
    first = verified(_met(group, MEMBERS, others, _shortest_forest(plan)))
    roots = stars(first.where("good").select("u", "v"), "similar-roots").select(F.col("node").alias("fp"), F.col("root").alias("new"))
    group = group.join(roots, "fp", "left").withColumn("root", F.coalesce("new", "root")).drop("new")
    second = verified(_met(group, MEMBERS, others, _all_apart(plan)).join(first.select("u", "v"), ["u", "v"], "left_anti"))
    return first.unionByName(second).where("good").select("u", "v")


def keep_one(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of docs, with all its columns, of each group that links join: that of the smallest doc_id, null first.

    Documents link at a Jaccard similarity of their shingle sets of at least similarity. Null and empty texts and texts
    of white space have no shingles and are copies of one another; repeated rows are copies; an empty table gives no
    rows. Other columns may have any name.
    """
    tune(docs.sparkSession)
    plan = Plan.of(docs.count(), width, similarity)
    sig, row = (next(n for k in range(len(docs.columns) + 1) if (n := f"{x}_{k}") not in docs.columns) for x in ("__sig", "__row"))
    signed = text_udf(lambda: lambda texts: [signature(t, plan.width, plan.lead + KEY) for t in texts], "array<long>", pa.list_(pa.int64()))
    numbered = materialize(docs.withColumn(sig, signed(F.col("text"))).withColumn(row, F.monotonically_increasing_id()), "similar-numbered")
    rows = numbered.select("doc_id", F.col(sig)[0].alias("fp"), F.col(row).alias("row"))
    keep = components(rows, lambda _: links(numbered, sig, row, plan)).select(F.col("keeper").alias(row)).distinct()
    return numbered.join(keep, row, "left_semi").select(*docs.columns)
