"""Tables compared by trees of hashes: what agrees isn't read twice, what differs is found and located.

Rows are dealt to buckets by a hash of their key. A bucket's digest is of its rows as a multiset, so it needs no order and
adds up before the shuffle; the digests of sixteen neighbours are folded into one of the level above, up to the root. Two
tables are walked down from their roots, and only the buckets that differ are read again, row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Children of a node, and levels below the root: 16^3 buckets.
FAN, LEVELS = 16, 3


def row_hash(columns: Sequence[str], seed: int) -> Column:
    """Of all columns; which of them are null counts too, as a null alone leaves no trace in a hash."""
    nulls = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns))
    return F.xxhash64(F.lit(seed), nulls, *columns)


def bucket(keys: Sequence[str], levels: int = LEVELS) -> Column:
    return F.pmod(row_hash(keys, 17), F.lit(FAN**levels)).cast("int")


def tree(table: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """level, node, n, digest: every node that holds a row, level 0 the root. At most 16^levels rows and the levels above."""
    columns = sorted(table.columns)
    rows = table.select(bucket(keys, levels).alias("node"), *(row_hash(columns, s).alias(f"h{s}") for s in (1, 2)))
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = leaves = rows.groupBy("node").agg(F.count("*").alias("n"), wide("h1").alias("h1"), wide("h2").alias("h2")).withColumn("level", F.lit(levels))
    for level in range(levels - 1, -1, -1):
        above = leaves.groupBy(F.floor(F.col("node") / FAN ** (levels - level)).cast("int").alias("node")).agg(F.sum("n").alias("n"), wide("h1").alias("h1"), wide("h2").alias("h2"))
        out = out.unionByName(above.withColumn("level", F.lit(level)))
    return out.select("level", "node", "n", F.sha2(F.concat_ws(":", "n", "h1", "h2"), 256).alias("digest"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """level, node of two trees that don't have the same digest on both sides."""
    r = right.select("level", "node", F.col("digest").alias("__other"))
    return left.join(r, ["level", "node"], "full").where("not (digest <=> __other)").select("level", "node")


def located(left: DataFrame, right: DataFrame, keys: Sequence[str], levels: int = LEVELS) -> DataFrame:
    """keys, kind, column, left, right, n: how two tables with the same columns differ.

    changed: a row a column, with both values as text, where a key has one differing row on each side. Else missing (left
    has n rows more that differ) and extra (right has). Repeated rows count. Equal tables give no rows, and only their
    digests meet.
    """
    columns = list(left.columns)
    right = right.select(*columns)
    bad = differing(tree(left, keys, levels), tree(right, keys, levels)).where(F.col("level") == levels).select("node")
    nodes = F.broadcast(bad)  # 16^levels numbers at most
    sides = [x.withColumn("node", bucket(keys, levels)).join(nodes, "node", "left_semi").drop("node").withColumn("__w", F.lit(w)) for x, w in ((left, 1), (right, -1))]
    delta = sides[0].unionByName(sides[1]).groupBy(*columns).agg(F.sum("__w").alias("__w")).where("__w != 0")
    row, w = F.struct(*(F.col(c).cast("string").alias(c) for c in columns)), F.col("__w")
    both = delta.groupBy(*keys).agg(
        F.sum(F.greatest(w, F.lit(0))).alias("__l"), F.sum(F.greatest(-w, F.lit(0))).alias("__r"), F.first(F.when(w > 0, row), ignorenulls=True).alias("__a"), F.first(F.when(w < 0, row), ignorenulls=True).alias("__b")
    )
    entry = lambda kind, column, a, b, n: F.struct(F.lit(kind).alias("kind"), column.alias("column"), a.alias("left"), b.alias("right"), n.cast("long").alias("n"))
    none = F.lit(None).cast("string")
    cells = [F.when(~F.col(f"__a.{c}").eqNullSafe(F.col(f"__b.{c}")), entry("changed", F.lit(c), F.col(f"__a.{c}"), F.col(f"__b.{c}"), F.lit(1))) for c in columns if c not in keys]
    counts = [F.when(F.col(s) > 0, entry(kind, none, none, none, F.col(s))) for kind, s in (("missing", "__l"), ("extra", "__r"))]
    one_each = (F.col("__l") == 1) & (F.col("__r") == 1)
    # values that differ but look alike as texts are still a row
    changed = F.array_compact(F.array(*cells)) if cells else F.array_compact(F.array(*counts))
    found = F.when(one_each & (F.size(changed) > 0), changed).otherwise(F.array_compact(F.array(*counts)))
    return both.select(*keys, F.explode(found).alias("__e")).select(*keys, "__e.*")


# --- rules over what a run has written


def rank_violations(rows: DataFrame, group: Sequence[str], rank: str) -> DataFrame:
    """group, n, low, high, n_distinct: where the ranks of a group aren't 1, 2, ... without gaps and repetitions."""
    found = rows.groupBy(*group).agg(F.count("*").alias("n"), F.min(rank).cast("long").alias("low"), F.max(rank).cast("long").alias("high"), F.count_distinct(rank).alias("n_distinct"))
    return found.where("not (low <=> 1 and high <=> n and n_distinct = n)")


def assignment_violations(rows: DataFrame, bank: DataFrame, sentences: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, rank, rule of assigned terms (key, rank, term, candidate_rank, distance, token, start, end).

    bank (term, rank): membership, with the bank's own rank. sentences (key, text): the token stands at its offsets.
    Distances are finite, not negative, and don't fall from rank to rank. Ranks without gaps: rank_violations().
    """
    known = bank.select("term", F.col("rank").alias("__bank"))
    both = rows.join(known, "term", "left").join(sentences.select(key, F.col(text).alias("__text")), key, "left")
    own = F.substring("__text", F.col("start") + 1, F.col("end") - F.col("start"))
    bad = {
        "not_in_bank": F.col("__bank").isNull(), "bank_rank": F.col("__bank") != F.col("candidate_rank"), "no_sentence": F.col("__text").isNull(),
        "offset": ~F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (own == F.col("token")), F.lit(False)),
        "distance": ~F.coalesce((F.col("distance") >= 0) & (F.col("distance") < F.lit(float("inf"))), F.lit(False)),
    }
    both = both.withColumn("__before", F.lag("distance").over(Window.partitionBy(key).orderBy("rank")))
    bad["order"] = F.col("__before") > F.col("distance")
    rules = F.array_compact(F.array(*(F.when(c, rule) for rule, c in bad.items())))
    return both.select(key, "rank", F.explode(rules).alias("rule"))

