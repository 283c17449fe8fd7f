"""Spans of text: predicates, masks, inline tags, overlap families, anchors. Offsets are code points from 0, ends exclusive."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from spanloom.functions import text as T


def span_ok(text: Column, span: Column) -> Column:
    """text[start:end] is the span's own text."""
    return F.coalesce((span["start"] >= 0) & (span["end"] > span["start"]) & (F.substring(text, span["start"] + 1, span["end"] - span["start"]) == span["text"]), F.lit(False))


def span_set_ok(text: Column, spans: Column) -> Column:
    """Every span is exact, and they are sorted and don't overlap."""
    pairs = F.when(F.size(spans) < 2, F.lit(True)).otherwise(
        F.forall(F.zip_with(F.slice(spans, 1, F.size(spans) - 1), F.slice(spans, 2, F.size(spans) - 1), lambda a, b: a["end"] <= b["start"]), lambda ok: ok)
    )
    return F.forall(spans, lambda s: span_ok(text, s)) & pairs


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """They share a character; touching isn't overlapping."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def coverage(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The share of a that b covers."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start)) / (a_end - a_start)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by as many blanks.

    Over Arrow batches: a native fold walks the text from its beginning for each span, so it takes the product of both lengths.
    """
    return T.masked_spans(text, spans)


def scan_tags(tagged: Column, tag: str) -> Column:
    """Struct of the text without tags, the spans that they marked before the first error, and that error: nested, unmatched, empty or unclosed.

    Tags must alternate, opening first. So the text is split at its tags once, and the first tag that stands in the wrong
    turn, or closes nothing, is the error; the odd parts before it are the spans.
    """
    opening, either = f"<{tag}>", f"</?{tag}>"
    split = F.struct(F.regexp_extract_all(tagged, F.lit(f"({either})"), F.lit(0)).alias("tags"), F.split(tagged, either).alias("parts"))

    def measured(x: Column) -> Column:
        turn = F.transform(x["tags"], lambda t, i: F.when(i % 2 == 0, F.when(t != opening, "unmatched")).when(t == opening, "nested").when(F.get(x["parts"], i) == "", "empty"))
        begins = F.aggregate(x["parts"], F.array(F.lit(0)), lambda s, p: F.array_append(s, F.element_at(s, -1) + F.length(p)))
        wrong = F.array_position(F.transform(turn, lambda e: e.isNotNull()), F.lit(True)).cast("int") - 1
        return F.struct(x["parts"].alias("parts"), F.size(x["tags"]).alias("n"), turn.alias("turn"), begins.alias("begins"), wrong.alias("wrong"))

    def marked(x: Column) -> Column:
        good = F.when(x["wrong"] >= 0, x["wrong"]).otherwise(x["n"])
        odd = F.when(good >= 2, F.sequence(F.lit(1), good - F.when(good % 2 == 0, 1).otherwise(2), F.lit(2))).otherwise(F.array().cast("array<int>"))
        spans = F.transform(odd, lambda i: F.struct(F.get(x["parts"], i).alias("text"), F.get(x["begins"], i).alias("start"), F.get(x["begins"], i + 1).alias("end")))
        error = F.when(x["wrong"] >= 0, F.get(x["turn"], x["wrong"])).when(x["n"] % 2 == 1, "unclosed")
        return F.struct(F.array_join(x["parts"], "").alias("sentence"), spans.alias("spans"), error.alias("error"))

    return F.when(tagged.isNotNull(), _named(_named(split, measured), marked))


def _named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once, however often use has it."""
    return F.transform(F.array(value), use)[0]


def families(labels: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """labels (key or keys, start, end, …) with family, numbered from 0 by the first span: components of the overlap graph.

    Sorted by start, a span that begins at or behind all ends so far begins a new component.
    """
    order = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.col("start") < F.coalesce(F.max("end").over(before), F.lit(-1)), 0).otherwise(1)
    return labels.withColumn("__begins", begins).withColumn("family", (F.sum("__begins").over(order) - 1).cast("int")).drop("__begins")


def family_coverage(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """labels (by, start, end, distinct) with members, min_coverage and avg_coverage over the other members of their family; both null for one alone.

    No two members meet. The sum of what they cover of [a, b) is G(b) - G(a), where G(x) adds up what all members have
    before x: by their starts and ends up to x, one running sum over sorted ends. The least is that of a member's own
    length, of its reach from the last other start and to the first other end, and of the shortest other.
    """
    family = Window.partitionBy(*by)
    length = F.col("end") - F.col("start")
    of = {"__last": (F.col("start"), F.max), "__first": (F.col("end"), F.min), "__short": (length, F.min)}
    # the best of the others is the second best where the best is this row's alone
    rows = labels.withColumn("members", F.count("*").over(family)).withColumns({f"{name}_1": best(x).over(family) for name, (x, best) in of.items()})
    second = {f"{name}_2": best(F.when(x != F.col(f"{name}_1"), x)).over(family) for name, (x, best) in of.items()}
    rows = rows.withColumns(second | {f"{name}_n": F.count_if(x == F.col(f"{name}_1")).over(family) for name, (x, _) in of.items()})
    rows = rows.withColumns({name: F.when((F.col(f"{name}_n") == 1) & (x == F.col(f"{name}_1")), F.col(f"{name}_2")).otherwise(F.col(f"{name}_1")) for name, (x, _) in of.items()})
    rows = rows.withColumn("__length", length).drop(*(f"{name}_{k}" for name in of for k in "12n"))
    least = F.greatest(F.lit(0), F.least("__length", F.col("end") - F.col("__last"), F.col("__first") - F.col("start"), "__short"))
    alone = F.col("members") < 2
    rows = rows.withColumn("min_coverage", F.when(~alone, least / F.col("__length"))).drop("__last", "__first", "__short")
    kept = [c for c in rows.columns if c not in (*by, "start", "end")]
    ends = rows.withColumn("__x", F.explode(F.array("start", "end"))).withColumn("__is_end", F.col("__x") == F.col("end"))
    upto = family.orderBy("__x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    x, is_end = F.col("__x").cast("long"), F.col("__is_end")
    # each start before x adds what lies between, each end before x takes off what lies behind it
    ends = ends.withColumn("__sum", F.sum(F.when(is_end, x).otherwise(-x)).over(upto) + x * F.sum(F.when(is_end, -1).otherwise(1)).over(upto))
    both = ends.groupBy(*by, "start", "end").agg(*(F.first(c).alias(c) for c in kept), F.sum(F.when(is_end, F.col("__sum")).otherwise(-F.col("__sum"))).alias("__all"))
    mean = (F.col("__all") - F.col("__length")) / (F.col("__length") * (F.col("members") - 1))
    return both.withColumn("avg_coverage", F.when(~alone, mean)).drop("__all", "__length")


def family_members(labels: DataFrame, key: str) -> DataFrame:
    """Each member of a family of two or more with its least and mean coverage over the others (min_coverage, avg_coverage), not rounded."""
    found = family_coverage(labels.select(key, "family", "start", "end", "votes"), [key, "family"])
    return found.where("members > 1").select(key, "family", "start", "end", "votes", "min_coverage", "avg_coverage", "members")


def interval_join(left: DataFrame, right: DataFrame, key: str, ends: Sequence[str], other: Sequence[str], width: int = 64) -> DataFrame:
    """Rows of both with the same key whose intervals, [start, end) by the column names given, share a character.

    Intervals are dealt to the stretches of width characters that they touch, and meet there; a pair that meets in more
    than one counts in the first that both touch. So the work follows the pairs that overlap and the length of
    intervals, not the product of a key's rows. Empty intervals meet nothing.
    """

    def dealt(df: DataFrame, start: str, end: str) -> DataFrame:
        stretch = lambda x: F.floor(x / width).cast("long")
        return df.where(F.col(start) < F.col(end)).withColumn("__at", F.explode(F.sequence(stretch(F.col(start)), stretch(F.col(end) - 1))))

    met = dealt(left, *ends).join(dealt(right, *other), [key, "__at"])
    begin = F.greatest(ends[0], other[0])
    return met.where((begin < F.least(ends[1], other[1])) & (F.floor(begin / width) == F.col("__at"))).drop("__at")


def threshold(units: Column, base: float = 0.45, step: float = 0.05, cap: float = 0.85) -> Column:
    """The coverage that a winner needs, by its number of words."""
    return F.least(F.lit(cap), F.lit(base) + F.lit(step) * (units - 1))


def with_winners(members: DataFrame, by: Sequence[str], units: Column, epsilon: float = 1e-12) -> DataFrame:
    """members with units, stage and won, true for one member of each family.

    The winner is found by stages: most votes, then within epsilon of the best least coverage, then of the best mean,
    then fewest words, shortest, first. stage is the number of the first three that a member passed.
    """
    family = Window.partitionBy(*by)
    rows = members.withColumn("units", units).withColumn("__top", F.max(F.struct("votes", "min_coverage")).over(family))
    first = F.when(F.col("votes") < F.col("__top.votes"), 0).when(F.col("min_coverage") + epsilon < F.col("__top.min_coverage"), 1).otherwise(2)
    rows = rows.withColumn("stage", first)
    rows = rows.withColumn("__top", F.max(F.when(F.col("stage") == 2, F.col("avg_coverage"))).over(family))
    rows = rows.withColumn("stage", F.when((F.col("stage") == 2) & ~(F.col("avg_coverage") + epsilon < F.col("__top")), 3).otherwise(F.col("stage")))
    order = F.struct(-F.col("stage"), "units", F.col("end") - F.col("start"), "start", "end")
    return rows.withColumn("won", order == F.min(order).over(family)).drop("__top")


def reaches(epsilon: float = 1e-12) -> Column:
    """Whether every other member's coverage reaches the threshold of a winner's units."""
    return F.col("min_coverage") + epsilon >= threshold(F.col("units"))


def anchors(members: DataFrame, key: str, units: Column, epsilon: float = 1e-12) -> DataFrame:
    """The winner of each family, see with_winners(). accepted: every other member's coverage reaches the threshold."""
    won = with_winners(members, [key, "family"], units, epsilon).where("won").drop("won", "stage")
    return won.withColumn("accepted", reaches(epsilon))


def anchor_rankings(members: DataFrame, key: str, units: Column) -> DataFrame:
    """All members of families with candidate_rank, by votes, least and mean coverage, words, length and place, and eligible: they have the winner's votes."""
    family = Window.partitionBy(key, "family")
    order = family.orderBy(F.col("votes").desc(), F.col("min_coverage").desc(), F.col("avg_coverage").desc(), "units", F.col("end") - F.col("start"), "start", "end")
    rows = members.withColumn("units", units).withColumn("candidate_rank", F.row_number().over(order))
    return rows.withColumn("eligible", F.col("votes") == F.max("votes").over(family))
