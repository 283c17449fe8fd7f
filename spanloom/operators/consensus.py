"""Consensus of repeated annotations: votes on spans, explained variants, families, a status ladder and uncertainty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import spans as S


@dataclass(frozen=True)
class Rules:
    min_valid: int = 3
    negative_votes: int = 4
    positive_votes: int = 3
    exact_votes: int = 3
    family_support: int = 3
    family_candidates: int = 3


def votes(samples: DataFrame) -> DataFrame:
    """idx, valid, has, no: over samples (idx, sample, valid boolean, has boolean). Failed samples are no votes."""
    return samples.groupBy("idx").agg(
        F.count_if("valid").alias("valid"), F.count_if(F.col("valid") & F.col("has")).alias("has"), F.count_if(F.col("valid") & ~F.col("has")).alias("no")
    )


def label_votes(marks: DataFrame) -> DataFrame:
    """idx, start, end, votes, samples (sorted): the distinct spans of marks (idx, sample, start, end)."""
    return marks.groupBy("idx", "start", "end").agg(F.count_distinct("sample").alias("votes"), F.sort_array(F.collect_set("sample")).alias("samples"))


def explained(labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """labels with kind: exact, explained (overlaps an exact one) or open.

    One pass in order: an exact label stands at its start, any other at its end, before exact ones that begin there. What
    it meets before it began ahead of its end; it overlaps one of these if the furthest of their ends lies behind its start.
    """
    exact = F.col("votes") >= rules.exact_votes
    order = Window.partitionBy("idx").orderBy(F.when(exact, F.col("start")).otherwise(F.col("end")), exact, "start", "end")
    furthest = F.max(F.when(exact, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return labels.withColumn("kind", F.when(exact, "exact").when(furthest > F.col("start"), "explained").otherwise("open"))


def open_families(labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The open labels of explained() with family and the family's support, its number of distinct samples."""
    grouped = S.families(labels.where("kind = 'open'"), "idx")
    return grouped.withColumn("support", F.size(F.array_distinct(F.flatten(F.collect_set("samples").over(Window.partitionBy("idx", "family"))))).cast("long"))


def _outcome(support: Column, members: Column, accepted: Column, rules: Rules) -> Column:
    """What becomes of a family: noise, unresolved with its reason, or accepted."""
    match = F.when(members < 2, "hard_match_validation_failed").when(accepted, "accepted").otherwise("family_anchor_overlap_failed")
    return F.when(support >= rules.family_support, match).when(support >= rules.family_candidates, "unresolved_span_family").otherwise("audit_noise")


def family_outcomes(members: DataFrame, units: Column, rules: Rules = Rules()) -> DataFrame:
    """idx, family, reason, start, end: what becomes of each open family; the winner's span where it is accepted."""
    sizes = members.groupBy("idx", "family").agg(F.max("support").alias("support"), F.count("*").alias("size"))
    won = S.anchors(S.family_members(members, "idx"), "idx", units).select("idx", "family", "start", "end", "accepted")
    out = sizes.join(won, ["idx", "family"], "left").withColumn("reason", _outcome(F.col("support"), F.col("size"), F.col("accepted"), rules))
    keep = F.col("reason") == "accepted"
    return out.select("idx", "family", "reason", F.when(keep, F.col("start")).alias("start"), F.when(keep, F.col("end")).alias("end"))


def with_spans(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """idx, sample, valid, has, spans: each sample with its distinct spans. Marks of unknown samples are left out."""
    mark = marks.select("idx", "sample", F.struct("start", "end").alias("span"))
    kind = mark.schema["span"].dataType
    own = samples.select("idx", "sample", "valid", "has", F.lit(None).cast(kind).alias("span"))
    rows = own.unionByName(mark, allowMissingColumns=True).repartition("idx")
    grouped = rows.groupBy("idx", "sample").agg(F.max("valid").alias("valid"), F.max("has").alias("has"), F.max(F.col("span").isNull()).alias("__known"), F.collect_set("span").alias("spans"))
    return grouped.where("__known").drop("__known")


def sentences(annotated: DataFrame) -> DataFrame:
    """idx, valid, has, no, sets, labels from annotated (idx, sample, valid, has, spans): one row an idx, whose samples are few.

    sets: the valid samples' spans. labels: the distinct spans of valid samples in order, each with its samples, sorted.
    """
    rows = annotated.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("sample", "valid", "has", "spans"))).alias("samples"))
    rows = rows.select("idx", F.filter("samples", lambda s: s["valid"]).alias("good"))
    spans = F.array_sort(F.array_distinct(F.flatten(F.transform("good", lambda s: s["spans"]))))
    labels = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.transform(F.filter("good", lambda s: F.array_contains(s["spans"], x)), lambda s: s["sample"]).alias("samples")))
    n, has = F.size("good"), F.size(F.filter("good", lambda s: s["has"]))
    return rows.select("idx", n.cast("long").alias("valid"), has.cast("long").alias("has"), (n - has).cast("long").alias("no"), F.transform("good", lambda s: F.array_distinct(s["spans"])).alias("sets"), labels.alias("labels"))


def statuses(samples: DataFrame, marks: DataFrame, units: Column, rules: Rules = Rules()) -> DataFrame:
    """decisions() over samples (idx, sample, valid, has) and their marks (idx, sample, start, end)."""
    return decisions(with_spans(samples, marks), units, rules)


def decisions(annotated: DataFrame, units: Column, rules: Rules = Rules()) -> DataFrame:
    """idx, valid, has, no, status, reason, reasons, n_spans, spans, candidates for each idx, by the ladder abstained, negative, unsolved, span phase.

    In the span phase the reasons are those of unresolved families, sorted, then an overlap of accepted spans, then that
    there is no accepted span; reason is the first. spans: the accepted ones; candidates: (start, end, votes) with enough votes.
    annotated: see with_spans(). All of it is one shuffle by idx: the labels of an idx stay together through the windows.
    """
    rows = sentences(annotated).select("idx", "valid", "has", "no", F.explode_outer("labels").alias("label"))
    rows = rows.select("idx", "valid", "has", "no", "label.start", "label.end", F.size("label.samples").cast("long").alias("votes"), "label.samples")
    rows = explained(rows, rules).withColumn("kind", F.when(F.col("start").isNotNull(), F.col("kind")))
    # an idx without labels keeps one row; families are numbered within a kind, and count where it is open
    rows = S.families(rows, ["idx", "kind"])
    family = ["idx", "kind", "family"]
    rows = rows.withColumn("support", F.size(F.array_distinct(F.flatten(F.collect_set("samples").over(Window.partitionBy(*family))))).cast("long")).drop("samples")
    placed = S.with_winners(S.family_coverage(rows, family), family, units)
    won = (F.col("kind") == "open") & F.col("won")
    outcome = F.when(won, _outcome(F.col("support"), F.col("members"), S.reaches(), rules))
    placed = placed.withColumn("outcome", outcome)
    keep = (F.col("kind") == "exact") | (F.col("outcome") == "accepted")
    span = F.struct("start", "end")
    counts = [F.first(c).alias(c) for c in ("valid", "has", "no")]
    all_of = placed.groupBy("idx").agg(
        *counts, F.sort_array(F.collect_list(F.when(keep, span))).alias("spans"), F.sort_array(F.collect_set(F.when(~F.col("outcome").isin("accepted", "audit_noise"), F.col("outcome")))).alias("trouble"),
        F.sort_array(F.collect_list(F.when(F.col("votes") >= rules.exact_votes, F.struct("start", "end", "votes")))).alias("candidates"),
    )
    n = F.size("spans")
    # sorted by start, spans overlap only if neighbours do
    clash = F.exists(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.get("spans", i)["end"] > F.get("spans", i + 1)["start"])
    spans = F.concat("trouble", F.when(clash, F.array(F.lit("accepted_span_conflict"))).otherwise(F.array()), F.when(n == 0, F.array(F.lit("positive_without_stable_span"))).otherwise(F.array()))
    reasons = (
        F.when(F.col("valid") < rules.min_valid, F.array(F.lit("insufficient_valid_samples")))
        .when(F.col("no") >= rules.negative_votes, F.array(F.lit("high_confidence_no_skill")))
        .when(F.col("has") < rules.positive_votes, F.array(F.lit("has_skill_no_consensus")))
        .when(F.size(spans) > 0, spans)
        .otherwise(F.array(F.lit("all_span_families_resolved")))
    )
    all_of = all_of.withColumn("reasons", reasons).withColumn("reason", F.get("reasons", F.lit(0)))
    status = (
        F.when(F.col("reason") == "insufficient_valid_samples", "abstained")
        .when(F.col("reason") == "high_confidence_no_skill", "negative")
        .when(F.col("reason") == "all_span_families_resolved", "accepted")
        .otherwise("unsolved")
    )
    accepted = F.when(F.col("status") == "accepted", F.col("spans")).otherwise(F.slice("spans", 1, 0))
    positive = (F.col("valid") >= rules.min_valid) & (F.col("no") < rules.negative_votes) & (F.col("has") >= rules.positive_votes)
    candidates = F.when(positive, F.col("candidates")).otherwise(F.slice("candidates", 1, 0))
    return all_of.withColumn("status", status).select("idx", "valid", "has", "no", "status", "reason", "reasons", F.size(accepted).alias("n_spans"), accepted.alias("spans"), candidates.alias("candidates"))


def existence_score(status: str, valid: str, has: str, no: str) -> Column:
    """Votes for the decided outcome over valid votes; null where nothing is decided."""
    return F.when(F.col(status) == "accepted", F.try_divide(F.col(has), F.col(valid))).when(F.col(status) == "negative", F.try_divide(F.col(no), F.col(valid)))


def uncertainty(samples: DataFrame, marks: DataFrame) -> DataFrame:
    """disagreement() over samples (idx, sample, valid, has) and their marks (idx, sample, start, end)."""
    return disagreement(with_spans(samples, marks))


def disagreement(annotated: DataFrame) -> DataFrame:
    """idx, mean_jaccard, mean_entropy, mean_count, min_count, max_count: over valid samples' span sets, for each idx with one.

    Jaccard of two empty sets is 1; with fewer than two samples the mean is null; without labels the entropy is 0.
    annotated: see with_spans(). An idx is one row: its sets are paired in place.
    """
    rows = sentences(annotated).where("valid > 0")
    n = F.size("sets")
    jaccard = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(1.0))
    pairs = F.flatten(F.transform("sets", lambda a, i: F.transform(F.slice("sets", i + 2, n), lambda b: jaccard(a, b))))
    mean = lambda x: F.try_divide(F.aggregate(x, F.lit(0.0), lambda s, v: s + v), F.size(x))
    p = lambda label: F.size(label["samples"]) / F.col("valid")
    entropy = F.transform("labels", lambda x: F.when(p(x) >= 1, F.lit(0.0)).otherwise(-(p(x) * F.log2(p(x)) + (1 - p(x)) * F.log2(1 - p(x)))))
    counts = F.transform("sets", lambda s: F.size(s))
    rows = rows.select("idx", pairs.alias("pairs"), entropy.alias("entropy"), counts.alias("counts"))
    return rows.select(
        "idx", F.round(mean(F.col("pairs")), 6).alias("mean_jaccard"), F.round(F.coalesce(mean(F.col("entropy")), F.lit(0.0)), 6).alias("mean_entropy"), F.round(mean(F.transform("counts", lambda c: c.cast("double"))), 6).alias("mean_count"),
        F.array_min("counts").alias("min_count"), F.array_max("counts").alias("max_count"),
    )
