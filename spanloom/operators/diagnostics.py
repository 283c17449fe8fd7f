"""Summaries of runs: parse and call statistics, context counts, samples for review, overlap of jobs, anchors, comparison of two runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window

from .assemble import ordered_distinct
from .gate import rate
from .metrics import micro, presence


def exploded_counts(rows: DataFrame, column: str, name: str = "value") -> DataFrame:
    """name, n: how often each element of an array column occurs (recovery methods, failure reasons, review reasons)."""
    return rows.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def call_summary(latest: DataFrame, by: str, numbers: list[str]) -> DataFrame:
    """by, n and the sum of each number, over the latest record of each key."""
    return latest.groupBy(by).agg(F.count("*").alias("n"), *(F.sum(c).cast("long").alias(c) for c in numbers))


def fan_out(targets: DataFrame, samples: int = 5) -> DataFrame:
    """A row for each sample of each target."""
    return targets.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def rolled_up(calls: DataFrame, key: str, ok: Column) -> DataFrame:
    """key, n_ok, status: complete, partial_failed or failed over a target's samples."""
    out = calls.groupBy(key).agg(F.count_if(ok).alias("n_ok"), F.count("*").alias("n"))
    return out.select(key, "n_ok", F.when(F.col("n_ok") == F.col("n"), "complete").when(F.col("n_ok") > 0, "partial_failed").otherwise("failed").alias("status"))


def operational_rates(results: DataFrame) -> DataFrame:
    """One row: n and the rates of each kind of outcome over results (outcome, n_attempts)."""
    n = F.count("*")
    of = lambda c: rate(F.count_if(c), n)
    o = F.col("outcome")
    return results.agg(
        n.alias("n"), of(o.isin("exact", "recovered")).alias("coverage"), of(F.col("n_attempts") > 1).alias("repair_rate"), of(o.isin("runtime_failed", "missing")).alias("failure_rate"),
        of(o.isin("recovered", "provisional", "validation_failed")).alias("issue_rate"), of(o == "provisional").alias("provisional_rate"),
    )


# The outcomes of a target.
OUTCOMES = ("exact", "recovered", "provisional", "validation_failed", "runtime_failed", "missing")


def run_figures() -> dict[str, Column]:
    """The figures of a finished run, as aggregates over a row a target.

    Columns: status, has_skill, n_spans (of its prediction, null without one), outcome, raw_status, repaired, recovered (of its
    last call), n_features, n_examples, and for each expert, trf and exemplar, a struct of available, has_skill, spans,
    space and outcome, null where the run has no experts. Nulls count for nothing.
    """
    c = F.col
    both = c("trf.available") & c("exemplar.available")
    in_target = (c("trf.space") == "target_sentence") & (c("exemplar.space") == "target_sentence")
    conditions = {
        "targets": F.lit(True), "predictions": c("status").isNotNull(), "complete": c("status") == "complete", "needs_review": c("status") == "needs_review", "positive": c("has_skill") == 1,
        "failed": c("outcome").isin("validation_failed", "runtime_failed"), "results": c("outcome") != "missing", **{f"outcome_{o}": c("outcome") == o for o in OUTCOMES},
        "validation_issues": c("outcome").isin("recovered", "provisional", "validation_failed"),
        "repair_attempted": c("repaired"), "repaired": c("repaired") & (c("raw_status") == "complete"), "recovered": c("recovered") & (c("raw_status") == "complete"),
        "no_features": c("n_features") == 0, "no_examples": c("n_examples") == 0, "one_example": c("n_examples") == 1,
        "with_experts": c("trf").isNotNull() & c("exemplar").isNotNull(), "both_experts": both, "trf_missing": ~c("trf.available"), "exemplar_missing": ~c("exemplar.available"),
        "presence_agrees": both & (c("trf.has_skill") == c("exemplar.has_skill")), "spans_agree": both & in_target & (c("trf.spans") == c("exemplar.spans")),
        "trf_provisional": c("trf.outcome") == "provisional", "exemplar_provisional": c("exemplar.outcome") == "provisional",
    }
    sums = {"spans": "n_spans", "examples": "n_examples"}
    return {k: F.count_if(v) for k, v in conditions.items()} | {k: F.coalesce(F.sum(v), F.lit(0)).cast("long") for k, v in sums.items()}


def run_summary(targets: DataFrame) -> DataFrame:
    """figure, n: run_figures() over the rows, one pass; all figures are there for an empty run too."""
    figures = run_figures()
    one = targets.agg(*(v.alias(k) for k, v in figures.items()))
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, figures)), F.array(*(F.col(k) for k in figures)))).alias("figure", "n"))


def written_with_figures(targets: DataFrame, path: str) -> dict[str, int]:
    """Writes the rows and gives run_figures() of what was written, counted while it was: the rows are made once."""
    seen = Observation()
    targets.observe(seen, *(v.alias(k) for k, v in run_figures().items())).write.parquet(path)
    return seen.get


def review_sample(rows: DataFrame, key: str, categories: list[tuple[str, Column]], quota: int, total: int) -> DataFrame:
    """key, category: up to quota rows of each category in order, each row under its first category only, then others until total.

    Within a category rows go by key. A quota is a top-k, and so is the fill.
    """
    first = F.coalesce(*(F.when(c, F.lit(i)) for i, (_, c) in enumerate(categories)), F.lit(len(categories)))
    names = F.array(*(F.lit(n) for n, _ in categories), F.lit("fill"))
    placed = rows.select(key, first.alias("__c")).withColumn("__n", F.row_number().over(Window.partitionBy("__c").orderBy(key)))
    chosen = (F.col("__c") < len(categories)) & (F.col("__n") <= quota)
    # the bar for the fill: a row of any category that its quota left out comes behind all chosen ones
    out = placed.where(F.col("__n") <= total).select(key, F.when(chosen, F.get(names, F.col("__c"))).otherwise("fill").alias("category"), (~chosen).alias("__late"))
    return out.orderBy("__late", key).limit(total).drop("__late")


def job_overlaps(jobs: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, overlap: whether all jobs of a group ran at one moment: the last start lies before the first end."""
    return jobs.groupBy(group).agg((F.max(start) < F.min(end)).cast("int").alias("overlap"))


def anchor_checks(anchors: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, passed over anchors (keys, must: keep or drop) and state (keys, active). An anchor without a state row counts as inactive."""
    both = anchors.join(state.select(*keys, "active"), keys, "left").withColumn("active", F.coalesce("active", F.lit(False)))
    return both.select(*keys, ((F.col("must") == "keep") == F.col("active")).cast("int").alias("passed"))


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the differences of F1, exact rate and negative rate of two per_target() frames, and whether after contributes.

    It contributes if one of F1 and exact rate rises, the other doesn't fall, and negatives aren't hit more often.
    """
    a = micro(before).select(F.col("f1").alias("f_a"), F.col("exact_rate").alias("e_a")).crossJoin(presence(before).select(F.col("negative_fp_rate").alias("n_a")))
    b = micro(after).select(F.col("f1").alias("f_b"), F.col("exact_rate").alias("e_b")).crossJoin(presence(after).select(F.col("negative_fp_rate").alias("n_b")))
    d = a.crossJoin(b).select(F.round(F.col("f_b") - F.col("f_a"), 9).alias("delta_f1"), F.round(F.col("e_b") - F.col("e_a"), 9).alias("delta_exact"), F.round(F.col("n_b") - F.col("n_a"), 9).alias("delta_negative"))  # one row each
    f, e = F.col("delta_f1"), F.col("delta_exact")
    return d.withColumn("contributes", ((((f > 0) & (e >= 0)) | ((e > 0) & (f >= 0))) & (F.col("delta_negative") <= 0)).cast("int"))


def leave_one_out_agreement(predicted: Column, reference: Column) -> list[Column]:
    """jaccard (1 for two empty sets) and recall (null for an empty reference)."""
    common, union = F.size(F.array_intersect(predicted, reference)), F.size(F.array_union(predicted, reference))
    return [F.round(F.when(union == 0, F.lit(1.0)).otherwise(common / union), 6).alias("jaccard"), F.round(F.try_divide(common.cast("double"), F.size(reference)), 6).alias("recall")]


def renumbered(kept: DataFrame, added: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, value, place: distinct kept values in their order, then the added ones that aren't among them."""
    rows = kept.select(key, value, F.struct(F.lit(0), F.col(order)).alias("at")).unionByName(added.select(key, value, F.struct(F.lit(1), F.col(order)).alias("at")))
    return ordered_distinct(rows, key, "at", value)
