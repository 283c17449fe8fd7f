"""Append-only logs and outcomes: compaction, invariants, pending work, attempts, costs, outcome cases, issues, quotas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest(log: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The last record of each key. An aggregate, so a key with very many records is combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("last"))
    return last.select(*keys, *(F.col("last")[c].alias(c) for c in rest))


def retried_after_complete(log: DataFrame, keys: Sequence[str], sequence: str, complete: Column) -> DataFrame:
    """Records that follow a complete one of their key."""
    done = log.where(complete).groupBy(*keys).agg(F.min(sequence).alias("first_complete"))
    return log.join(done, list(keys)).where(F.col(sequence) > F.col("first_complete"))


def pending(work: DataFrame, log: DataFrame, keys: Sequence[str], complete: Column) -> DataFrame:
    """Work without a complete record of the same keys (put the prompt's hash among them)."""
    return work.join(log.where(complete).select(*keys).distinct(), list(keys), "left_anti")


def attempts(log: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """log with attempt, from 1, and kind: initial or repair."""
    out = log.withColumn("attempt", F.row_number().over(Window.partitionBy(*keys).orderBy(sequence)))
    return out.withColumn("kind", F.when(F.col("attempt") == 1, "initial").otherwise("repair"))


def outcomes(prompts: DataFrame, predictions: DataFrame, failures: DataFrame, key: str) -> DataFrame:
    """key, outcome, coordinate_space, validation_issue for every prompt.

    predictions (key, recovered boolean), failures (key, kind, eligible boolean, provisional boolean). A key in neither
    is missing; one in both is a conflict.
    """
    p = predictions.select(key, F.lit(True).alias("has_p"), "recovered")
    f = failures.select(key, F.lit(True).alias("has_f"), "kind", "eligible", "provisional")
    both = prompts.select(key).join(p, key, "left").join(f, key, "left")
    outcome = (
        F.when(F.col("has_p") & F.col("has_f"), "conflict").when(F.col("has_p") & F.col("recovered"), "recovered").when(F.col("has_p"), "exact")
        .when(F.col("eligible") & F.col("provisional"), "provisional").when(F.col("eligible"), "validation_failed")
        .when(F.col("has_f").isNull() | (F.col("kind") == "missing_raw"), "missing").otherwise("runtime_failed")
    )
    space = F.when(F.col("outcome").isin("exact", "recovered"), "target_sentence").when(F.col("outcome") == "provisional", "model_sentence")
    return both.withColumn("outcome", outcome).select(key, "outcome", space.alias("coordinate_space"), F.col("outcome").isin("recovered", "provisional", "validation_failed").cast("int").alias("validation_issue"))


def merged_issues(events: DataFrame, key: str, sequence: str, stage: str) -> DataFrame:
    """key, stages (distinct, as first seen) and n_events."""
    first = events.groupBy(key, stage).agg(F.min(sequence).alias("first"), F.count("*").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("first", stage)))
    return first.groupBy(key).agg(F.transform(order, lambda x: x[stage]).alias("stages"), F.sum("n").alias("n_events"))


def completion(results: DataFrame, issues: DataFrame, key: str, expected: Column, maximum_rate: float = 0.03) -> DataFrame:
    """One row: n_results, n_unique, n_blocking, n_affected, allowed and within. results (key, outcome); issues (key)."""
    r = results.agg(F.count("*").alias("n_results"), F.count_distinct(key).alias("n_unique"), F.count_if(F.col("outcome").isin("runtime_failed", "missing")).alias("n_blocking"), F.max(expected).alias("n_expected"))
    i = issues.agg(F.count_distinct(key).alias("n_affected"))
    both = r.crossJoin(F.broadcast(i))  # one row each
    allowed = F.floor(F.col("n_expected") * maximum_rate + 1e-12).cast("long")
    within = (F.col("n_results") == F.col("n_expected")) & (F.col("n_unique") == F.col("n_expected")) & (F.col("n_blocking") == 0) & (F.col("n_affected") <= F.col("allowed"))
    return both.withColumn("allowed", allowed).withColumn("within", within.cast("int")).drop("n_expected")
