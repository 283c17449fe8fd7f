"""Joins of evidence branches on keys: exact 1:1:1 contexts, outer joins of experts, agreement, first examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def contexts(targets: DataFrame, branches: Sequence[DataFrame], keys: Sequence[str], aligned: Sequence[str] = ()) -> DataFrame:
    """targets with each branch on its keys; rows whose aligned columns differ are left out (see misaligned)."""
    out = targets
    for branch in branches:
        names = {c: f"__{c}" for c in aligned if c in branch.columns}
        out = out.join(branch.withColumnsRenamed(names), list(keys))
        for c, other in names.items():
            out = out.where(F.col(c).eqNullSafe(F.col(other))).drop(other)
    return out


def misaligned(targets: DataFrame, branch: DataFrame, keys: Sequence[str], aligned: Sequence[str]) -> DataFrame:
    """Keys that both have but whose aligned columns differ."""
    both = targets.select(*keys, *aligned).join(branch.select(*keys, *(F.col(c).alias(f"__{c}") for c in aligned)), list(keys))
    different = F.exists(F.array(*(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in aligned)), lambda same: ~same)
    return both.where(different).select(*keys)


def proposals(base: DataFrame, expert: DataFrame, key: str, name: str, outcome: str) -> DataFrame:
    """base with <name>_availability and <name>_space; an expert without a row is unavailable."""
    e = expert.select(key, F.col(outcome).alias("__o"))
    usable = F.col("__o").isin("exact", "recovered", "provisional")
    space = F.when(F.col("__o").isin("exact", "recovered"), "target_sentence").when(F.col("__o") == "provisional", "model_sentence")
    out = base.join(e, key, "left").withColumn(f"{name}_availability", F.when(F.coalesce(usable, F.lit(False)), "available").otherwise("unavailable"))
    return out.withColumn(f"{name}_space", space).drop("__o")


def agreement(a: Column, b: Column) -> Column:
    """Of two span arrays: missing, exact, presence or none."""
    return (
        F.when(a.isNull() | b.isNull(), "missing").when(F.array_sort(a) == F.array_sort(b), "exact").when((F.size(a) > 0) == (F.size(b) > 0), "presence").otherwise("none")
    )


def first_examples(rows: DataFrame, key: str, rank: str, maximum: int = 8) -> DataFrame:
    """The first rows of each key by rank."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(rank))).where(F.col("__n") <= maximum).drop("__n")


def ordered_distinct(rows: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """key, value, place: each key's distinct values in the order in which they first occur."""
    first = rows.groupBy(key, value).agg(F.min(position).alias("__first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("__first"))).drop("__first")


def selected(rows: DataFrame, identities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of the identities asked for."""
    return rows.join(identities.select(*keys).distinct(), list(keys), "left_semi")


def missing_identities(rows: DataFrame, identities: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Identities asked for that no row has."""
    return identities.select(*keys).distinct().join(rows.select(*keys), list(keys), "left_anti")


def reordered(items: Column, ids: Column, key: str) -> Column:
    """The items (array of structs) in the order of ids; an id without an item is null."""
    return F.transform(ids, lambda i: F.get(F.filter(items, lambda x: x[key] == i), F.lit(0)))


def review_reasons(trf_status: Column, exemplar_status: Column, examples: Column, experts: dict[str, Column]) -> Column:
    """Ordered reasons why a target needs review; disagreement of experts isn't one."""
    cases = [
        F.when(trf_status == "needs_review", "trf_context_needs_review"), F.when(exemplar_status == "needs_review", "exemplar_context_needs_review"),
        F.when(examples == 0, "no_helpful_examples"), F.when(examples == 1, "insufficient_helpful_examples"),
        *(F.when(availability != "available", f"expert_prediction_missing:{name}") for name, availability in experts.items()),
    ]
    return F.array_compact(F.array(*cases))


def labelled(rows: DataFrame, text: str, classes: DataFrame, phrase: str = "phrase") -> DataFrame:
    """rows with the columns of a labelled table whose phrase is the text, whatever its case; null without one."""
    keyed = classes.withColumn("__key", F.lower(F.trim(phrase))).drop(phrase)
    return rows.withColumn("__key", F.lower(F.trim(text))).join(keyed, "__key", "left").drop("__key")
