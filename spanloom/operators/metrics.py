"""Evaluation of span sets: micro and presence scores, exact sets, changes, correlation, samples, paired bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import draws


def per_target(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """key, tp, fp, fn, covered, exact, gold_has, pred_has over (key, spans array). A missing prediction is empty, but never exact."""
    empty = F.expr("slice(gold, 1, 0)")
    both = gold.select(key, F.col("spans").alias("gold")).join(predicted.select(key, F.col("spans").alias("pred"), F.lit(1).alias("covered")), key, "left")
    both = both.withColumn("pred", F.coalesce("pred", empty)).fillna(0, ["covered"])
    return both.select(
        key, F.size(F.array_intersect("gold", "pred")).alias("tp"), F.size(F.array_except("pred", "gold")).alias("fp"), F.size(F.array_except("gold", "pred")).alias("fn"), "covered",
        ((F.col("covered") == 1) & (F.array_sort(F.array_distinct("gold")) == F.array_sort(F.array_distinct("pred")))).cast("int").alias("exact"),
        (F.size("gold") > 0).cast("int").alias("gold_has"), (F.size("pred") > 0).cast("int").alias("pred_has"),
    )


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; 0 over zero."""
    p, r = _share(tp, tp + fp), _share(tp, tp + fn)
    return [F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(_share(2 * p * r, p + r), 9).alias("f1")]


def micro(targets: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1, exact_rate, coverage."""
    s = targets.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "exact", "covered")), F.count("*").alias("n"))
    return s.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), F.round(_share(F.col("exact"), F.col("n")), 9).alias("exact_rate"), F.round(_share(F.col("covered"), F.col("n")), 9).alias("coverage"))


def presence(targets: DataFrame) -> DataFrame:
    """One row: presence precision, recall, f1 and the rate of predictions among empty gold sets."""
    g, p = F.col("gold_has") == 1, F.col("pred_has") == 1
    s = targets.agg(F.count_if(g & p).alias("tp"), F.count_if(~g & p).alias("fp"), F.count_if(g & ~p).alias("fn"), F.count_if(~g).alias("negatives"))
    return s.select(*prf(F.col("tp"), F.col("fp"), F.col("fn")), F.round(_share(F.col("fp"), F.col("negatives")), 9).alias("negative_fp_rate"))


def jaccard(a: Column, b: Column, digits: int = 10) -> Column:
    """1 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.round(F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union), digits)


def changes(before: Column, after: Column) -> Column:
    """Struct of retained, promoted, removed (sorted) and the Jaccard of two id sets."""
    return F.struct(F.array_sort(F.array_intersect(before, after)).alias("retained"), F.array_sort(F.array_except(after, before)).alias("promoted"), F.array_sort(F.array_except(before, after)).alias("removed"), jaccard(before, after).alias("jaccard"))


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, n, r (6 decimals); null below two rows or without variance."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.corr(x, y)
    flat = (F.count("*") < 2) | (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.when(~flat & ~F.isnan(r), F.round(r, 6)).alias("r"))


def quota_sample(rows: DataFrame, category: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """The first rows of each category, up to its quota."""
    limit = F.lit(0)
    for name, n in quotas.items():
        limit = F.when(F.col(category) == name, n).otherwise(limit)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(*order))).where(F.col("place") <= limit)


def priority_sample(rows: DataFrame, key: str, first: Column, n: int, seed: int = 0) -> DataFrame:
    """n rows: those where first holds before the others, within each by a hash of key and seed. The hash stands for a seeded shuffle."""
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    return rows.withColumn("__first", first.cast("int")).withColumn("__drawn", drawn).orderBy(F.col("__first").desc(), "__drawn").limit(n).drop("__first", "__drawn")


def paired_bootstrap(pairs: DataFrame, key: str, replicates: int = 2000, seed: int = 42) -> DataFrame:
    """One row: the 2.5 and 97.5 percent bounds of the differences of F1 and exact rate of two systems.

    pairs (key, a_tp, a_fp, a_fn, a_exact, b_…, one row a target). A replicate draws as many targets as there are, with
    replacement, in the order of key, as random.Random(seed).choice does; see draws. Without a target the bounds are null.
    """
    names = [f"{s}_{c}" for s in "ab" for c in ("tp", "fp", "fn", "exact")]
    sums, n = draws.replicate_sums(pairs, key, names, replicates, seed)

    def f1(s: str) -> Column:
        p, r = (_share(F.col(f"{s}_tp"), F.col(f"{s}_tp") + F.col(f"{s}_{c}")) for c in ("fp", "fn"))
        return _share(F.lit(2.0) * p * r, p + r)

    exact = lambda s: F.col(f"{s}_exact") / F.lit(float(n or 1))
    bounds = draws.interval(f1("b") - f1("a"), replicates) + draws.interval(exact("b") - exact("a"), replicates)
    return sums.agg(*(b.alias(name) for b, name in zip(bounds, ("f1_low", "f1_high", "exact_low", "exact_high"), strict=True)))
