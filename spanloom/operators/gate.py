"""Gates over judged candidates: selection, ordered reasons, rates, strata, dense distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def select(judged: DataFrame, key: str, minimum: int = 3) -> DataFrame:
    """judged with gate_rank: rows scoring over minimum whose role isn't irrelevant, numbered by retrieval_rank; null for the others. No caps."""
    kept = (F.col("score") > minimum) & (F.col("role") != "irrelevant")
    before = F.count_if(kept).over(Window.partitionBy(key).orderBy("retrieval_rank"))
    return judged.withColumn("gate_rank", F.when(kept, before))


def reasons(*conditions: tuple[Column, str]) -> Column:
    """Ordered reasons: the texts whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(text)) for c, text in conditions)))


def selection_records(gated: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, n_selected, status and reasons for each target of select()."""
    n = F.count("gate_rank").alias("n_selected")
    out = gated.groupBy(key).agg(n)
    why = reasons((F.col("n_selected") == 0, "no_helpful_examples"), ((F.col("n_selected") > 0) & (F.col("n_selected") < least), "insufficient_helpful_examples"))
    return out.withColumn("reasons", why).withColumn("status", F.when(F.size("reasons") > 0, "needs_review").otherwise("complete"))


def rate(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """Null over zero."""
    return F.round(F.try_divide(numerator.cast("double"), denominator.cast("double")), digits)


def retention(gated: DataFrame, by: str) -> DataFrame:
    """by, n, kept, kept_rate, mean_score."""
    return gated.groupBy(by).agg(F.count("*").alias("n"), F.count("gate_rank").alias("kept"), rate(F.count("gate_rank"), F.count("*")).alias("kept_rate"), F.round(F.avg("score"), 6).alias("mean_score"))


def distribution(rows: DataFrame, column: str, values: range) -> DataFrame:
    """Counts of each value, zeros included."""
    spark = rows.sparkSession
    dense = spark.range(values.start, values.stop).select(F.col("id").cast("int").alias(column))
    return dense.join(rows.groupBy(F.col(column).cast("int").alias(column)).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])


def strata(candidates: DataFrame, key: str, accepted: str) -> DataFrame:
    """key and its sorted strata, from candidates (key, accepted boolean, gate_rank)."""
    n = candidates.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(accepted)).alias("pos"), F.count_if(~F.col(accepted)).alias("neg"), F.count("gate_rank").alias("selected"))
    labels = reasons(
        (F.col("pos") == F.col("n"), "all_candidates_accepted"), (F.col("neg") >= 8, "eight_or_more_negative"), ((F.col("pos") > 0) & (F.col("neg") > 0), "both_classes"),
        (F.col("selected") == 0, "selected_none"), (F.col("selected") == 1, "selected_one"),
    )
    return n.select(key, F.array_sort(labels).alias("strata"))
