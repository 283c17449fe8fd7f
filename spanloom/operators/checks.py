"""Constraints over relations, as frames of violations: an empty frame means that the constraint holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHA256 = "^[0-9a-f]{64}$"


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are null or occur more than once, with their number of rows."""
    null = F.greatest(*(F.col(k).isNull().cast("int") for k in keys)) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).where((F.col("n_rows") > 1) | (null == 1))


def coverage(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that only one side has, and which: exact coverage is an empty frame."""
    only_left = left.select(*keys).distinct().join(right.select(*keys).distinct(), list(keys), "left_anti").withColumn("only_in", F.lit("left"))
    only_right = right.select(*keys).distinct().join(left.select(*keys).distinct(), list(keys), "left_anti").withColumn("only_in", F.lit("right"))
    return only_left.unionByName(only_right)


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repetitions, that the two frames don't share: a replay that agrees gives none."""
    columns = left.columns
    return left.exceptAll(right.select(*columns)).withColumn("only_in", F.lit("left")).unionByName(right.select(*columns).exceptAll(left).withColumn("only_in", F.lit("right")))


def identity_ok(*columns: str) -> Column:
    """Key columns are there and not blank."""
    return F.forall(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), lambda c: F.trim(c) != "")


def sha256_ok(column: str) -> Column:
    return F.coalesce(F.col(column).rlike(SHA256), F.lit(False))


def finite_vector_ok(column: str, dimensions: int) -> Column:
    """An array of so many finite numbers that isn't all zeros."""
    v = F.col(column)
    norm = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dimensions) & finite & (norm > 0), F.lit(False))


def one_value(text: Column) -> Column:
    """The text is one JSON value, its objects without repeated keys, and nothing around it; false for a null.

    Spark's parser stops behind the first value. So the text must be a value inside brackets and inside an object too:
    what follows it can't close both.
    """
    inside = (F.concat(F.lit("["), text, F.lit("]")), F.concat(F.lit('{"a":'), text, F.lit("}")))
    return F.try_parse_json(inside[0]).isNotNull() & F.try_parse_json(inside[1]).isNotNull()


def exact_keys(column: str, keys: Sequence[str]) -> Column:
    """A JSON object with just these keys, see one_value(); false for a null."""
    found = F.array_sort(F.json_object_keys(F.col(column)))
    return F.coalesce(one_value(F.col(column)) & (found == F.array(*(F.lit(k) for k in sorted(keys)))), F.lit(False))
