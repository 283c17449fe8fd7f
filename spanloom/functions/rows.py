"""Rows out of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, values: Column, name: str, *keep: str | Column) -> DataFrame:
    """keep and name: a row for each element of values that isn't null.

    explode() makes the optimizer test the array's size below it, which computes the array several times; its outer
    variant doesn't, and the test for null behind it is cheap.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def once(df: DataFrame, value: Column, name: str, *keep: str | Column) -> DataFrame:
    """keep and name: value, computed once a row however often name is used behind. Rows where it is null are kept.

    A plain column would be copied into every place that uses it.
    """
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))
