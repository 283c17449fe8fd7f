"""Append-only logs as streams: the latest record of each key is kept up to date batch by batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.results import latest


def latest_stream(stream: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """The streaming form of latest(): an update-mode aggregate whose state is one record a key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), sequence).alias("last")).select(*keys, *(F.col("last")[c].alias(c) for c in rest))


def compact(spark: SparkSession, source: str, schema, output: str, checkpoint: str, keys: Sequence[str], sequence: str, pattern: str = "*") -> DataFrame:
    """Reads what is new below source, appends each batch's latest records to output, and returns the latest of all.

    A batch that is written again after a failure only repeats records, which compaction ignores.
    """
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        latest(batch, keys, sequence).write.mode("overwrite").parquet(f"{output}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return latest(spark.read.parquet(output).drop("batch"), keys, sequence)


def windowed_counts(stream: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts by event time; rows later than the watermark are dropped and state is bounded by it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))
