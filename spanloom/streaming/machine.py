"""An append-only log as a state machine of each key, kept by a stream.

A key's records come in the order of their sequence. The first one fixes the key's identity; records are attempts until
one is complete, and nothing may follow that. What a record does to its key is a row: an attempt that counts, or a
violation. Keys that failed and then are silent for some time are due for another attempt, by a timer on event time.
State is a few numbers a key, in the store that the checkpoint holds, so a stream that is stopped goes on where it was,
and batches that are made again give the rows that they gave.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What a record, or a timer, does to its key.
ATTEMPT, COMPLETE, LATE, CHANGED, AFTER, DUE = "attempt", "complete", "out_of_order", "identity_changed", "after_complete", "due"

_STATE = StructType([StructField("identity", StringType()), StructField("last", LongType()), StructField("attempts", LongType()), StructField("complete", BooleanType()), StructField("timer", LongType())])


class LogMachine(StatefulProcessor):
    """Rows (keys, sequence, complete, identity, at) to rows (keys, sequence, event, attempt)."""

    def __init__(self, keys: Sequence[str], patience_ms: int):
        self.keys, self.patience = list(keys), patience_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("log", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        records = sorted((r for part in rows for r in part[["sequence", "complete", "identity", "at"]].itertuples(index=False)), key=lambda r: r[0])
        identity, last, attempts, complete, timer = self.state.get() if self.state.exists() else (None, None, 0, False, None)
        sequences, events, numbers = [], [], []
        for sequence, done, own, at in records:
            own = None if pd.isna(own) else str(own)
            if last is not None and own != identity:
                event = CHANGED
            elif last is not None and sequence <= last:
                event = LATE
            elif complete:
                event = AFTER
            else:
                identity, last, attempts, complete = own, int(sequence), attempts + 1, bool(done)
                event = COMPLETE if complete else ATTEMPT
                if self.patience:
                    if timer is not None:
                        self.handle.deleteTimer(timer)
                    timer = None if complete else int(at) + self.patience
                    if timer is not None:
                        self.handle.registerTimer(timer)
            sequences.append(int(sequence))
            events.append(event)
            numbers.append(attempts)
        self.state.update((identity, last, attempts, complete, timer))
        yield self._rows(key, sequences, events, numbers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        identity, last, attempts, complete, _ = self.state.get()
        self.state.update((identity, last, attempts, complete, None))
        yield self._rows(key, [last], [DUE], [attempts])

    def _rows(self, key: tuple, sequences: list, events: list, numbers: list) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] * len(events) for k, v in zip(self.keys, key, strict=True)}, "sequence": sequences, "event": events, "attempt": numbers})

    def close(self) -> None:
        pass


def log_events(stream: DataFrame, keys: Sequence[str], sequence: str, complete, identity, time: str | None = None, patience: int = 0, late: str = "0 seconds") -> DataFrame:
    """keys, sequence, event, attempt of a stream of records.

    complete and identity are columns. With time, a timestamp column, and patience in seconds, keys that failed become
    due when the watermark, late behind the newest record, has passed that long without another attempt. Null
    identities are equal. Null keys are a key. A record that is late in its key is a violation and changes nothing.
    """
    kinds = dict(stream.dtypes)
    rows = stream if time is None else stream.withWatermark(time, late)
    at = F.lit(0).cast("long") if time is None else F.unix_millis(F.col(time))
    rows = rows.select(*keys, F.col(sequence).cast("long").alias("sequence"), complete.alias("complete"), identity.cast("string").alias("identity"), at.alias("at"), *([] if time is None else [F.col(time).alias("__time")]))
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", sequence long, event string, attempt long"
    return rows.groupBy(*keys).transformWithStateInPandas(LogMachine(keys, patience * 1000), schema, "Append", "EventTime" if time else "None")


def follow(spark: SparkSession, source: str, schema, output: str, checkpoint: str, keys: Sequence[str], sequence: str, complete, identity, pattern: str = "*", files: int | None = None, time: str | None = None, patience: int = 0) -> DataFrame:
    """All events of the log below source so far: what is new there is read, in order of its files, and its events appended to output."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)  # only this store keeps such state
    try:
        reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        stream = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(source)
        found = log_events(stream, keys, sequence, complete, identity, time, patience)
        found.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.parquet(output)
