"""What the operators share: session settings, the shared folder, tables and hash splits."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch sent to a Python worker, so that long texts don't add up to large batches.
BATCH_BYTES = 4 << 20
#: Rows of an Arrow batch.
BATCH_ROWS = 2000

_scratch: list[str] = []


def tune(spark: SparkSession) -> None:
    """Bounds Arrow batches, unless the session already has its own bounds."""
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", None, BATCH_BYTES),
    ):
        if default is None or spark.conf.get(key) == default:
            spark.conf.set(key, str(value))


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset a temporary folder serves, but only if driver and executors are one process.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local["):
            if sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: its lineage ends at files that outlive executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes the tables that materialize() wrote in this process; results that still read them become invalid."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """True where crc32(key as text) mod folds is fold; a null key is in no fold."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """At most so many rows, chosen by a hash of the key: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(rows)


def text_udf(prepare: Callable[[], Callable[[list], list]], returns: str, arrow: pa.DataType):
    """A column function over whole texts, by Arrow batches. prepare() runs once a task and gives the batch function."""

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = prepare()
        for batch in batches:
            yield pa.array(work(batch.to_pylist()), type=arrow)

    return run
