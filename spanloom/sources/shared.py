"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset a temporary folder serves, but only if driver and executors are one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def in_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """df, written to the shared folder in buckets of key and read back: joins, groups and windows by key need no shuffle then.

    It is an external table of the session's catalog, with a name of its own.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # joins by the key and more shuffle otherwise
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    path = fresh_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).options(path=path, compression="zstd").saveAsTable(table, format="parquet")
    return spark.table(table)
