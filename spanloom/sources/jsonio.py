"""JSON relations: whole files, lines and wrapped records as sources; line tables, appends and snapshots as sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType, missing_ok: bool = True) -> DataFrame:
    """A row for each line; a malformed line fails the read. A path that isn't there is an empty relation."""
    if missing_ok and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """path and text of the lines that read_jsonl() would fail on."""
    with_bad = StructType([*schema.fields]).add("_corrupt_record", "string")
    lines = spark.read.text(path).withColumn("path", F.input_file_name()).where(F.trim("value") != "")
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return lines.where(parsed["_corrupt_record"].isNotNull()).select("path", F.col("value").alias("line"))


def read_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """By suffix: .jsonl lines; .json an array, or an object with the array under records."""
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    wrapped = spark.read.schema(f"records array<{schema.simpleString()}>").option("multiLine", True).json(path)
    rows = wrapped.where("records is not null").select(F.inline("records"))
    return rows if not rows.isEmpty() else spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_manifest(spark: SparkSession, path: str) -> dict:
    """A small JSON document, for the driver."""
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 and bytes of each file there."""
    return spark.read.format("binaryFile").load(path).select(F.col("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Lines with nulls spelled out; mode append makes an append-only log, errorifexists a snapshot."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def freeze(relations: dict[str, DataFrame], root: str) -> dict[str, str]:
    """Writes each relation once below root, as Parquet; fails where a snapshot is already."""
    paths = {name: f"{root}/{name}" for name in relations}
    for name, df in relations.items():
        df.write.mode("errorifexists").parquet(paths[name])
    return paths


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Renames a finished snapshot to where consumers look: nobody sees half of one."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (staged, final))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) or not fs.rename(source, target):
        raise AnalysisException(f"can't publish to {final}")


def withdraw(spark: SparkSession, final: str) -> bool:
    """Removes a published snapshot, as a failed parent run does."""
    path = spark._jvm.org.apache.hadoop.fs.Path(final)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def publish_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is whole or not there: written aside, then renamed over what was there."""
    import uuid

    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, aside = fs_path(path), fs_path(f"{path}.{uuid.uuid4().hex}")
    conf = spark._jsc.hadoopConfiguration()
    out = aside.getFileSystem(conf).create(aside, True)
    out.write(text.encode())
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf)
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(aside, target, overwrite)
