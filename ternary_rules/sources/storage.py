"""Files in any store that Spark reaches, and tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset and Spark is local (tests), one
    of our own. On a cluster executors would not share that, so there the setting is needed."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="ternary_rules_")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/rules-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop, fs = _file_system(spark, path)
    out = fs.create(hadoop, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    hadoop, fs = _file_system(spark, path)
    if not fs.exists(hadoop):
        raise FileNotFoundError(path)
    stream = fs.open(hadoop)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def read_rules(spark: SparkSession, path: str, source: str = "parquet", **options: str) -> DataFrame:
    """A rules table from any source that Spark reads; options go to the reader, such as schema DDL."""
    schema = options.pop("schema", None)
    reader = spark.read.format(source).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_result(result: DataFrame, path: str, sink: str = "parquet", mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    writer = result.write.format(sink).mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
