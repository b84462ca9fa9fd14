"""Shared pieces: tables, the shared folder for cut lineage, Arrow batch sizes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of one Arrow batch; a single longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

_own_dir: str | None = None
_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes that one Arrow batch carries to Python, for texts of any length."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


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


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there, and a
    lost executor costs no more than the reading of some files."""
    spark = df.sparkSession
    path = path or f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(discard_all)
    _written.append(path)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard_all() -> None:
    """Deletes all tables that stored() wrote; nothing that reads them may be pending. Runs at exit."""
    spark = SparkSession.getActiveSession()
    paths, _written[:] = list(_written), []
    try:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # noqa: BLE001  the session is gone already; its folder stays with the cluster
        return


def discard(df: DataFrame) -> None:
    """Deletes the files of a stored() table that nothing will read again."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/stored-" in parent:
            path = jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def sha256_text(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


#: Keys that count as hot at most; they hold over 1/HOT_KEYS of all rows each, so there are no more.
HOT_KEYS = 10_000
LEAST_HOT = 64


def join_skewed(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """many joined to one, which has a row for each key at most. A key with over 1/HOT_KEYS of the
    rows of many, of which there are HOT_KEYS at most, meets its row by a broadcast, so no task
    gets all rows of a key; the others are joined by hash. many should be a stored table."""
    total = many.count()
    hot = many.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(LEAST_HOT, total // HOT_KEYS)).select(*keys)
    hot = stored(hot)
    if hot.isEmpty():
        return many.join(one, keys, how)
    few = F.broadcast(one.join(F.broadcast(hot), keys, "left_semi"))
    hot_rows = many.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    return hot_rows.unionByName(many.join(F.broadcast(hot), keys, "left_anti").join(one, keys, how))


def shielded(df: DataFrame, needed: tuple[str, ...]) -> DataFrame:
    """df with all columns but those needed renamed, so that none clashes with a working column."""
    return df.select(*[F.col(f"`{c}`").alias(c if c in needed else f"__keep_{k}") for k, c in enumerate(df.columns)])


def restored(df: DataFrame, names: list[str], needed: tuple[str, ...], outputs: tuple[str, ...] = ()) -> DataFrame:
    """The columns of a shielded() table under their own names, then outputs; a column that has the
    name of an output makes room for it."""
    kept = [F.col(c if c in needed else f"__keep_{k}").alias(c) for k, c in enumerate(names) if c not in outputs]
    return df.select(*kept, *outputs)


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
