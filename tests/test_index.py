"""Row positions: zero-based, dense and the same in every job, however a scan cuts its files."""

import contextlib

import pytest
from pyspark.sql import functions as F

from ternary_rules import Dimension, DimensionsMetadata, ExpressionRulesEngine
from ternary_rules.plans.workload import QUERIES, SQL
from ternary_rules.sources.contexts import with_index


@contextlib.contextmanager
def settings(spark, **values):
    given = {f"spark.sql.files.{k}": v for k, v in values.items()}
    kept = {k: spark.conf.get(k) for k in given}
    try:
        for k, v in given.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_orders_of_one_row_group_in_several_splits(spark, tmp_path):
    """The split that holds the middle of a row group reads it all; the others are without rows."""
    duckdb = pytest.importorskip("duckdb")
    path = f"{tmp_path}/orders.parquet"
    duckdb.sql(f"COPY (SELECT range AS o_orderkey, sha256(range::VARCHAR) AS o_comment FROM range(2000)) TO '{path}' (ROW_GROUP_SIZE 2048)")
    with settings(spark, maxPartitionBytes="16k", openCostInBytes="1k"):
        assert spark.read.parquet(path).rdd.getNumPartitions() > 2
        found = [tuple(r) for r in QUERIES["numbered_contexts"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{path}'")
    assert found == con.execute(SQL["numbered_contexts"]).fetchall() == [(2000, 0, 1999, 2000)]


@pytest.mark.parametrize("where", ["id >= 10", "id in (3, 4, 5, 9)", "id = 0", "id % 2 = 1", "id < 0", "true"])
def test_partitions_without_rows(spark, where):
    df = spark.range(0, 12, 1, 4).where(where)
    assert sorted(map(tuple, with_index(df, "i").collect())) == [(r[0], n) for n, r in enumerate(sorted(df.collect()))]


def test_partitions_that_are_cut_anew(spark, tmp_path):
    """Cores that come or go between two jobs, or new settings, change the splits of later scans."""
    path = f"{tmp_path}/rows"
    rows = spark.range(0, 40_000, 1, 1).withColumn("pad", F.sha2(F.col("id").cast("string"), 256))
    rows.write.option("parquet.block.size", "65536").option("parquet.page.size.row.check.min", "100").parquet(path)
    with settings(spark, maxPartitionBytes="200k", openCostInBytes="1k"):
        df = spark.read.parquet(path)
        before = df.rdd.getNumPartitions()
        numbered = with_index(df, "i")
    with settings(spark, maxPartitionBytes="900k", openCostInBytes="1k"):
        assert spark.read.parquet(path).rdd.getNumPartitions() < before
        assert numbered.where(F.col("i") == F.col("id")).count() == 40_000
        again = with_index(df, "j").join(numbered, "id").where("i = j")
        assert again.count() == 40_000


def test_columns_keep_their_identity(spark):
    df = spark.range(0, 12, 1, 4).where("id >= 10")
    assert sorted(map(tuple, with_index(df, "i").select(df["id"], "i").collect())) == [(10, 0), (11, 1)]


def test_batch_without_ids_numbers_contexts(spark):
    rules = spark.createDataFrame([("au", "AU"), ("any", "<NA>")], "rule_name string, region string").coalesce(1)
    contexts = spark.range(0, 12, 1, 4).where("id >= 9").select(F.when(F.col("id") == 10, "AU").otherwise("NZ").alias("region"))
    engine = ExpressionRulesEngine(rules.where("rule_name = 'au'"), DimensionsMetadata([Dimension("region")]))
    found = engine.evaluate_batch(contexts)
    assert [r[0] for r in found.matched_context_ids.collect()] == [1]
    assert [r[0] for r in found.unmatched_context_ids(contexts).collect()] == [0, 2]
