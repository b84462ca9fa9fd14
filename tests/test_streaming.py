"""Contexts as a stream give what the same contexts give as a batch."""

from pyspark.sql import functions as F

from ternary_rules import Dimension, DimensionsMetadata, ExpressionRulesEngine
from ternary_rules.streaming.adapter import evaluate_stream, score_stream


def test_stream_equals_batch(spark, tmp_path):
    rules = spark.createDataFrame([("any", "<NA>"), ("au", "AU")], "rule_name string, region string").coalesce(1)
    engine = ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("region")]))
    contexts = spark.createDataFrame([(i, "AU" if i % 2 else "NZ") for i in range(20)], "id int, region string")
    contexts.write.parquet(str(tmp_path / "in"))
    batch = engine.evaluate_batch(contexts, context_id_field="id").survivors
    stream = spark.readStream.schema(contexts.schema).parquet(str(tmp_path / "in"))
    found = []
    query = evaluate_stream(engine, stream, lambda r, n: found.extend(r.survivors.select("__context_id", "rule_name", "__rank").collect()), context_id_field="id").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, found)) == sorted(map(tuple, batch.select("__context_id", "rule_name", "__rank").collect()))
    query = score_stream(engine, stream, "id").writeStream.format("memory").queryName("scored").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").count() == batch.count() == spark.table("scored").where(F.col("__specificity") >= 0).count()
