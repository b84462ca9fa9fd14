"""Contexts: one record as literals, or a table of them as prepared columns."""

from __future__ import annotations

from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ternary_rules.functions.sentinels import filled, literal, not_set_sentinel_for
from ternary_rules.functions.strategies import ctx
from ternary_rules.plans.model import DataType, Dimension

RESERVED = ("__context_id", "__global_idx", "__grp_base", "__rule_index", "__survived", "__specificity", "__rank")


def reject_reserved(df: DataFrame, what: str) -> None:
    taken = [c for c in df.columns if c in RESERVED or c.startswith(("__ctx_", "__t_", "__cell_", "__low_", "__high_", "__value_"))]
    if taken:
        raise ValueError(f"{what} hold reserved column names: {', '.join(taken)}")


def as_mapping(context: Any) -> dict[str, Any]:
    if isinstance(context, dict):
        return context
    if isinstance(context, Row):
        return context.asDict()
    if is_dataclass(context) and not isinstance(context, type):
        return asdict(context)
    if hasattr(context, "model_dump"):
        return context.model_dump()
    raise TypeError(f"a context is a dict, Row, dataclass or model, not {type(context).__name__}")


def extract_context_values(context: Any, dimensions: list[Dimension] | list[str]) -> dict[str, Any]:
    """By dimension name: the value of the dimension's context field; missing or None gives the mark
    of a missing value of the dimension's type."""
    given = as_mapping(context)
    out = {}
    for d in dimensions:
        name, field, kind = (d, d, DataType.STR) if isinstance(d, str) else (d.dimension_name, d.resolved_context_field, d.data_type)
        value = given.get(field)
        out[name] = not_set_sentinel_for(kind) if value is None or value != value else value
    return out


def context_literals(context: Any, dimensions: list[Dimension]) -> dict[str, Column]:
    values = extract_context_values(context, dimensions)
    return {ctx(d.dimension_name): literal(values[d.dimension_name], d.data_type) for d in dimensions}


def fixed_parts(df: DataFrame) -> DataFrame:
    """df over the partitions that it has now, in every later job: a scan cuts its files anew in each
    job, by the cores that are there by then. Calls on one df give the same partitions. Columns keep
    their identity; the scan reads all of them."""
    jvm = df.sparkSession.sparkContext._jvm
    rows = df._jdf.queryExecution().toRdd()
    plan = getattr(getattr(jvm.org.apache.spark.sql.execution, "LogicalRDD$"), "MODULE$").fromDataset(rows, df._jdf, False)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df._jdf.sparkSession(), plan), df.sparkSession)


def with_index(df: DataFrame, name: str) -> DataFrame:
    """df with zero-based row positions, in the order of its partitions. One small job counts the
    partitions' rows; no row moves. A lost part of a shuffle may come back in another order: a table
    that is computed by a shuffle should be written first, or bring a column to order by."""
    fixed, at = fixed_parts(df), F.monotonically_increasing_id()
    counts = fixed.select(F.spark_partition_id().alias("p")).groupBy("p").count().orderBy("p").collect()  # a row per partition
    if not counts or counts[-1]["p"] == 0:
        return fixed.withColumn(name, at)
    offsets, total = [0] * (counts[-1]["p"] + 1), 0  # partitions without rows, which need none, may come first
    for r in counts:
        offsets[r["p"]] = total
        total += r["count"]
    base = F.array(*[F.lit(x).cast("bigint") for x in offsets])
    numbered = fixed.withColumn(name, at)
    return numbered.withColumn(name, F.get(base, F.shiftright(F.col(name), 33).cast("int")) + F.col(name).bitwiseAND(F.lit((1 << 33) - 1)))


def prepare_contexts(contexts: DataFrame, dimensions: list[Dimension], context_id_field: str | None, check: bool = True) -> DataFrame:
    """`__context_id` and one `__ctx_<dimension>` per dimension; nulls become marks of missing values."""
    reject_reserved(contexts, "contexts")
    have = set(contexts.columns)
    if context_id_field is not None:
        if context_id_field not in have:
            raise ValueError(f"contexts have no column '{context_id_field}'")
        if check and not contexts.isStreaming:
            ids = contexts.select(context_id_field)
            if not ids.where(F.col(context_id_field).isNull()).isEmpty():
                raise ValueError(f"'{context_id_field}' holds nulls")
            twice = ids.groupBy(context_id_field).count().where("count > 1").limit(3).collect()
            if twice:
                raise ValueError(f"'{context_id_field}' is not unique: {[r[0] for r in twice]}")
        numbered, identity = contexts, F.col(context_id_field)
    else:
        numbered, identity = with_index(contexts, "__context_id"), F.col("__context_id")
    columns = [identity.alias("__context_id")]
    for d in dimensions:
        value = F.col(f"`{d.resolved_context_field}`") if d.resolved_context_field in have else F.lit(None)
        columns.append(filled(value, d.data_type).alias(ctx(d.dimension_name)))
    return numbered.select(*columns)
