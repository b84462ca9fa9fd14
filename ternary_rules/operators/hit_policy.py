"""How survivors are ordered, checked and cut: the hit policies."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternary_rules.plans.model import DimensionsMetadata, HitPolicy

ONE_ROW = (HitPolicy.FIRST, HitPolicy.PRIORITY, HitPolicy.ANY)


class HitPolicyViolationError(ValueError):
    """An assertion failed; `offending` is a DataFrame of all survivors of the contexts concerned."""

    def __init__(self, policy: HitPolicy, offending: Any, message: str):
        super().__init__(message)
        self.policy, self.offending = policy, offending


@dataclass(frozen=True)
class SelectionInfo:
    dimension_rule_fields: tuple[str, ...]
    priority_field: str | None
    output_fields: tuple[str, ...]
    truncated: bool
    observability: bool


def selection_info_from_metadata(metadata: DimensionsMetadata | None, priority_field: str | None, observability: bool) -> SelectionInfo:
    if metadata is None:
        return SelectionInfo((), priority_field, (), False, observability)
    conditions = tuple(f for d in metadata.dimensions for f in d.rule_fields)
    return SelectionInfo(conditions, priority_field or metadata.priority_field, tuple(metadata.output_fields), False, observability)


def default_output_fields(columns: list[str], info: SelectionInfo) -> list[str]:
    """All columns that state no condition, name no rule, set no priority and are not our own."""
    apart = {*info.dimension_rule_fields, "rule_name", info.priority_field}
    return [c for c in columns if c not in apart and not c.startswith("__")]


def ordering_keys(policy: HitPolicy, priority_field: str | None) -> list[Column]:
    specific, order = F.col("__specificity").desc(), F.col("__rule_index").asc()
    if policy is HitPolicy.PRIORITY:
        if not priority_field:
            raise ValueError("hit policy PRIORITY needs priority_field")
        return [F.col(f"`{priority_field}`").desc_nulls_last(), specific, order]
    return [order] if policy in (HitPolicy.FIRST, HitPolicy.RULE_ORDER) else [specific, order]


def check_assertions(survivors: DataFrame, policy: HitPolicy, info: SelectionInfo, keys: list[str]) -> None:
    """One small job over the full survivor set; keys: the columns that tell contexts apart."""
    if policy is HitPolicy.UNIQUE:
        bad = survivors.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
        what = "UNIQUE, but more than one rule survives"
    elif policy is HitPolicy.ANY:
        outputs = list(info.output_fields) or (default_output_fields(survivors.columns, info) if info.dimension_rule_fields else [])
        if not outputs:
            raise ValueError("hit policy ANY needs output_fields")
        # a struct, as counting several columns would leave out rows with a null
        row = F.struct(*[F.col(f"`{c}`") for c in outputs])
        bad = survivors.groupBy(*keys).agg(F.countDistinct(row).alias("__n")).where("__n > 1")
        what = "ANY, but survivors differ in their outputs"
    else:
        return
    found = bad.limit(5).collect()
    if found:
        whom = f" for {len(found)} or more contexts, among them {[r[keys[0]] for r in found]}" if keys else ""
        offending = survivors.join(bad.drop("__n"), keys, "left_semi") if keys else survivors
        raise HitPolicyViolationError(policy, offending, f"hit policy {what}{whom}")


def apply_cardinality(ranked: DataFrame, policy: HitPolicy, keys: list[str], gaps: bool = False) -> DataFrame:
    """Policies of one row keep the first that is left, by context (keys: the columns that tell
    contexts apart). gaps: rows were taken away since they were ranked, so that need not be rank 1."""
    if policy not in ONE_ROW:
        return ranked
    if not gaps:
        return ranked.where("__rank = 1")
    if not keys:
        return ranked.orderBy("__rank").limit(1)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("__rank"))
    return ranked.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
