"""Results over lazy DataFrames: nothing runs until an accessor needs rows."""

from __future__ import annotations

from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ternary_rules.plans.model import HitPolicy

from .hit_policy import ONE_ROW, SelectionInfo, apply_cardinality, check_assertions, ordering_keys


class RuleResult:
    """The ranked survivors of one context. The frame it is made of has their place among the rules,
    `__rule_index`, which select() orders by and no accessor shows."""

    def __init__(self, dataframe: DataFrame, active_dimensions: list[str], selection_info: SelectionInfo | None = None):
        self._df, self._active, self._info = dataframe, list(active_dimensions), selection_info

    @property
    def survivors(self) -> DataFrame:
        return self._df.drop("__rule_index")

    @property
    def best_match(self) -> DataFrame:
        return self.survivors.orderBy("__rank").limit(1)

    @property
    def count(self) -> int:
        return self._df.count()

    @property
    def active_dimensions(self) -> list[str]:
        return list(self._active)

    def explain(self, rule_name: str) -> dict[str, int]:
        """The ternary value of each active dimension for a surviving rule; the best ranked of equal names."""
        row = self._df.where(F.col("rule_name") == rule_name).orderBy("__rank").first()
        if row is None:
            raise KeyError(f"no survivor is named '{rule_name}'")
        return {d: row[f"__t_{d}"] for d in self._active}

    def at_least(self, specificity: int) -> DataFrame:
        return self.survivors.where(F.col("__specificity") >= specificity)

    def select(self, policy: HitPolicy, priority_field: str | None = None) -> RuleResult:
        """The same survivors under another policy."""
        if self._info is None:
            raise ValueError("this result carries no selection info")
        if "__rule_index" not in self._df.columns:
            raise ValueError("this result carries no order of rules")
        if self._info.truncated:
            raise ValueError("a truncated result cannot be selected from; evaluate without top_n and min_specificity")
        policy = HitPolicy(policy)
        info = replace(self._info, priority_field=priority_field or self._info.priority_field)
        order = ordering_keys(policy, info.priority_field)
        check_assertions(self._df, policy, info, [])
        ranked = self._df.drop("__rank").withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
        return RuleResult(apply_cardinality(ranked, policy, []), self._active, replace(info, truncated=policy in ONE_ROW))


class ExplainResult:
    """All rules with their scores, dropped ones too."""

    def __init__(self, dataframe: DataFrame, active_dimensions: list[str]):
        self._df, self._active = dataframe, list(active_dimensions)

    @property
    def frame(self) -> DataFrame:
        return self._df

    @property
    def survivors(self) -> DataFrame:
        return self._df.where("__survived")

    @property
    def non_survivors(self) -> DataFrame:
        return self._df.where("not __survived")

    @property
    def count(self) -> int:
        return self._df.count()

    @property
    def active_dimensions(self) -> list[str]:
        return list(self._active)

    def with_dropped_by(self) -> DataFrame:
        """The frame with `dropped_by`: the first dimension that a rule fails, null for survivors."""
        first = F.coalesce(*[F.when(F.col(f"__t_{d}") < 0, F.lit(d)) for d in self._active], F.lit(None).cast("string"))
        return self._df.withColumn("dropped_by", first)


class BatchRuleResult:
    """Survivors of many contexts, a row for each context and rule, with `__rule_index`, the rule's
    place among the rules."""

    def __init__(self, dataframe: DataFrame, active_dimensions: list[str], context_id_field: str | None = None, selection_info: SelectionInfo | None = None):
        self._df, self._active, self._id, self._info = dataframe, list(active_dimensions), context_id_field, selection_info

    @property
    def survivors(self) -> DataFrame:
        return self._df

    @property
    def count(self) -> int:
        return self._df.count()

    @property
    def active_dimensions(self) -> list[str]:
        return list(self._active)

    @property
    def context_id_field(self) -> str:
        """The contexts' column that tells them apart, or the name of the ids they were given."""
        return self._id or "__context_id"

    @property
    def best_matches(self) -> DataFrame:
        """Of each context the row that ranks first."""
        return self._df.where("__rank = 1")

    def for_context(self, context_id: Any) -> RuleResult:
        return RuleResult(self._df.where(F.col("__context_id") == F.lit(context_id)).drop("__context_id"), self._active, self._info)

    @property
    def counts_per_context(self) -> DataFrame:
        return self._df.groupBy("__context_id").agg(F.count(F.lit(1)).alias("__n"))

    @property
    def matched_context_ids(self) -> DataFrame:
        return self._df.select("__context_id").distinct().orderBy("__context_id")

    def unmatched_context_ids(self, contexts: DataFrame) -> DataFrame:
        from ternary_rules.sources.contexts import with_index

        ids = contexts.select(F.col(self._id).alias("__context_id")) if self._id else with_index(contexts, "__context_id").select("__context_id")
        return ids.join(self._df.select("__context_id"), "__context_id", "left_anti").orderBy("__context_id")
