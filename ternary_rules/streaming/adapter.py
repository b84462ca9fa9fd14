"""Contexts as a stream. Scoring keeps no state, so pairs flow in append mode; ranks and policies need
all pairs of a context, which come from one row and so from one micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ternary_rules.operators.filter_engine import ExpressionRulesEngine
from ternary_rules.operators.results import BatchRuleResult
from ternary_rules.sources.contexts import prepare_contexts


def score_stream(engine: ExpressionRulesEngine, contexts: DataFrame, context_id_field: str, dimensions: list[str] | None = None) -> DataFrame:
    """A stream of survivors, unranked."""
    active = engine._active(dimensions)
    prepared = prepare_contexts(contexts, engine._dimensions(active), context_id_field, check=False)
    scored = engine._survivors(engine.pairs(prepared, active, indexed=False), active)
    return engine._finish(scored, active, True)


def evaluate_stream(engine: ExpressionRulesEngine, contexts: DataFrame, sink: Callable[[BatchRuleResult, int], None], **options: Any) -> DataStreamWriter:
    """A writer, to be started, that evaluates each micro-batch and hands the result to sink."""

    def one(batch: DataFrame, number: int) -> None:
        sink(engine.evaluate_batch(batch, **options), number)

    return contexts.writeStream.foreachBatch(one)
