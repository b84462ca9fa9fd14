"""A business-rules engine on Spark: rules are rows, conditions are columns."""

__version__ = "0.1.0"

from ternary_rules.functions.sentinels import (
    NOT_SET,
    NOT_SET_DATE,
    NOT_SET_DATETIME,
    NOT_SET_NUMERIC,
    UNKNOWN,
    UNKNOWN_DATE,
    UNKNOWN_DATETIME,
    UNKNOWN_NUMERIC,
    not_set_sentinel_for,
    sentinels_for,
    unknown_sentinel_for,
)
from ternary_rules.functions.strategies import DimensionCompiler
from ternary_rules.operators.accumulator import AccumulatorCompiler, AccumulatorEngine, AccumulatorResult, LatticeWidthExceededError, checked_multiply, get_prime
from ternary_rules.operators.filter_engine import ExpressionRulesEngine
from ternary_rules.operators.hit_policy import HitPolicyViolationError, SelectionInfo
from ternary_rules.operators.lattice import AmbiguousPartitionError, Lattice, LatticeIndex
from ternary_rules.operators.results import BatchRuleResult, ExplainResult, RuleResult
from ternary_rules.plans.model import Aggregate, AggregateOp, DataType, Dimension, DimensionRole, DimensionsMetadata, HitPolicy, MatchStrategy

__all__ = [
    "NOT_SET", "NOT_SET_DATE", "NOT_SET_DATETIME", "NOT_SET_NUMERIC", "UNKNOWN", "UNKNOWN_DATE", "UNKNOWN_DATETIME", "UNKNOWN_NUMERIC",
    "AccumulatorCompiler", "AccumulatorEngine", "AccumulatorResult", "Aggregate", "AggregateOp", "AmbiguousPartitionError", "BatchRuleResult", "DataType", "Dimension",
    "DimensionCompiler", "DimensionRole", "DimensionsMetadata", "ExplainResult", "ExpressionRulesEngine", "HitPolicy", "HitPolicyViolationError", "Lattice", "LatticeIndex",
    "LatticeWidthExceededError", "MatchStrategy", "RuleResult", "SelectionInfo", "__version__", "checked_multiply", "get_prime", "not_set_sentinel_for", "sentinels_for", "unknown_sentinel_for",
]
