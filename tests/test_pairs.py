"""Pairs of a join against the whole expressions of single contexts."""

import pytest

from ternary_rules import DataType, Dimension, DimensionsMetadata, ExpressionRulesEngine, MatchStrategy
from ternary_rules.functions.sentinels import NOT_SET, NOT_SET_NUMERIC, UNKNOWN, UNKNOWN_NUMERIC
from ternary_rules.operators import filter_engine
from ternary_rules.plans.model import SETS
from ternary_rules.sources.contexts import prepare_contexts


def _texts(strategy):
    marks = [None, UNKNOWN, NOT_SET]
    if strategy is MatchStrategy.REGEX:
        return ["^a", "b$", "^NOT|<NOT", *marks]
    return ["a", "ab", "b", "", *marks]


@pytest.mark.parametrize("patterns", [256, 1])
def test_pairs_score_like_single_contexts(spark, monkeypatch, patterns):
    """Columns computed on one side before the join give what the whole expression gives."""
    monkeypatch.setattr(filter_engine, "LITERAL_PATTERNS", patterns)
    text = [s for s in MatchStrategy if s not in SETS and s not in (MatchStrategy.RANGE, MatchStrategy.GREATER_THAN, MatchStrategy.LESS_THAN)]
    dims, columns, schema = [], [], []
    for s in text:
        dims.append(Dimension(s.value, context_field="s", match_strategy=s, **({"regex_pattern": "^(a|<NOT)"} if s is MatchStrategy.CONTEXT_REGEX else {})))
        if s is not MatchStrategy.CONTEXT_REGEX:
            columns.append(_texts(s))
            schema.append(f"{s.value} string")
    for s in sorted(SETS, key=lambda s: s.value):
        dims.append(Dimension(s.value, context_field="s", match_strategy=s))
        columns.append([["a", "b"], [], None, [UNKNOWN], ["ab"]])
        schema.append(f"{s.value} array<string>")
    for s in (MatchStrategy.GREATER_THAN, MatchStrategy.LESS_THAN, MatchStrategy.EXACT, MatchStrategy.NOT_EQUAL):
        dims.append(Dimension(f"n_{s.value}", context_field="n", match_strategy=s, data_type=DataType.FLOAT))
        columns.append([1.0, 2.0, float("nan"), None, float(UNKNOWN_NUMERIC)])
        schema.append(f"n_{s.value} double")
    for k, (low, high) in enumerate([(True, True), (False, False), (True, False)]):
        dims.append(Dimension(f"r{k}", context_field="n", match_strategy=MatchStrategy.RANGE, data_type=DataType.INT, range_min_field=f"lo{k}", range_max_field=f"hi{k}", range_min_inclusive=low, range_max_inclusive=high))
        columns += [[1, 1, None, UNKNOWN_NUMERIC, 2], [2, None, 2, UNKNOWN_NUMERIC, 2]]
        schema += [f"lo{k} bigint", f"hi{k} bigint"]
    for s in (MatchStrategy.EXACT, MatchStrategy.EXACT_KEY):
        dims.append(Dimension(f"b_{s.value}", context_field="b", match_strategy=s, data_type=DataType.BOOL))
        columns.append([True, False, None])
        schema.append(f"b_{s.value} boolean")
    n = max(map(len, columns))
    rules = spark.createDataFrame([tuple(c[i % len(c)] for c in columns) for i in range(n)], ", ".join(schema)).coalesce(1)
    contexts = [(i, s, n, b) for i, (s, n, b) in enumerate([("a", 1, True), ("ab", 2, False), ("", 3, None), (None, None, True), (UNKNOWN, UNKNOWN_NUMERIC, None), (NOT_SET, NOT_SET_NUMERIC, False), ("b", 1, False)])]
    contexts = spark.createDataFrame(contexts, "id long, s string, n long, b boolean")
    for dim in dims if patterns > 1 else [d for d in dims if d.match_strategy is MatchStrategy.REGEX]:
        engine = ExpressionRulesEngine(rules, DimensionsMetadata([dim]))
        prepared = prepare_contexts(contexts, [dim], "id")
        active, shown = [dim.dimension_name], ["__context_id", "__rule_index", f"__t_{dim.dimension_name}", "__specificity"]
        whole = engine._scored(prepared.crossJoin(engine.indexed_rules), active).where("__survived").select(shown)
        dealt = engine._survivors(engine.pairs(prepared, active), active)
        assert not [c for c in dealt.columns if c.startswith(("__cell_", "__low_", "__high_", "__value_"))]
        assert sorted(dealt.select(shown).collect()) == sorted(whole.collect()), dim
    engine = ExpressionRulesEngine(rules, DimensionsMetadata(dims[:6]))
    active = [d.dimension_name for d in dims[:6]]
    prepared = prepare_contexts(contexts, dims[:6], "id")
    whole = engine._scored(prepared.crossJoin(engine.indexed_rules), active).where("__survived").select("__context_id", "__rule_index", "__specificity")
    dealt = engine._survivors(engine.pairs(prepared, active), active).select("__context_id", "__rule_index", "__specificity")
    assert sorted(dealt.collect()) == sorted(whole.collect())
