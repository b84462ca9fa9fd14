"""Ternary vectors of every strategy, and validation."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from ternary_rules import DataType, Dimension, DimensionCompiler, DimensionsMetadata, HitPolicy, MatchStrategy
from ternary_rules.functions.sentinels import filled

U, N = "<NA>", "<NOT_SET>"
UN, NN = -999999999, -999999998
S = MatchStrategy


def vector(spark, strategy, cells, context, kind="str", cell_type="string", **options):
    """Ternary values of a dimension d for rule cells against one context value."""
    if strategy is S.RANGE:
        rules = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], f"i int, lo {cell_type}, hi {cell_type}")
        options |= {"range_min_field": "lo", "range_max_field": "hi"}
    else:
        rules = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, d {cell_type}")
    dim = Dimension("d", match_strategy=strategy, data_type=kind, **options)
    column = DimensionCompiler().compile_dimension(dim)
    bound = rules.withColumn("__ctx_d", filled(F.lit(context), dim.data_type))
    return [r["t"] for r in bound.select("i", column.alias("t")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("strategy", "cells", "context", "expected"),
    [
        (S.EXACT, ["AU", U, "UK", None], "AU", [1, 0, -1, 0]),
        (S.EXACT, ["AU", "US"], U, [0, 0]),
        (S.EXACT, ["AU", U], None, [0, 0]),
        (S.NOT_EQUAL, ["AU", "US", U], "AU", [-1, 1, 0]),
        (S.EXACT_KEY, ["AU", U, "UK"], None, [-1, 0, -1]),
        (S.EXACT_KEY, ["AU", U, "UK"], "AU", [1, 0, -1]),
        (S.PREFIX, ["PRE-", "POST-", U, None], "PRE-001", [1, -1, 0, 0]),
        (S.PREFIX, ["PRE-", U], None, [-1, 0]),
        (S.SUFFIX, ["-AUD", "-USD"], "TXN-AUD", [1, -1]),
        (S.CONTAINS, ["gold", "silver", "."], "gold_tier", [1, -1, -1]),
        (S.CONTAINS, ["SET"], None, [1]),  # the mark of a missing value is text like any other here
        (S.REGEX, ["^T.*", "[0-9]{3}$", U], "TXN-001", [1, 1, 0]),
    ],
)
def test_text(spark, strategy, cells, context, expected):
    assert vector(spark, strategy, cells, context) == expected


@pytest.mark.parametrize(
    ("strategy", "cells", "context", "options", "expected"),
    [
        (S.GREATER_THAN, [100, 1500, UN, None], 1500, {}, [1, -1, 0, 0]),
        (S.LESS_THAN, [100, 50, UN], 50, {}, [1, -1, 0]),
        (S.GREATER_THAN, [100], None, {}, [0]),
        (S.RANGE, [(10, 20)], 10, {}, [1]),
        (S.RANGE, [(10, 20)], 20, {"range_max_inclusive": False}, [-1]),
        (S.RANGE, [(10, 20)], 10, {"range_min_inclusive": False}, [-1]),
        (S.RANGE, [(0, 100), (UN, 100), (UN, 10), (UN, UN), (None, None)], 50, {}, [1, 0, -1, 0, 0]),
        (S.RANGE, [(0, 100)], None, {}, [0]),
    ],
)
def test_numbers(spark, strategy, cells, context, options, expected):
    assert vector(spark, strategy, cells, context, "int", "bigint", **options) == expected


def test_float_nan_is_missing(spark):
    assert vector(spark, S.EXACT, [1.0, float(UN)], float("nan"), "float", "double") == [0, 0]


@pytest.mark.parametrize(("strategy", "expected"), [(S.EXACT, [1, -1, 0]), (S.NOT_EQUAL, [-1, 1, 0]), (S.EXACT_KEY, [1, -1, 0])])
def test_bool(spark, strategy, expected):
    assert vector(spark, strategy, [True, False, None], True, "bool", "boolean") == expected


def test_temporal(spark):
    cells = [(date(2024, 1, 1), date(2024, 12, 31)), (date(1, 1, 1), date(2023, 1, 1)), (date(1, 1, 1), date(1, 1, 1))]
    assert vector(spark, S.RANGE, cells, date(2024, 6, 1), "date", "date") == [1, -1, 0]
    assert vector(spark, S.GREATER_THAN, [datetime(2024, 1, 1, 12), datetime(1, 1, 1)], datetime(2024, 1, 1, 13), "datetime", "timestamp_ntz") == [1, 0]
    assert vector(spark, S.EXACT, [datetime(2024, 1, 1)], None, "datetime", "timestamp_ntz") == [0]


def test_sets(spark):
    cells = [["AU", "NZ"], ["US"], None, [U], ["US", None]]
    assert vector(spark, S.SET_MEMBERSHIP, cells, "AU", cell_type="array<string>") == [1, -1, 0, 0, -1]
    assert vector(spark, S.SET_EXCLUSION, cells, "AU", cell_type="array<string>") == [-1, 1, 0, 0, 1]
    assert vector(spark, S.SET_MEMBERSHIP, cells, None, cell_type="array<string>") == [0, 0, 0, 0, 0]


def test_context_regex_searches(spark):
    assert vector(spark, S.CONTEXT_REGEX, ["x"], "abc-123-def", regex_pattern="123") == [1]
    assert vector(spark, S.CONTEXT_REGEX, ["x"], "xyz", regex_pattern="123") == [-1]


def test_legacy_regex_is_context_regex():
    dim = Dimension("d", match_strategy=S.REGEX, regex_pattern="a", legacy_regex=True)
    assert dim.match_strategy is S.CONTEXT_REGEX


@pytest.mark.parametrize(
    "options",
    [
        {"match_strategy": S.RANGE, "data_type": "int"},
        {"match_strategy": S.RANGE, "range_min_field": "a", "range_max_field": "b"},
        {"match_strategy": S.PREFIX, "data_type": "int"},
        {"match_strategy": S.CONTEXT_REGEX},
        {"match_strategy": S.CONTEXT_REGEX, "regex_pattern": "("},
        {"match_strategy": S.REGEX, "regex_pattern": "a"},
        {"match_strategy": S.GREATER_THAN},
        {"match_strategy": S.SET_MEMBERSHIP, "data_type": "bool"},
    ],
)
def test_invalid_dimensions(options):
    with pytest.raises(ValueError):
        Dimension("d", **options)


def test_metadata():
    with pytest.raises(ValueError, match="repeat"):
        DimensionsMetadata([Dimension("a"), Dimension("a")])
    with pytest.raises(ValueError):
        DimensionsMetadata([Dimension("a")], hit_policy=HitPolicy.PRIORITY)
    with pytest.raises(KeyError):
        DimensionsMetadata([Dimension("a")]).get_dimension("b")
    with pytest.deprecated_call():
        assert Dimension("a", data_type=int).data_type is DataType.INT


def test_yaml_round_trip(tmp_path):
    metadata = DimensionsMetadata([Dimension("x"), Dimension("r", match_strategy=S.RANGE, data_type="int", range_min_field="a", range_max_field="b", range_max_inclusive=False)], hit_policy=HitPolicy.ANY, output_fields=["price"])
    assert DimensionsMetadata.from_yaml(metadata.to_yaml()) == metadata
    metadata.to_yaml_file(tmp_path / "m.yaml")
    assert DimensionsMetadata.from_yaml_file(tmp_path / "m.yaml") == metadata
