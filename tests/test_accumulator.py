"""Lattices: build against brute force, apply, snapshots, routing."""

import itertools
import random
from math import prod

import pytest
from pyspark.sql import functions as F

from ternary_rules import (
    AccumulatorEngine,
    Aggregate,
    AggregateOp,
    AmbiguousPartitionError,
    Dimension,
    DimensionRole,
    DimensionsMetadata,
    Lattice,
    LatticeWidthExceededError,
    MatchStrategy,
    checked_multiply,
    get_prime,
)

U, UN = "<NA>", -999999999
S = MatchStrategy


def dims():
    return [Dimension("channel"), Dimension("lvr", match_strategy=S.RANGE, data_type="int", range_min_field="lvr_min", range_max_field="lvr_max", range_max_inclusive=False), Dimension("foreign_resident")]


@pytest.fixture(scope="module")
def worked(spark):
    rules = spark.createDataFrame([("R1", "BROKER", 60, 80, U, -0.10), ("R2", U, 70, 90, "false", -0.05), ("R3", "BROKER", UN, UN, "false", -0.15)], "rule_name string, channel string, lvr_min bigint, lvr_max bigint, foreign_resident string, margin double").coalesce(1)
    engine = AccumulatorEngine(DimensionsMetadata(dims()), [Aggregate("margin")])
    return engine, rules, engine.build(rules)


def test_worked_trace(worked):
    _, _, lattice = worked
    rows = {r["__prime_product"]: (r["co_channel"], r["co_lvr_min"], r["co_lvr_max"], r["co_foreign_resident"], round(r["__agg_margin"], 2), r["__level"]) for r in lattice.combinations.collect()}
    assert rows == {
        2: ("BROKER", 60, 80, U, -0.10, 0),
        3: (U, 70, 90, "false", -0.05, 0),
        5: ("BROKER", UN, UN, "false", -0.15, 0),
        10: ("BROKER", 60, 80, "false", -0.25, 1),
        15: ("BROKER", 70, 90, "false", -0.20, 1),
        30: ("BROKER", 70, 80, "false", -0.30, 2),
    }
    assert lattice.is_composed and lattice.count == 6


def test_apply(worked):
    engine, _, lattice = worked
    result = engine.apply(lattice, {"channel": "BROKER", "lvr": 75, "foreign_resident": "false"})
    assert {r[0] for r in result.provenance.collect()} == {2, 3, 5, 10, 15, 30}
    assert result.count == 6 and sorted(r[0] for r in result.depths.collect()) == [0, 0, 0, 1, 1, 2]
    assert round(sum(r[0] for r in result.accumulated("margin").collect()), 2) == -1.05
    assert engine.apply(lattice, {"channel": "DIRECT", "lvr": 75, "foreign_resident": "true"}).count == 0
    assert engine.filter_engine(lattice) is engine.filter_engine(lattice)


def test_save_and_load(worked, tmp_path, spark):
    engine, _, lattice = worked
    back = Lattice.load(lattice.save(tmp_path / "x"), spark)
    assert sorted(map(tuple, back.combinations.collect())) == sorted(map(tuple, lattice.combinations.collect()))
    assert back.metadata == lattice.metadata and back.aggregates == lattice.aggregates and back.is_composed
    with pytest.raises(FileNotFoundError):
        Lattice.load(tmp_path / "nothing", spark)


def brute(rules):
    """All consistent subsets with merged conditions, then those that none of the same conditions contains."""
    found = {}
    for n in range(1, len(rules) + 1):
        for subset in itertools.combinations(range(len(rules)), n):
            part = [rules[i] for i in subset]
            regions = {r[1] for r in part} - {U}
            low = max([r[2] for r in part if r[2] != UN], default=UN)
            high = min([r[3] for r in part if r[3] != UN], default=UN)
            sets = [set(r[4]) for r in part if U not in r[4]]
            common = tuple(sorted(set.intersection(*sets))) if sets else (U,)
            if len(regions) > 1 or UN not in (low, high) and low > high or not common:
                continue
            tops = [r[5] for r in part if r[5] != UN]
            found[subset] = (regions.pop() if regions else U, low, high, common, max(tops, default=UN))
    kept = {s: v for s, v in found.items() if not any(v == w and set(s) < set(t) for t, w in found.items())}
    return {(prod(get_prime(i) for i in s), v, sum(rules[i][6] for i in s), min(rules[i][6] for i in s), max(rules[i][6] for i in s), prod(rules[i][6] for i in s)) for s, v in kept.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_build_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rules = [(f"r{i}", rng.choice(["AU", "NZ", U]), *rng.choice([(0, 10), (5, 20), (15, 30), (UN, 12), (8, UN)]), rng.choice([["a"], ["a", "b"], ["b", "c"], [U]]), rng.choice([UN, 1, 5]), i + 1) for i in range(8)]
    frame = spark.createDataFrame(rules, "rule_name string, region string, lo bigint, hi bigint, codes array<string>, floor bigint, v bigint").coalesce(1)
    own = [Dimension("region"), Dimension("x", match_strategy=S.RANGE, data_type="int", range_min_field="lo", range_max_field="hi"), Dimension("code", rule_field="codes", match_strategy=S.SET_MEMBERSHIP), Dimension("score", rule_field="floor", match_strategy=S.GREATER_THAN, data_type="int")]
    frame = frame.withColumn("w", F.col("v")).withColumn("y", F.col("v")).withColumn("z", F.col("v"))
    engine = AccumulatorEngine(DimensionsMetadata(own), [Aggregate("v"), Aggregate("w", AggregateOp.MIN), Aggregate("y", AggregateOp.MAX), Aggregate("z", "product")])
    rows = engine.build(frame).combinations.collect()
    got = {(r["__prime_product"], (r["co_region"], r["co_lo"], r["co_hi"], tuple(r["co_codes"]), r["co_floor"]), r["__agg_v"], r["__agg_w"], r["__agg_y"], r["__agg_z"]) for r in rows}
    assert got == brute(rules)


def test_width_and_primes(spark):
    assert [get_prime(i) for i in (0, 1, 4, 9_999)] == [2, 3, 11, 104_729]
    with pytest.raises(IndexError):
        get_prime(10_000)
    with pytest.raises(LatticeWidthExceededError):
        checked_multiply(2**40, 2**40)
    with pytest.raises(ValueError, match="cannot be merged"):
        AccumulatorEngine(DimensionsMetadata([Dimension("a", match_strategy=S.PREFIX)]))


def test_exclusive_groups_never_combine(spark, worked):
    _, rules, _ = worked
    engine = AccumulatorEngine(DimensionsMetadata(dims()), exclusive_field="card")
    lattice = engine.build(rules.withColumn("card", F.when(F.col("rule_name") == "R2", "x").otherwise("y")))
    assert {r["__prime_product"] for r in lattice.combinations.collect()} == {2, 3, 5, 6, 15}


@pytest.fixture(scope="module")
def partitioned(spark):
    rules = spark.createDataFrame([("insurance", "AU", 1.0), ("insurance", U, 2.0), ("lending", "AU", 4.0), (U, U, 8.0)], "product string, region string, premium double").coalesce(1)
    engine = AccumulatorEngine(DimensionsMetadata([Dimension("product", role=DimensionRole.CONTEXT_KEY), Dimension("region")]), [Aggregate("premium")])
    return engine, rules, engine.build_all(rules)


def test_build_all_is_the_union_of_builds(partitioned):
    engine, rules, lattices = partitioned
    assert [x.partition_key for x in lattices] == [{"product": U}, {"product": "insurance"}, {"product": "lending"}]
    for x in lattices:
        one = engine.build(rules, x.partition_key)
        assert sorted(map(tuple, one.combinations.collect())) == sorted(map(tuple, x.combinations.collect()))


def test_routing(spark, partitioned):
    engine, _, lattices = partitioned
    index = engine.index(lattices)
    total = lambda c: sorted(r[0] for r in index.apply(c).accumulated("premium").collect())
    assert total({"product": "insurance", "region": "AU"}) == [2.0, 3.0]
    assert total({"product": "lending", "region": "AU"}) == [4.0]
    assert total({"product": "other", "region": "AU"}) == [8.0] == total({"region": "NZ"})
    assert sorted(r[0] for r in engine.apply_auto(lattices, {"product": "lending", "region": "AU"}).accumulated("premium").collect()) == [4.0]
    contexts = spark.createDataFrame([(1, "insurance", "AU"), (2, "lending", "AU"), (3, None, "NZ"), (4, "lending", "NZ")], "id int, product string, region string")
    batch = index.apply_batch(contexts, "id").survivors
    assert sorted((r["__context_id"], r["__agg_premium"]) for r in batch.collect()) == [(1, 2.0), (1, 3.0), (2, 4.0), (3, 8.0)]


def test_index_checks(spark, partitioned):
    engine, _, lattices = partitioned
    with pytest.raises(ValueError, match="twice"):
        engine.index([*lattices, lattices[0]])
    with pytest.raises(ValueError, match="max_witnesses"):
        engine.index(lattices, max_witnesses=1)
    with pytest.raises(ValueError, match="without a partition key"):
        engine.index([Lattice(lattices[0].combinations, lattices[0].metadata, [], None)])
    two = AccumulatorEngine(DimensionsMetadata([Dimension("a", role=DimensionRole.CONTEXT_KEY), Dimension("b", role=DimensionRole.CONTEXT_KEY), Dimension("region")]))
    frame = lattices[0].combinations
    clash = [Lattice(frame, two.metadata, [], {"a": "1", "b": U}), Lattice(frame, two.metadata, [], {"a": U, "b": "1"})]
    with pytest.raises(AmbiguousPartitionError):
        two.index(clash)
    with pytest.raises(AmbiguousPartitionError):
        two.index(clash, validate=False).apply({"a": "1", "b": "1", "region": "AU"})
    with pytest.raises(KeyError):
        two.index(clash, validate=False).apply({"a": "2", "b": "2"})
