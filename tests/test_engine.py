"""The filter engine: single contexts, many contexts, policies, results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from ternary_rules import Dimension, DimensionsMetadata, ExpressionRulesEngine, HitPolicy, HitPolicyViolationError, MatchStrategy

U, UN = "<NA>", -999999999
S = MatchStrategy


@pytest.fixture(scope="module")
def basic(spark):
    rules = spark.createDataFrame([("specific", "AU", 0, 100), ("general", U, UN, UN), ("mid", "AU", 0, 100), ("no_match", "US", 0, 100)], "rule_name string, region string, amount_min bigint, amount_max bigint").coalesce(1)
    dims = [Dimension("region"), Dimension("amount", match_strategy=S.RANGE, data_type="int", range_min_field="amount_min", range_max_field="amount_max"), Dimension("code", match_strategy=S.CONTEXT_REGEX, regex_pattern="^PRE.*")]
    return ExpressionRulesEngine(rules, DimensionsMetadata(dims))


CONTEXT = {"region": "AU", "amount": 50, "code": "PRE-001"}


def names(df):
    return [r["rule_name"] for r in df.orderBy("__rank").collect()]


def test_survival_and_specificity(basic):
    result = basic.evaluate(CONTEXT)
    rows = result.survivors.orderBy("__rank").collect()
    assert [(r["rule_name"], r["__specificity"], r["__rank"]) for r in rows] == [("specific", 3, 1), ("mid", 3, 2), ("general", 1, 3)]
    assert result.count == 3 and names(result.best_match) == ["specific"]
    assert result.explain("general") == {"region": 0, "amount": 0, "code": 1}
    with pytest.raises(KeyError):
        result.explain("no_match")
    assert names(result.at_least(2)) == ["specific", "mid"] and result.at_least(10).isEmpty()
    assert not {"__survived", "__ctx_region", "__rule_index"} & set(result.survivors.columns)


def test_trimming(basic):
    assert names(basic.evaluate(CONTEXT, top_n=2).survivors) == ["specific", "mid"]
    assert names(basic.evaluate(CONTEXT, min_specificity=2).survivors) == ["specific", "mid"]
    assert basic.evaluate(CONTEXT, dimensions=["region"]).count == 3
    assert basic.evaluate(CONTEXT, dimensions=[]).count == 3
    assert "__t_region" not in basic.evaluate(CONTEXT, include_observability=False).survivors.columns
    with pytest.raises(KeyError):
        basic.evaluate(CONTEXT, dimensions=["nothing"])
    assert basic.evaluate({"region": "UK", "amount": 5, "code": "X"}).count == 0


def test_explain_keeps_all(basic):
    found = basic.explain(CONTEXT)
    assert found.count == 4 and found.survivors.count() == 3
    assert [r["dropped_by"] for r in found.with_dropped_by().where("not __survived").collect()] == ["region"]


def test_construction(spark, basic):
    rules = basic.rules
    with pytest.raises(ValueError, match="not both"):
        ExpressionRulesEngine(rules, basic.metadata, {"a": F.lit(1)})
    with pytest.raises(ValueError, match="Must provide"):
        ExpressionRulesEngine(rules)
    with pytest.raises(ValueError, match="no column"):
        ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("other")]))
    with pytest.raises(ValueError, match="not string"):
        ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("amount_min")]))
    with pytest.raises(ValueError, match="reserved"):
        ExpressionRulesEngine(rules.withColumn("__rank", F.lit(1)), basic.metadata)
    with pytest.raises(TypeError):
        basic.evaluate(["AU"])


def test_custom_expressions(spark, basic):
    engine = ExpressionRulesEngine(basic.rules, dimension_expressions={"region": F.when(F.col("region") == F.col("__ctx_region"), 1).otherwise(-1), "cheap": lambda r, c: F.when(r.amount_max <= c.cheap, 1).otherwise(0)})
    assert names(engine.evaluate({"region": "AU", "cheap": 100}).survivors) == ["specific", "mid"]


def test_list_dimension_and_context_field(spark):
    every = ["AU", "NZ", "US", "UK"]
    rows = [("catch_all", "allow", U, every, UN, U), ("high_value", "review", U, every, 10000, U), ("blacklist", "block", "CASINO", every, UN, U), ("specific", "block", "RETAIL", ["AU"], 500, "TXN-")]
    rules = spark.createDataFrame(rows, "rule_name string, action string, merchant string, countries array<string>, threshold bigint, prefix string").coalesce(1)
    dims = [Dimension("merchant", context_field="merchant_type"), Dimension("country", rule_field="countries", match_strategy=S.SET_MEMBERSHIP), Dimension("amount", rule_field="threshold", match_strategy=S.GREATER_THAN, data_type="int"), Dimension("code", rule_field="prefix", match_strategy=S.PREFIX)]
    engine = ExpressionRulesEngine(rules, DimensionsMetadata(dims))
    score = lambda **c: [(r["rule_name"], r["__specificity"]) for r in engine.evaluate(c).survivors.orderBy("__rank").collect()]
    assert score(merchant_type="RETAIL", country="US", amount=15000, code="TXN-999") == [("high_value", 2), ("catch_all", 1)]
    assert score(merchant_type="CASINO", country="AU", amount=100, code="TXN-001") == [("blacklist", 2), ("catch_all", 1)]
    assert score(merchant_type="RETAIL", country="AU", amount=1000, code="TXN-001") == [("specific", 4), ("catch_all", 1)]


@pytest.fixture(scope="module")
def priced(spark):
    rules = spark.createDataFrame([("au_low", "AU", 0, 99, U, 1.0), ("au_high", "AU", 100, 999, U, 2.0), ("nz_any", "NZ", UN, UN, U, 3.0), ("prefix_x", U, UN, UN, "X-", 4.0)], "rule_name string, region string, lo bigint, hi bigint, code string, price double").coalesce(1)
    dims = [Dimension("region"), Dimension("amount", match_strategy=S.RANGE, data_type="int", range_min_field="lo", range_max_field="hi"), Dimension("code", context_field="product_code", match_strategy=S.PREFIX)]
    return ExpressionRulesEngine(rules, DimensionsMetadata(dims))


CONTEXTS = [("r-100", "AU", 50, "X-1"), ("r-101", "NZ", 500, "Z-9"), ("r-102", None, None, None), ("r-103", "XX", 10, "Q")]


def test_batch(spark, priced):
    contexts = spark.createDataFrame(CONTEXTS, "request_id string, region string, amount bigint, product_code string")
    result = priced.evaluate_batch(contexts, context_id_field="request_id")
    rows = [(r["__context_id"], r["rule_name"], r["__specificity"]) for r in result.survivors.orderBy("__context_id", "__rank").collect()]
    assert rows == [("r-100", "au_low", 2), ("r-100", "prefix_x", 1), ("r-101", "nz_any", 1), ("r-102", "au_low", 0), ("r-102", "au_high", 0), ("r-102", "nz_any", 0)]
    assert {r["__context_id"]: r["__n"] for r in result.counts_per_context.collect()} == {"r-100": 2, "r-101": 1, "r-102": 3}
    assert [r[0] for r in result.matched_context_ids.collect()] == ["r-100", "r-101", "r-102"]
    assert [r[0] for r in result.unmatched_context_ids(contexts).collect()] == ["r-103"]
    assert names(result.for_context("r-102").survivors) == ["au_low", "au_high", "nz_any"]
    assert result.best_matches.count() == 3 and result.count == 6
    numbered = priced.evaluate_batch(contexts.coalesce(1))
    assert sorted({r[0] for r in numbered.survivors.select("__context_id").collect()}) == [0, 1, 2]
    with pytest.raises(ValueError, match="not unique"):
        priced.evaluate_batch(contexts.union(contexts), context_id_field="request_id")
    with pytest.raises(ValueError, match="reserved"):
        priced.evaluate_batch(contexts.withColumn("__rank", F.lit(1)))


def test_batch_is_each_context_alone(spark, priced):
    contexts = spark.createDataFrame(CONTEXTS, "request_id string, region string, amount bigint, product_code string")
    for policy, top, least in itertools.product([HitPolicy.COLLECT, HitPolicy.RULE_ORDER], [None, 1], [None, 1]):
        batch = priced.evaluate_batch(contexts, context_id_field="request_id", hit_policy=policy, top_n_per_context=top, min_specificity=least)
        mine = {}
        for r in batch.survivors.orderBy("__context_id", "__rank").collect():
            mine.setdefault(r["__context_id"], []).append((r["rule_name"], r["__rank"]))
        for c in contexts.collect():
            alone = priced.evaluate(c, hit_policy=policy, top_n=top, min_specificity=least)
            assert mine.get(c["request_id"], []) == [(r["rule_name"], r["__rank"]) for r in alone.survivors.orderBy("__rank").collect()]


def test_large_rule_tables_join_by_key(spark, priced):
    contexts = spark.createDataFrame(CONTEXTS, "request_id string, region string, amount bigint, product_code string")
    keyed = ExpressionRulesEngine(priced.rules, priced.metadata, broadcast_rules=0)
    same = lambda e: sorted(map(tuple, e.evaluate_batch(contexts, context_id_field="request_id").survivors.select("__context_id", "rule_name", "__rank").collect()))
    assert same(keyed) == same(priced)


def test_pairs_need_no_second_exchange(spark, priced):
    contexts = spark.createDataFrame(CONTEXTS, "request_id string, region string, amount bigint, product_code string")
    plan = priced.evaluate_batch(contexts, context_id_field="request_id").survivors._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_COL" in plan


@pytest.fixture(scope="module")
def salience(spark):
    rules = spark.createDataFrame([("fallback", U, 10, 1.0), ("au_specific", "AU", 1, 2.0)], "rule_name string, region string, salience int, price double").coalesce(1)
    return ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("region")]))


def test_policies(salience):
    got = lambda policy, **k: names(salience.evaluate({"region": "AU"}, hit_policy=policy, **k).survivors)
    assert got(HitPolicy.COLLECT) == ["au_specific", "fallback"]
    assert got(HitPolicy.RULE_ORDER) == ["fallback", "au_specific"]
    assert got(HitPolicy.FIRST) == ["fallback"]
    assert got(HitPolicy.PRIORITY, priority_field="salience") == ["fallback"]
    with pytest.raises(ValueError):
        got(HitPolicy.PRIORITY)
    with pytest.raises(HitPolicyViolationError) as caught:
        got(HitPolicy.UNIQUE)
    assert caught.value.policy is HitPolicy.UNIQUE and caught.value.offending.count() == 2
    with pytest.raises(HitPolicyViolationError):
        got(HitPolicy.ANY)
    assert salience.evaluate({"region": "NZ"}, hit_policy=HitPolicy.UNIQUE).count == 1


def test_any_agrees(spark, salience):
    same = ExpressionRulesEngine(salience.rules.withColumn("price", F.lit(5.0)).withColumn("salience", F.lit(1)), salience.metadata)
    assert names(same.evaluate({"region": "AU"}, hit_policy=HitPolicy.ANY).survivors) == ["au_specific"]
    bare = ExpressionRulesEngine(salience.rules, dimension_expressions={"region": F.lit(1)})
    with pytest.raises(ValueError, match="output_fields"):
        bare.evaluate({"region": "AU"}, hit_policy=HitPolicy.ANY)


def test_select(salience):
    collected = salience.evaluate({"region": "AU"})
    assert names(collected.select(HitPolicy.FIRST).survivors) == ["fallback"]
    assert names(collected.select(HitPolicy.PRIORITY, "salience").survivors) == ["fallback"]
    with pytest.raises(HitPolicyViolationError):
        collected.select(HitPolicy.UNIQUE)
    with pytest.raises(ValueError, match="truncated"):
        salience.evaluate({"region": "AU"}, top_n=1).select(HitPolicy.FIRST)


def test_batch_violation_names_contexts(spark, salience):
    contexts = spark.createDataFrame([(1, "AU"), (2, "NZ")], "id int, region string")
    with pytest.raises(HitPolicyViolationError) as caught:
        salience.evaluate_batch(contexts, context_id_field="id", hit_policy=HitPolicy.UNIQUE)
    assert {r["__context_id"] for r in caught.value.offending.collect()} == {1}


def test_rank_gaps_stay(spark):
    rules = spark.createDataFrame([("a", U), ("b", "AU"), ("c", U), ("d", "AU")], "rule_name string, region string").coalesce(1)
    engine = ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("region")]))
    kept = engine.evaluate({"region": "AU"}, hit_policy=HitPolicy.RULE_ORDER, min_specificity=1, top_n=2).survivors.orderBy("__rank").collect()
    assert [(r["rule_name"], r["__rank"]) for r in kept] == [("b", 2), ("d", 4)]


def test_random_rules_against_plain_python(spark):
    rng = random.Random(3)
    cells = [(f"r{i}", rng.choice(["AU", "NZ", U, None]), *sorted([rng.randint(0, 50), rng.randint(50, 99)]), rng.choice(["a", "b", U])) for i in range(40)]
    rules = spark.createDataFrame(cells, "rule_name string, region string, lo bigint, hi bigint, code string").coalesce(1)
    dims = [Dimension("region"), Dimension("amount", match_strategy=S.RANGE, data_type="int", range_min_field="lo", range_max_field="hi"), Dimension("code", match_strategy=S.NOT_EQUAL)]
    engine = ExpressionRulesEngine(rules, DimensionsMetadata(dims))
    given = [(i, rng.choice(["AU", "NZ", None]), rng.choice([None, rng.randint(0, 99)]), rng.choice(["a", "b", None])) for i in range(30)]
    contexts = spark.createDataFrame(given, "id int, region string, amount bigint, code string")

    def plain(rule, context):
        _, region, lo, hi, code = rule
        _, c_region, c_amount, c_code = context
        eq = 0 if region in (U, None) or c_region is None else 1 if region == c_region else -1
        span = 0 if c_amount is None else 1 if lo <= c_amount <= hi else -1
        ne = 0 if code == U or c_code is None else 1 if code != c_code else -1
        return min(eq, span, ne), (eq, span, ne).count(1)

    expected = set()
    for c in given:
        scored = sorted([(-plain(r, c)[1], n, r[0]) for n, r in enumerate(cells) if plain(r, c)[0] >= 0])
        expected |= {(c[0], name, rank) for rank, (_, _, name) in enumerate(scored, 1)}
    rows = engine.evaluate_batch(contexts, context_id_field="id").survivors.select("__context_id", "rule_name", "__rank").collect()
    assert set(map(tuple, rows)) == expected


def test_first_after_min_specificity(spark):
    """Policies of one row take the first of what is left, alone and in a batch."""
    rules = spark.createDataFrame([("a", "<NA>", 9), ("b", "AU", 1), ("c", "AU", 1)], "rule_name string, region string, salience int").coalesce(1)
    engine = ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("region")], output_fields=["region"]))
    contexts = spark.createDataFrame([(1, "AU"), (2, "NZ")], "id int, region string")
    for policy in (HitPolicy.FIRST, HitPolicy.PRIORITY):
        options = {"hit_policy": policy, "priority_field": "salience", "min_specificity": 1}
        assert [r["rule_name"] for r in engine.evaluate({"region": "AU"}, **options).survivors.collect()] == ["b"]
        assert [(r["__context_id"], r["rule_name"]) for r in engine.evaluate_batch(contexts, context_id_field="id", **options).survivors.collect()] == [(1, "b")]


def test_select_again_and_of_a_context(spark, basic):
    found = basic.evaluate(CONTEXT)
    again = found.select(HitPolicy.RULE_ORDER).select(HitPolicy.COLLECT)
    assert sorted(map(str, again.survivors.collect())) == sorted(map(str, found.survivors.collect()))
    batch = basic.evaluate_batch(spark.createDataFrame([(7, "AU", 50, "PRE-001")], "id int, region string, amount int, code string"), context_id_field="id")
    assert "__rule_index" in batch.survivors.columns and batch.context_id_field == "id"
    assert batch.for_context(7).select(HitPolicy.FIRST).survivors.first()["rule_name"] == "specific"
    one = basic.evaluate_batch(spark.createDataFrame([(7, "AU", 50, "PRE-001")], "id int, region string, amount int, code string"), context_id_field="id", hit_policy=HitPolicy.FIRST)
    with pytest.raises(ValueError, match="truncated"):
        one.for_context(7).select(HitPolicy.COLLECT)
    assert basic.evaluate_batch(spark.createDataFrame([("AU", 50, "PRE-001")], "region string, amount int, code string")).context_id_field == "__context_id"


@pytest.mark.parametrize("cells", [["AU", None], ["AU", "<NA>"], ["<NOT_SET>"]])
def test_sets_are_checked(spark, cells):
    rules = spark.createDataFrame([("a", ["NZ"]), ("b", ["<NA>"]), ("c", None), ("d", cells)], "rule_name string, region array<string>")
    with pytest.raises(ValueError, match="null or a reserved mark"):
        ExpressionRulesEngine(rules, DimensionsMetadata([Dimension("region", match_strategy=MatchStrategy.SET_MEMBERSHIP)]))
    ExpressionRulesEngine(rules.where("rule_name <> 'd'"), DimensionsMetadata([Dimension("region", match_strategy=MatchStrategy.SET_MEMBERSHIP)]))


def test_patterns_are_checked(spark):
    rules = spark.createDataFrame([("a", "^x"), ("b", "<NA>"), ("c", "[")], "rule_name string, code string")
    metadata = DimensionsMetadata([Dimension("code", match_strategy=MatchStrategy.REGEX)])
    with pytest.raises(ValueError, match="pattern"):
        ExpressionRulesEngine(rules, metadata)
    ExpressionRulesEngine(rules.where("rule_name <> 'c'"), metadata)


def test_large_rule_tables_have_no_cartesian_product(spark):
    """Keyed, without a key, and by bytes: the same survivors as from one broadcast."""
    from ternary_rules.operators import filter_engine

    rows = [(f"r{i}", ["<NA>", "AU", "NZ", "UK"][i % 4], i % 50) for i in range(3000)]
    rules = spark.createDataFrame(rows, "rule_name string, region string, least int").coalesce(1)
    contexts = spark.createDataFrame([(1, "AU", 20), (2, None, 3), (3, "XX", 60)], "id int, region string, amount int")
    dims = [Dimension("region"), Dimension("least", context_field="amount", match_strategy=MatchStrategy.GREATER_THAN, data_type="int")]
    for some in (dims, dims[1:]):
        want = sorted(map(str, ExpressionRulesEngine(rules, DimensionsMetadata(some)).evaluate_batch(contexts, context_id_field="id").survivors.collect()))
        cut = ExpressionRulesEngine(rules, DimensionsMetadata(some), broadcast_rules=100).evaluate_batch(contexts, context_id_field="id").survivors
        assert sorted(map(str, cut.collect())) == want and len(want) > 100
        assert "CartesianProduct" not in cut._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="meet every context"):
        filter_engine.ExpressionRulesEngine(rules, DimensionsMetadata(dims[1:]), broadcast_rules=100)._with_all(contexts, rules, 10_000_000, 1)
