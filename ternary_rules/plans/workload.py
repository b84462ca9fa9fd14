"""Rule sets over the driver's tables: one query per operator, with SQL that was written by hand
for DuckDB and shares nothing with the compiler but the rule rows."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ternary_rules.functions.sentinels import NOT_SET, UNKNOWN, UNKNOWN_DATE, UNKNOWN_DATETIME, UNKNOWN_NUMERIC
from ternary_rules.operators.accumulator import AccumulatorEngine
from ternary_rules.operators.filter_engine import ExpressionRulesEngine
from ternary_rules.operators.hit_policy import HitPolicyViolationError
from ternary_rules.operators.lattice import Lattice
from ternary_rules.plans.model import Aggregate, AggregateOp, Dimension, DimensionRole, DimensionsMetadata, HitPolicy, MatchStrategy
from ternary_rules.sources.contexts import with_index
from ternary_rules.sources.storage import read_rules, shared_dir, write_result
from ternary_rules.streaming.adapter import evaluate_stream, score_stream

U, UN, UD, UDT = UNKNOWN, UNKNOWN_NUMERIC, UNKNOWN_DATE, UNKNOWN_DATETIME
S, P = MatchStrategy, HitPolicy
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Rules:
    """Rule rows once: as a DataFrame for Spark, as a VALUES list for DuckDB, which gets `idx` too."""

    def __init__(self, schema: str, *rows: tuple):
        self.schema, self.rows = schema, rows
        self.columns = [c.split()[0] for c in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema).coalesce(1)

    def cte(self) -> str:
        def text(v: Any, kind: str) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).upper()
            if isinstance(v, list):
                return "[" + ", ".join(text(x, "string") for x in v) + "]"
            if isinstance(v, datetime):
                return f"TIMESTAMP '{v.isoformat(sep=' ')}'"
            if isinstance(v, date):
                return f"DATE '{v.isoformat()}'"
            if isinstance(v, str):
                return "'" + v.replace("'", "''") + "'"
            return f"CAST({v!r} AS DOUBLE)" if kind == "double" else f"CAST({v!r} AS BIGINT)"

        kinds = [c.split()[1] for c in self.schema.split(", ")]
        rows = ", ".join("(" + ", ".join([str(i), *[text(v, k) for v, k in zip(r, kinds, strict=True)]]) + ")" for i, r in enumerate(self.rows))
        return f"rules(idx, {', '.join(self.columns)}) AS (VALUES {rows})"


def query(name: str, sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def shaped(df: DataFrame, **more: Column) -> DataFrame:
    return df.select(F.col("__context_id").alias("id"), "rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"), *[c.alias(n) for n, c in more.items()])


def ranked_sql(rules: Rules, source: str, terms: dict[str, str], order: str = "specificity DESC, idx", where: str = "", outer: str = "*", extra: str = "") -> str:
    """Scores of each pair, survivors and ranks. source: SELECT id, ...; terms: ternary SQL by name."""
    t = ", ".join(f"{sql} AS {n}" for n, sql in terms.items())
    least = f"least({', '.join(terms)})" if len(terms) > 1 else next(iter(terms))
    total = " + ".join(f"(CASE WHEN {n} = 1 THEN 1 ELSE 0 END)" for n in terms)
    return f"""WITH {rules.cte()}, ctx AS ({source}), scored AS (SELECT ctx.*, rules.*, {t} FROM ctx CROSS JOIN rules),
    alive AS (SELECT *, CAST({total} AS INTEGER) AS specificity FROM scored WHERE {least} >= 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY {order}) AS INTEGER) AS rnk FROM alive)
    SELECT id, rule_name, specificity, rnk{extra} FROM ranked {where}"""


def eq(r: str, c: str, yes: str = "=") -> str:
    return f"CASE WHEN {r} IS NULL OR {r} = '{U}' OR {c} IS NULL THEN 0 WHEN {r} {yes} {c} THEN 1 ELSE -1 END"


def bound(r: str, c: str, op: str, wild: str = str(UN)) -> str:
    return f"CASE WHEN {r} IS NULL OR {r} = {wild} OR {c} IS NULL THEN 0 WHEN {c} {op} {r} THEN 1 ELSE -1 END"


def text_op(function: str, r: str, c: str) -> str:
    return f"CASE WHEN {r} IS NULL OR {r} = '{U}' THEN 0 WHEN {function}(coalesce({c}, '{NOT_SET}'), {r}) THEN 1 ELSE -1 END"


def engine(spark: SparkSession, rules: Rules, *dims: Dimension, **metadata: Any) -> ExpressionRulesEngine:
    return ExpressionRulesEngine(rules.frame(spark), DimensionsMetadata(list(dims), **metadata))


def batch(spark: SparkSession, sf_dir: str, source: str, key: str, rules: Rules, dims: list[Dimension], **options: Any):
    contexts = source if isinstance(source, DataFrame) else table(spark, sf_dir, source)
    return engine(spark, rules, *dims).evaluate_batch(contexts, context_id_field=key, check_ids=False, **options)


# flagship, and the trimming and policies over the same rules -----------------------------------

ORDER_RULES = Rules(
    "rule_name string, priority string, lo double, hi double, salience bigint, fee double",
    ("any", U, float(UN), float(UN), 1, 1.0),
    ("urgent", "1-URGENT", float(UN), float(UN), 5, 4.0),
    ("large", U, 200000.0, 500000.0, 9, 2.0),
    ("urgent_large", "1-URGENT", 200000.0, float(UN), 3, 8.0),
    ("medium_small", "3-MEDIUM", 0.0, 100000.0, 7, 0.5),
    ("low", "5-LOW", float(UN), 300000.0, 7, 0.25),
)
ORDER_DIMS = [Dimension("priority", context_field="o_orderpriority"), Dimension("price", context_field="o_totalprice", match_strategy=S.RANGE, data_type="float", range_min_field="lo", range_max_field="hi")]
ORDER_SOURCE = "SELECT o_orderkey AS id, o_orderpriority AS p, o_totalprice AS x FROM orders"
ORDER_TERMS = {"t_priority": eq("rules.priority", "ctx.p"), "t_price": f"least({bound('lo', 'x', '>=')}, {bound('hi', 'x', '<=')})"}


def orders(spark: SparkSession, sf_dir: str, **options: Any):
    return batch(spark, sf_dir, "orders", "o_orderkey", ORDER_RULES, ORDER_DIMS, **options)


@query("policy_collect", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS))
def policy_collect(spark, sf_dir):
    return shaped(orders(spark, sf_dir).survivors)


@query("policy_rule_order", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, "idx"))
def policy_rule_order(spark, sf_dir):
    return shaped(orders(spark, sf_dir, hit_policy=P.RULE_ORDER).survivors)


@query("policy_first", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, "idx", "WHERE rnk = 1"))
def policy_first(spark, sf_dir):
    return shaped(orders(spark, sf_dir, hit_policy=P.FIRST).survivors)


@query("policy_priority", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, "salience DESC NULLS LAST, specificity DESC, idx", "WHERE rnk = 1"))
def policy_priority(spark, sf_dir):
    return shaped(orders(spark, sf_dir, hit_policy=P.PRIORITY, priority_field="salience").survivors)


UNIQUE_RULES = Rules("rule_name string, priority string", ("urgent", "1-URGENT"), ("high", "2-HIGH"), ("low", "5-LOW"))
AGREEING = Rules("rule_name string, priority string, fee double", ("any", U, 3.0), ("urgent", "1-URGENT", 3.0), ("low", "5-LOW", 3.0))


@query("policy_unique", ranked_sql(UNIQUE_RULES, ORDER_SOURCE, {"t_p": eq("priority", "p")}))
def policy_unique(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "orders", "o_orderkey", UNIQUE_RULES, ORDER_DIMS[:1], hit_policy=P.UNIQUE).survivors)


@query("policy_any", ranked_sql(AGREEING, ORDER_SOURCE, {"t_p": eq("priority", "p")}, where="WHERE rnk = 1", extra=", fee"))
def policy_any(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "orders", "o_orderkey", AGREEING, ORDER_DIMS[:1], hit_policy=P.ANY).survivors, fee=F.col("fee"))


@query("top_n_per_context", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, where="WHERE rnk <= 2"))
def top_n_per_context(spark, sf_dir):
    return shaped(orders(spark, sf_dir, top_n_per_context=2).survivors)


@query("min_specificity", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, where="WHERE specificity >= 1"))
def min_specificity(spark, sf_dir):
    return shaped(orders(spark, sf_dir, min_specificity=1).survivors)


_GAPS = ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, "idx", where="WHERE specificity >= 1")


@query("min_spec_topn_rule_order", f"SELECT id, rule_name, specificity, rnk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rnk) AS nth FROM ({_GAPS})) WHERE nth <= 2")
def min_spec_topn_rule_order(spark, sf_dir):
    return shaped(orders(spark, sf_dir, hit_policy=P.RULE_ORDER, min_specificity=1, top_n_per_context=2).survivors)


@query("first_min_specificity", f"SELECT id, rule_name, specificity, rnk FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rnk) AS nth FROM ({_GAPS})) WHERE nth = 1")
def first_min_specificity(spark, sf_dir):
    """The first rule of those that are specific enough, which may not be the first of all."""
    return shaped(orders(spark, sf_dir, hit_policy=P.FIRST, min_specificity=1).survivors)


@query("batch_rule_index", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, extra=", CAST(idx AS BIGINT) AS place"))
def batch_rule_index(spark, sf_dir):
    return shaped(orders(spark, sf_dir).survivors, place=F.col("__rule_index"))


@query("for_context_select", f"SELECT rule_name, specificity, rnk FROM ({ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, 'idx', 'WHERE rnk = 1')}) WHERE id = (SELECT min(o_orderkey) FROM orders)")
def for_context_select(spark, sf_dir):
    least = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    found = orders(spark, sf_dir).for_context(least).select(P.FIRST).survivors
    return found.select("rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"))


@query("violation_rows", f"SELECT id, rule_name, specificity FROM (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM ({ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS)})) WHERE n > 1")
def violation_rows(spark, sf_dir):
    """What the error of UNIQUE shows: all survivors of the contexts that have several."""
    try:
        orders(spark, sf_dir, hit_policy=P.UNIQUE)
    except HitPolicyViolationError as e:
        return e.offending.select(F.col("__context_id").alias("id"), "rule_name", F.col("__specificity").cast("int").alias("specificity"))
    raise AssertionError("UNIQUE let several survivors pass")


@query("rules_from_storage", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS))
def rules_from_storage(spark, sf_dir):
    """Rules written and read as Parquet, metadata as YAML, survivors written and read as ORC."""
    base = f"{shared_dir(spark)}/workload-{uuid.uuid4().hex}"
    write_result(ORDER_RULES.frame(spark), f"{base}/rules")
    metadata = DimensionsMetadata.from_yaml(DimensionsMetadata(ORDER_DIMS).to_yaml())
    own = ExpressionRulesEngine(read_rules(spark, f"{base}/rules"), metadata)
    found = own.evaluate_batch(table(spark, sf_dir, "orders"), context_id_field="o_orderkey", check_ids=False).survivors
    write_result(shaped(found), f"{base}/survivors", "orc")
    return read_rules(spark, f"{base}/survivors", "orc")


@query("dimension_subset", ranked_sql(ORDER_RULES, ORDER_SOURCE, {"t_price": ORDER_TERMS["t_price"]}))
def dimension_subset(spark, sf_dir):
    return shaped(orders(spark, sf_dir, dimensions=["price"]).survivors)


@query("observability", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, extra=", CAST(t_priority AS INTEGER) AS t_priority, CAST(t_price AS INTEGER) AS t_price"))
def observability(spark, sf_dir):
    return shaped(orders(spark, sf_dir).survivors, t_priority=F.col("__t_priority"), t_price=F.col("__t_price"))


@query("best_matches", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, where="WHERE rnk = 1", extra=", fee"))
def best_matches(spark, sf_dir):
    return shaped(orders(spark, sf_dir).best_matches, fee=F.col("fee"))


@query("keyed_join_plan", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS))
def keyed_join_plan(spark, sf_dir):
    large = ExpressionRulesEngine(ORDER_RULES.frame(spark), DimensionsMetadata(ORDER_DIMS), broadcast_rules=0)
    return shaped(large.evaluate_batch(table(spark, sf_dir, "orders"), context_id_field="o_orderkey", check_ids=False).survivors)


# strategies --------------------------------------------------------------------------------------

SEGMENT = Rules("rule_name string, segment string, priority string", ("any", U, U), ("building", "BUILDING", U), ("machinery", "MACHINERY", U), ("auto", "AUTOMOBILE", U), ("nothing", None, U))
CUSTOMER_SOURCE = "SELECT c_custkey AS id, c_mktsegment AS seg, c_acctbal AS bal FROM customer"


@query("exact_best", ranked_sql(SEGMENT, CUSTOMER_SOURCE, {"t": eq("segment", "seg")}, where="WHERE rnk = 1"))
def exact_best(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "customer", "c_custkey", SEGMENT, [Dimension("segment", context_field="c_mktsegment")]).best_matches)


PRIORITIES = Rules("rule_name string, priority string", ("any", U), ("not_urgent", "1-URGENT"), ("not_low", "5-LOW"))


@query("not_equal_all", ranked_sql(PRIORITIES, ORDER_SOURCE, {"t": eq("priority", "p", "<>")}))
def not_equal_all(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "orders", "o_orderkey", PRIORITIES, [Dimension("priority", context_field="o_orderpriority", match_strategy=S.NOT_EQUAL)]).survivors)


SPANS = Rules("rule_name string, lo double, hi double", ("all", float(UN), float(UN)), ("small", 0.0, 50000.0), ("up_to", float(UN), 250000.0), ("from", 250000.0, float(UN)), ("mid", 50000.0, 250000.0))


def _span(low: bool, high: bool) -> list[Dimension]:
    return [Dimension("price", context_field="o_totalprice", match_strategy=S.RANGE, data_type="float", range_min_field="lo", range_max_field="hi", range_min_inclusive=low, range_max_inclusive=high)]


@query("range_inclusive", ranked_sql(SPANS, ORDER_SOURCE, {"t": f"least({bound('lo', 'x', '>=')}, {bound('hi', 'x', '<=')})"}))
def range_inclusive(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "orders", "o_orderkey", SPANS, _span(True, True)).survivors)


QUANTITIES = Rules("rule_name string, lo double, hi double", ("one_to_ten", 1.0, 10.0), ("ten_to_twenty", 10.0, 20.0), ("to_ten", float(UN), 10.0))
LINE_SOURCE = "SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity AS q FROM lineitem"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("line"), F.col("l_quantity").alias("q"))


@query("range_exclusive", ranked_sql(QUANTITIES, LINE_SOURCE, {"t": f"least({bound('lo', 'q', '>')}, {bound('hi', 'q', '<')})"}))
def range_exclusive(spark, sf_dir):
    dim = Dimension("q", match_strategy=S.RANGE, data_type="float", range_min_field="lo", range_max_field="hi", range_min_inclusive=False, range_max_inclusive=False)
    return shaped(batch(spark, sf_dir, _lines(spark, sf_dir), "line", QUANTITIES, [dim]).survivors)


@query("range_half_open", ranked_sql(QUANTITIES, LINE_SOURCE, {"t": f"least({bound('lo', 'q', '>=')}, {bound('hi', 'q', '<')})"}))
def range_half_open(spark, sf_dir):
    dim = Dimension("q", match_strategy=S.RANGE, data_type="float", range_min_field="lo", range_max_field="hi", range_max_inclusive=False)
    return shaped(batch(spark, sf_dir, _lines(spark, sf_dir), "line", QUANTITIES, [dim]).survivors)


LIMITS = Rules("rule_name string, above double, below double", ("any", float(UN), float(UN)), ("rich", 5000.0, float(UN)), ("poor", float(UN), 0.0), ("middle", 0.0, 5000.0))


@query("gt_lt_threshold", ranked_sql(LIMITS, CUSTOMER_SOURCE, {"t_a": bound("above", "bal", ">"), "t_b": bound("below", "bal", "<")}))
def gt_lt_threshold(spark, sf_dir):
    dims = [Dimension("above", context_field="c_acctbal", match_strategy=S.GREATER_THAN, data_type="float"), Dimension("below", context_field="c_acctbal", match_strategy=S.LESS_THAN, data_type="float")]
    return shaped(batch(spark, sf_dir, "customer", "c_custkey", LIMITS, dims).survivors)


PERIODS = Rules("rule_name string, starts timestamp_ntz, ends timestamp_ntz", ("always", UDT, UDT), ("y1996", datetime(1996, 1, 1), datetime(1996, 12, 31)), ("since_2000", datetime(2000, 1, 1), UDT))
DAYS = Rules("rule_name string, starts date, ends date", ("always", UD, UD), ("y1997", date(1997, 1, 1), date(1997, 12, 31)), ("until_1996", UD, date(1996, 6, 30)))


@query("datetime_range", ranked_sql(PERIODS, "SELECT o_orderkey AS id, o_orderdate AS d FROM orders", {"t": f"least({bound('starts', 'd', '>=', "TIMESTAMP '0001-01-01'")}, {bound('ends', 'd', '<=', "TIMESTAMP '0001-01-01'")})"}))
def datetime_range(spark, sf_dir):
    dim = Dimension("d", context_field="o_orderdate", match_strategy=S.RANGE, data_type="datetime", range_min_field="starts", range_max_field="ends")
    return shaped(batch(spark, sf_dir, "orders", "o_orderkey", PERIODS, [dim]).survivors)


@query("date_range", ranked_sql(DAYS, "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d FROM orders", {"t": f"least({bound('starts', 'd', '>=', "DATE '0001-01-01'")}, {bound('ends', 'd', '<=', "DATE '0001-01-01'")})"}))
def date_range(spark, sf_dir):
    dim = Dimension("d", match_strategy=S.RANGE, data_type="date", range_min_field="starts", range_max_field="ends")
    contexts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return shaped(batch(spark, sf_dir, contexts, "o_orderkey", DAYS, [dim]).survivors)


PART_RULES = Rules("rule_name string, pattern string", ("any", U), ("a", "small"), ("b", "ring"), ("c", "l r"), ("d", "."), ("e", "Brand#1"))
PART_SOURCE = "SELECT p_partkey AS id, p_name, p_brand FROM part"


def _text(strategy: MatchStrategy, field: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: shaped(batch(spark, sf_dir, "part", "p_partkey", PART_RULES, [Dimension("pattern", context_field=field, match_strategy=strategy)]).survivors)


query("prefix", ranked_sql(PART_RULES, PART_SOURCE, {"t": text_op("starts_with", "pattern", "p_name")}))(_text(S.PREFIX, "p_name"))
query("suffix", ranked_sql(PART_RULES, PART_SOURCE, {"t": text_op("ends_with", "pattern", "p_name")}))(_text(S.SUFFIX, "p_name"))
query("contains", ranked_sql(PART_RULES, PART_SOURCE, {"t": text_op("contains", "pattern", "p_name")}))(_text(S.CONTAINS, "p_name"))
BRANDS = Rules("rule_name string, pattern string", ("any", U), ("low", "#[12]$"), ("high", "#[3-5]"), ("start", "^Brand"), ("never", "^x"))


@query("row_regex", ranked_sql(BRANDS, PART_SOURCE, {"t": text_op("regexp_matches", "pattern", "p_brand")}))
def row_regex(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "part", "p_partkey", BRANDS, [Dimension("pattern", context_field="p_brand", match_strategy=S.REGEX)]).survivors)


ONE = Rules("rule_name string", ("page",), ("other",))


@query("context_regex", ranked_sql(ONE, "SELECT page_id AS id, url FROM pages", {"t": "CASE WHEN regexp_matches(url, '^https://.*[.]org/') THEN 1 ELSE -1 END"}))
def context_regex(spark, sf_dir):
    return shaped(batch(spark, sf_dir, "pages", "page_id", ONE, [Dimension("url", match_strategy=S.CONTEXT_REGEX, regex_pattern="^https://.*[.]org/")]).survivors)


SETS = Rules("rule_name string, kinds array<string>", ("wild", [U]), ("null_list", None), ("trade", ["purchase", "refund"]), ("seen", ["view", "click"]), ("empty", []))
EVENT_SOURCE = "SELECT event_id AS id, nullif(event_type, 'click') AS k, value, user_id FROM events"
_WILD = f"kinds IS NULL OR list_contains(kinds, '{U}') OR k IS NULL"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds nulls here, so one kind of event is turned into null."""
    return table(spark, sf_dir, "events").withColumn("k", F.nullif("event_type", F.lit("click")))


@query("set_membership", ranked_sql(SETS, EVENT_SOURCE, {"t": f"CASE WHEN {_WILD} THEN 0 WHEN list_contains(kinds, k) THEN 1 ELSE -1 END"}))
def set_membership(spark, sf_dir):
    return shaped(batch(spark, sf_dir, _events(spark, sf_dir), "event_id", SETS, [Dimension("k", rule_field="kinds", match_strategy=S.SET_MEMBERSHIP)]).survivors)


@query("set_exclusion", ranked_sql(SETS, EVENT_SOURCE, {"t": f"CASE WHEN {_WILD} THEN 0 WHEN list_contains(kinds, k) THEN -1 ELSE 1 END"}))
def set_exclusion(spark, sf_dir):
    return shaped(batch(spark, sf_dir, _events(spark, sf_dir), "event_id", SETS, [Dimension("k", rule_field="kinds", match_strategy=S.SET_EXCLUSION)]).survivors)


MISSING = Rules("rule_name string, kind string, part string, at_least double", ("any", U, U, float(UN)), ("view", "view", U, 10.0), ("set_text", U, "SET", float(UN)), ("p", U, "p", 50.0))


@query("missing_context", ranked_sql(MISSING, "SELECT event_id AS id, nullif(event_type, 'click') AS k, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS v FROM events", {"t_k": eq("kind", "k"), "t_p": text_op("contains", "part", "k"), "t_v": bound("at_least", "v", ">")}))
def missing_context(spark, sf_dir):
    contexts = _events(spark, sf_dir).withColumn("v", F.when(F.col("user_id") % 3 != 0, F.col("value")))
    dims = [Dimension("kind", context_field="k"), Dimension("part", context_field="k", match_strategy=S.CONTAINS), Dimension("at_least", context_field="v", match_strategy=S.GREATER_THAN, data_type="float")]
    return shaped(batch(spark, sf_dir, contexts, "event_id", MISSING, dims).survivors)


KEYS = Rules("rule_name string, kind string", ("default", U), ("view", "view"), ("purchase", "purchase"))


@query("exact_key", ranked_sql(KEYS, EVENT_SOURCE, {"t": f"CASE WHEN kind = '{U}' THEN 0 WHEN coalesce(kind = k, FALSE) THEN 1 ELSE -1 END"}))
def exact_key(spark, sf_dir):
    return shaped(batch(spark, sf_dir, _events(spark, sf_dir), "event_id", KEYS, [Dimension("kind", context_field="k", match_strategy=S.EXACT_KEY)]).survivors)


FLAGS = Rules("rule_name string, big boolean", ("either", None), ("big", True), ("small", False))


@query("bool_dimension", ranked_sql(FLAGS, "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice > 250000 END AS b FROM orders", {"t": "CASE WHEN big IS NULL OR b IS NULL THEN 0 WHEN big = b THEN 1 ELSE -1 END"}))
def bool_dimension(spark, sf_dir):
    contexts = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") > 250000).alias("big"))
    return shaped(batch(spark, sf_dir, contexts, "o_orderkey", FLAGS, [Dimension("big", data_type="bool")]).survivors)


DISCOUNTS = Rules("rule_name string, worth double", ("small", 1.0), ("large", 3.0))


@query("custom_expression", ranked_sql(DISCOUNTS, "SELECT o_orderkey AS id, o_totalprice AS x, o_orderstatus AS s FROM orders", {"t_w": "CASE WHEN x * 0.00001 >= worth THEN 1 ELSE -1 END", "t_s": "CASE WHEN s = 'F' THEN 1 ELSE 0 END"}))
def custom_expression(spark, sf_dir):
    expressions = {"x": lambda r, c: F.when(c.x.cast("double") * 0.00001 >= r.worth, 1).otherwise(-1), "s": lambda r, c: F.when(c.s == "F", 1).otherwise(0)}
    rules = ExpressionRulesEngine(DISCOUNTS.frame(spark), dimension_expressions=expressions)
    contexts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("__ctx_x"), F.col("o_orderstatus").alias("__ctx_s"))
    prepared = contexts.withColumnRenamed("o_orderkey", "__context_id").repartition("__context_id")
    return shaped(rules.rank_pairs(rules.pairs(prepared, ["x", "s"]), ["x", "s"]).survivors)


# single contexts, explanations, accessors --------------------------------------------------------

_ALONE = "SELECT 0 AS id, '1-URGENT' AS p, 250000.0 AS x"


@query("evaluate_single", ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS).replace("SELECT id, rule_name", "SELECT rule_name"))
def evaluate_single(spark, sf_dir):
    found = engine(spark, ORDER_RULES, *ORDER_DIMS).evaluate({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0}).survivors
    return found.select("rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"))


@query("explain_all", f"WITH {ORDER_RULES.cte()}, ctx AS ({_ALONE}), s AS (SELECT rule_name, CAST({ORDER_TERMS['t_priority']} AS INTEGER) AS t_priority, CAST({ORDER_TERMS['t_price']} AS INTEGER) AS t_price FROM ctx CROSS JOIN rules) SELECT *, least(t_priority, t_price) >= 0 AS survived, CASE WHEN t_priority < 0 THEN 'priority' WHEN t_price < 0 THEN 'price' END AS dropped_by FROM s")
def explain_all(spark, sf_dir):
    found = engine(spark, ORDER_RULES, *ORDER_DIMS).explain({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0})
    return found.with_dropped_by().select("rule_name", F.col("__t_priority").alias("t_priority"), F.col("__t_price").alias("t_price"), F.col("__survived").alias("survived"), "dropped_by")


@query("select_policy", ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS, "salience DESC NULLS LAST, specificity DESC, idx", "WHERE rnk = 1").replace("SELECT id, rule_name", "SELECT rule_name"))
def select_policy(spark, sf_dir):
    collected = engine(spark, ORDER_RULES, *ORDER_DIMS).evaluate({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0})
    return collected.select(P.PRIORITY, "salience").survivors.select("rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"))


@query("select_twice", ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS).replace("SELECT id, rule_name", "SELECT rule_name"))
def select_twice(spark, sf_dir):
    collected = engine(spark, ORDER_RULES, *ORDER_DIMS).evaluate({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0})
    again = collected.select(P.RULE_ORDER).select(P.COLLECT).survivors
    return again.select("rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"))


@query("explain_one", f"SELECT CAST(t_priority AS INTEGER) AS priority, CAST(t_price AS INTEGER) AS price, (SELECT count(*) FROM ({ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS)})) AS survivors FROM ({ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS, where="WHERE rule_name = 'large'", extra=', t_priority, t_price')})")
def explain_one(spark, sf_dir):
    found = engine(spark, ORDER_RULES, *ORDER_DIMS).evaluate({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0})
    t = found.explain("large")
    return spark.createDataFrame([(t["priority"], t["price"], found.count)], "priority int, price int, survivors long")


@query("top_n_one_context", ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS, where="WHERE rnk <= 2").replace("SELECT id, rule_name", "SELECT rule_name"))
def top_n_one_context(spark, sf_dir):
    found = engine(spark, ORDER_RULES, *ORDER_DIMS).evaluate({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0}, top_n=2).survivors
    return found.select("rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"))


@query("at_least", ranked_sql(ORDER_RULES, _ALONE, ORDER_TERMS, where="WHERE specificity >= 1").replace("SELECT id, rule_name", "SELECT rule_name"))
def at_least(spark, sf_dir):
    found = engine(spark, ORDER_RULES, *ORDER_DIMS).evaluate({"o_orderpriority": "1-URGENT", "o_totalprice": 250000.0}).at_least(1)
    return found.select("rule_name", F.col("__specificity").cast("int").alias("specificity"), F.col("__rank").cast("int").alias("rnk"))


BUYERS = Rules("rule_name string, kind string, least double", ("purchase", "purchase", 50.0), ("refund", "refund", float(UN)))
_BUYERS = ranked_sql(BUYERS, "SELECT event_id AS id, event_type AS k, value AS v FROM events", {"t_k": eq("kind", "k"), "t_v": bound("least", "v", ">")})
BUYER_DIMS = [Dimension("kind", context_field="event_type"), Dimension("least", context_field="value", match_strategy=S.GREATER_THAN, data_type="float")]


@query("counts_per_context", f"SELECT id, count(*) AS n FROM ({_BUYERS}) GROUP BY id")
def counts_per_context(spark, sf_dir):
    return batch(spark, sf_dir, "events", "event_id", BUYERS, BUYER_DIMS).counts_per_context.select(F.col("__context_id").alias("id"), F.col("__n").alias("n"))


@query("matched_contexts", f"SELECT DISTINCT id FROM ({_BUYERS})")
def matched_contexts(spark, sf_dir):
    return batch(spark, sf_dir, "events", "event_id", BUYERS, BUYER_DIMS).matched_context_ids.select(F.col("__context_id").alias("id"))


@query("unmatched_contexts", f"SELECT event_id AS id FROM events WHERE event_id NOT IN (SELECT id FROM ({_BUYERS}))")
def unmatched_contexts(spark, sf_dir):
    return batch(spark, sf_dir, "events", "event_id", BUYERS, BUYER_DIMS).unmatched_context_ids(table(spark, sf_dir, "events")).select(F.col("__context_id").alias("id"))


@query("numbered_contexts", "SELECT count(*) AS n, min(i) AS least, max(i) AS most, count(DISTINCT i) AS ids FROM (SELECT row_number() OVER () - 1 AS i FROM orders)")
def numbered_contexts(spark, sf_dir):
    ids = with_index(table(spark, sf_dir, "orders").select("o_orderkey"), "i")
    return ids.agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("least"), F.max("i").alias("most"), F.countDistinct("i").alias("ids"))


@query("stream_scores", f"SELECT id, rule_name, specificity FROM ({ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS)})")
def stream_scores(spark, sf_dir):
    """Orders as a stream of files, scored in append mode and written to a table."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")
    scored = score_stream(engine(spark, ORDER_RULES, *ORDER_DIMS), source, "o_orderkey")
    shown = scored.select(F.col("__context_id").alias("id"), "rule_name", F.col("__specificity").cast("int").alias("specificity"))
    shown.writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(shown.schema).parquet(f"{base}/out")


@query("stream_batches", ranked_sql(ORDER_RULES, ORDER_SOURCE, ORDER_TERMS, "idx", "WHERE rnk = 1"))
def stream_batches(spark, sf_dir):
    """Orders as a stream whose micro-batches are ranked under a policy."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(table(spark, sf_dir, "orders").schema).parquet(f"{sf_dir}/orders.parque[t]")

    def sink(found, number):
        shaped(found.survivors).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    writer = evaluate_stream(engine(spark, ORDER_RULES, *ORDER_DIMS), source, sink, context_id_field="o_orderkey", hit_policy=P.FIRST)
    writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")


# lattices ----------------------------------------------------------------------------------------

OFFERS = Rules(
    "rule_name string, segment string, priority string, lo double, hi double, margin bigint",
    ("o1", "BUILDING", U, 100000.0, 300000.0, 10),
    ("o2", U, U, 200000.0, 400000.0, 5),
    ("o3", "BUILDING", "1-URGENT", float(UN), float(UN), 15),
    ("o4", U, "1-URGENT", float(UN), 250000.0, 20),
    ("o5", "MACHINERY", U, 50000.0, float(UN), 7),
    ("o6", U, "5-LOW", float(UN), float(UN), 3),
)
OFFER_DIMS = [Dimension("segment", context_field="c_mktsegment"), Dimension("priority", context_field="o_orderpriority"), Dimension("price", context_field="o_totalprice", match_strategy=S.RANGE, data_type="float", range_min_field="lo", range_max_field="hi")]
_PRIMES = "[2, 3, 5, 7, 11, 13, 17, 19, 23, 29]"
_MAXU, _MINU = f"(CASE WHEN {{0}} = {UN} THEN {{1}} WHEN {{1}} = {UN} THEN {{0}} ELSE greatest({{0}}, {{1}}) END)", f"(CASE WHEN {{0}} = {UN} THEN {{1}} WHEN {{1}} = {UN} THEN {{0}} ELSE least({{0}}, {{1}}) END)"


def lattice_sql(rules: Rules, key: str | None = None) -> str:
    """All consistent combinations by recursion, then the frontier. Columns k, seg, pri, lo, hi."""
    k = key or "''"
    low, high = _MAXU.format("c.lo", "r.lo"), _MINU.format("c.hi", "r.hi")
    return f"""WITH RECURSIVE {rules.cte()},
    r AS (SELECT {k} AS k, segment AS seg, priority AS pri, lo, hi, margin, ({_PRIMES})[row_number() OVER (PARTITION BY {k} ORDER BY idx)] AS p FROM rules),
    c AS (SELECT k, seg, pri, lo, hi, margin AS s, margin AS mn, margin AS mx, margin AS pr, CAST(p AS BIGINT) AS last, CAST(p AS BIGINT) AS product, 0 AS level FROM r
      UNION ALL
      SELECT c.k, CASE WHEN c.seg = '{U}' THEN r.seg ELSE c.seg END, CASE WHEN c.pri = '{U}' THEN r.pri ELSE c.pri END, {low}, {high},
        c.s + r.margin, least(c.mn, r.margin), greatest(c.mx, r.margin), c.pr * r.margin, CAST(r.p AS BIGINT), c.product * r.p, c.level + 1
      FROM c JOIN r ON c.k = r.k AND c.last < r.p AND (c.seg = '{U}' OR r.seg = '{U}' OR c.seg = r.seg) AND (c.pri = '{U}' OR r.pri = '{U}' OR c.pri = r.pri)
        AND ({low} = {UN} OR {high} = {UN} OR {low} <= {high})),
    f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.k = c.k AND o.seg = c.seg AND o.pri = c.pri AND o.lo = c.lo AND o.hi = c.hi AND o.product <> c.product AND o.product % c.product = 0))"""


def offer_engine(*aggregates: Aggregate, key: bool = False) -> AccumulatorEngine:
    keys = [Dimension("kind", context_field="r_name", role=DimensionRole.CONTEXT_KEY)] if key else []
    return AccumulatorEngine(DimensionsMetadata([*keys, *OFFER_DIMS]), list(aggregates))


_ALL = [Aggregate("margin"), Aggregate("mn", AggregateOp.MIN), Aggregate("mx", AggregateOp.MAX), Aggregate("pr", AggregateOp.PRODUCT)]


def _offers(spark: SparkSession, rules: Rules = OFFERS) -> DataFrame:
    return rules.frame(spark).withColumns({"mn": F.col("margin"), "mx": F.col("margin"), "pr": F.col("margin")})


@query("lattice_build", lattice_sql(OFFERS) + " SELECT product, seg, pri, lo, hi, CAST(level AS INTEGER) AS level, CAST(level + 1 AS INTEGER) AS rule_count FROM f")
def lattice_build(spark, sf_dir):
    return offer_engine().build(OFFERS.frame(spark)).combinations.select(F.col("__prime_product").alias("product"), F.col("co_segment").alias("seg"), F.col("co_priority").alias("pri"), F.col("co_lo").alias("lo"), F.col("co_hi").alias("hi"), F.col("__level").alias("level"), (F.col("__level") + 1).alias("rule_count"))


@query("lattice_aggregates", lattice_sql(OFFERS) + " SELECT product, CAST(s AS BIGINT) AS s, mn, mx, CAST(pr AS BIGINT) AS pr FROM f")
def lattice_aggregates(spark, sf_dir):
    return offer_engine(*_ALL).build(_offers(spark)).combinations.select(F.col("__prime_product").alias("product"), F.col("__agg_margin").alias("s"), F.col("__agg_mn").alias("mn"), F.col("__agg_mx").alias("mx"), F.col("__agg_pr").alias("pr"))


_MATCH = f"(f.seg = '{U}' OR f.seg = x.c_mktsegment) AND (f.pri = '{U}' OR f.pri = x.o_orderpriority) AND (f.lo = {UN} OR x.o_totalprice >= f.lo) AND (f.hi = {UN} OR x.o_totalprice <= f.hi)"


@query("lattice_apply", lattice_sql(OFFERS) + f" SELECT o_orderkey AS id, max(s) AS best, count(*) AS n FROM (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey) AS x JOIN f ON {_MATCH} GROUP BY o_orderkey")
def lattice_apply(spark, sf_dir):
    own = offer_engine(Aggregate("margin"))
    contexts = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = own.index([own.build(OFFERS.frame(spark))]).apply_batch(contexts, "o_orderkey").survivors
    return found.groupBy(F.col("__context_id").alias("id")).agg(F.max("__agg_margin").alias("best"), F.count(F.lit(1)).alias("n"))


REGIONAL = Rules(
    "rule_name string, kind string, segment string, priority string, lo double, hi double, margin bigint",
    ("a1", "ASIA", "BUILDING", U, float(UN), 200000.0, 4),
    ("a2", "ASIA", U, "1-URGENT", float(UN), float(UN), 6),
    ("a3", "ASIA", "MACHINERY", U, float(UN), float(UN), 1),
    ("e1", "EUROPE", U, U, 100000.0, float(UN), 2),
    ("e2", "EUROPE", "BUILDING", "5-LOW", float(UN), float(UN), 9),
    ("d1", U, U, U, float(UN), float(UN), 8),
    ("d2", U, U, "2-HIGH", 150000.0, float(UN), 5),
)


@query("lattice_partitioned", lattice_sql(REGIONAL, "kind") + " SELECT k, product, seg, pri, lo, hi, CAST(s AS BIGINT) AS s FROM f")
def lattice_partitioned(spark, sf_dir):
    frame = offer_engine(Aggregate("margin"), key=True).build_frame(REGIONAL.frame(spark))
    return frame.select(F.col("__key_kind").alias("k"), F.col("__prime_product").alias("product"), F.col("co_segment").alias("seg"), F.col("co_priority").alias("pri"), F.col("co_lo").alias("lo"), F.col("co_hi").alias("hi"), F.col("__agg_margin").alias("s"))


@query("lattice_route", lattice_sql(REGIONAL, "kind") + f", x AS (SELECT o_orderkey, o_orderpriority, o_totalprice, c_mktsegment, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN r_name ELSE '{U}' END AS route FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) SELECT o_orderkey AS id, CAST(max(s) AS BIGINT) AS best, count(*) AS n FROM x JOIN f ON f.k = x.route AND {_MATCH} GROUP BY o_orderkey")
def lattice_route(spark, sf_dir):
    own = offer_engine(Aggregate("margin"), key=True)
    t = functools.partial(table, spark, sf_dir)
    contexts = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    found = own.index(own.build_all(REGIONAL.frame(spark))).apply_batch(contexts, "o_orderkey").survivors
    return found.groupBy(F.col("__context_id").alias("id")).agg(F.max("__agg_margin").alias("best"), F.count(F.lit(1)).alias("n"))


_ONE = "(SELECT 'BUILDING' AS c_mktsegment, '1-URGENT' AS o_orderpriority, 220000.0 AS o_totalprice)"
_CONTEXT = {"c_mktsegment": "BUILDING", "o_orderpriority": "1-URGENT", "o_totalprice": 220000.0}


@query("lattice_saved", lattice_sql(OFFERS) + f" SELECT product, CAST(s AS BIGINT) AS s, CAST(level AS INTEGER) AS level FROM {_ONE} AS x JOIN f ON {_MATCH}")
def lattice_saved(spark, sf_dir):
    """A lattice that was saved and loaded, applied to one context."""
    own = offer_engine(Aggregate("margin"))
    path = f"{shared_dir(spark)}/lattice-{uuid.uuid4().hex}"
    own.build(OFFERS.frame(spark)).save(path)
    found = own.apply(Lattice.load(path, spark), _CONTEXT).survivors
    return found.select(F.col("__prime_product").alias("product"), F.col("__agg_margin").alias("s"), F.col("__level").cast("int").alias("level"))


@query("lattice_apply_auto", lattice_sql(REGIONAL, "kind") + f" SELECT product, CAST(s AS BIGINT) AS s FROM {_ONE} AS x JOIN f ON f.k = 'ASIA' AND {_MATCH}")
def lattice_apply_auto(spark, sf_dir):
    own = offer_engine(Aggregate("margin"), key=True)
    found = own.apply_auto(own.build_all(REGIONAL.frame(spark)), {**_CONTEXT, "r_name": "ASIA"}).survivors
    return found.select(F.col("__prime_product").alias("product"), F.col("__agg_margin").alias("s"))


@query("lattice_one_partition", lattice_sql(REGIONAL, "kind") + " SELECT product, CAST(s AS BIGINT) AS s FROM f WHERE k = 'EUROPE'")
def lattice_one_partition(spark, sf_dir):
    own = offer_engine(Aggregate("margin"), key=True)
    return own.build(REGIONAL.frame(spark), {"kind": "EUROPE"}).combinations.select(F.col("__prime_product").alias("product"), F.col("__agg_margin").alias("s"))


@query("lattice_best", lattice_sql(OFFERS) + f" SELECT product, CAST(s AS BIGINT) AS s FROM (SELECT *, row_number() OVER (ORDER BY (seg <> '{U}')::INT + (pri <> '{U}')::INT + (lo <> {UN} AND hi <> {UN})::INT DESC, product) AS n FROM {_ONE} AS x JOIN f ON {_MATCH}) WHERE n = 1")
def lattice_best(spark, sf_dir):
    own = offer_engine(Aggregate("margin"))
    found = own.apply(own.build(OFFERS.frame(spark)), _CONTEXT).best_combination
    return found.select(F.col("__prime_product").alias("product"), F.col("__agg_margin").alias("s"))


BANDS = Rules(
    "rule_name string, cell string, least_of bigint, most_of bigint, kinds array<string>, barred array<string>, margin bigint",
    ("b1", "x", 10, UN, ["view", "click"], ["AU"], 1),
    ("b2", "x", 20, 100, ["click", "refund"], ["NZ", "AU"], 2),
    ("b3", "y", UN, 50, None, None, 4),
    ("b4", "y", 5, 80, ["purchase"], ["US"], 8),
    ("b5", "z", 15, UN, ["click"], ["AU"], 16),
)
BAND_DIMS = [
    Dimension("least_of", match_strategy=S.GREATER_THAN, data_type="int"),
    Dimension("most_of", match_strategy=S.LESS_THAN, data_type="int"),
    Dimension("kinds", match_strategy=S.SET_MEMBERSHIP),
    Dimension("barred", match_strategy=S.SET_EXCLUSION),
]


def band_sql(guard: str = "") -> str:
    """Combinations of BANDS: greatest and least thresholds, common members, all exclusions."""
    wild = lambda c: f"list_contains({c}, '{U}')"
    pick = lambda c, both: f"CASE WHEN {wild('c.' + c)} THEN r.{c} WHEN {wild('r.' + c)} THEN c.{c} ELSE {both} END"
    at = lambda f, c: f"CASE WHEN c.{c} = {UN} THEN r.{c} WHEN r.{c} = {UN} THEN c.{c} ELSE {f}(c.{c}, r.{c}) END"
    return f"""WITH RECURSIVE {BANDS.cte()},
    r AS (SELECT over_, under_, coalesce(list_sort(kinds), ['{U}']) AS kinds, coalesce(list_sort(barred), ['{U}']) AS barred, cell, margin, ({_PRIMES})[idx + 1] AS p FROM (SELECT idx, cell, least_of AS over_, most_of AS under_, kinds, barred, margin FROM rules)),
    c AS (SELECT over_, under_, kinds, barred, [cell] AS cells, margin AS s, CAST(p AS BIGINT) AS last, CAST(p AS BIGINT) AS product FROM r
      UNION ALL
      SELECT {at('greatest', 'over_')}, {at('least', 'under_')}, {pick('kinds', 'list_sort(list_intersect(c.kinds, r.kinds))')}, {pick('barred', 'list_sort(list_distinct(list_concat(c.barred, r.barred)))')},
        list_append(c.cells, r.cell), c.s + r.margin, CAST(r.p AS BIGINT), c.product * r.p
      FROM c JOIN r ON c.last < r.p AND ({wild('c.kinds')} OR {wild('r.kinds')} OR list_has_any(c.kinds, r.kinds)){guard}),
    f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.over_ = c.over_ AND o.under_ = c.under_ AND o.kinds = c.kinds AND o.barred = c.barred AND o.product <> c.product AND o.product % c.product = 0))
    SELECT product, over_ AS least, under_ AS most, array_to_string(kinds, ',') AS kinds, array_to_string(barred, ',') AS barred, CAST(s AS BIGINT) AS s FROM f"""


def _bands(spark: SparkSession, **options: Any) -> DataFrame:
    found = AccumulatorEngine(DimensionsMetadata(BAND_DIMS), [Aggregate("margin")], **options).build(BANDS.frame(spark)).combinations
    return found.select(F.col("__prime_product").alias("product"), F.col("co_least_of").alias("least"), F.col("co_most_of").alias("most"), F.array_join("co_kinds", ",").alias("kinds"), F.array_join("co_barred", ",").alias("barred"), F.col("__agg_margin").alias("s"))


@query("lattice_thresholds_sets", band_sql())
def lattice_thresholds_sets(spark, sf_dir):
    return _bands(spark)


@query("lattice_exclusive", band_sql(" AND NOT list_contains(c.cells, r.cell)"))
def lattice_exclusive(spark, sf_dir):
    """Rules of one cell never combine."""
    return _bands(spark, exclusive_field="cell")
