"""The filter engine: score every rule against every context, drop mismatches, rank the rest.

Pairs come from a join. While the rules are few they are broadcast, after their number was checked,
and contexts stay where they are; contexts are dealt by id before the join, so ranking needs no
second exchange of the far more numerous pairs. Beyond that an equality dimension gives the join a
key: rules with a value there meet contexts by a hash join, whose hot keys adaptive execution splits,
and only its wildcards and the contexts without a value meet all of the other side, in parts of the
rules that may be broadcast. There is no cartesian product in any plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from operator import add
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternary_rules.functions.sentinels import SPARK_TYPE, is_sentinel, literal, not_set, unknown_sentinel_for
from ternary_rules.functions.strategies import DimensionCompiler, PairCompiler, conjunction, ctx
from ternary_rules.plans.model import SETS, DataType, Dimension, DimensionsMetadata, HitPolicy, MatchStrategy
from ternary_rules.sources.contexts import context_literals, prepare_contexts, reject_reserved, with_index

from .hit_policy import ONE_ROW, HitPolicyViolationError, apply_cardinality, check_assertions, ordering_keys, selection_info_from_metadata
from .results import BatchRuleResult, ExplainResult, RuleResult

#: Rules, and bytes of them as JSON, that one broadcast sends to every executor at most.
BROADCAST_RULES, BROADCAST_BYTES = 50_000, 128 << 20
#: Broadcasts, each of a part of the rules, that one evaluation makes at most.
MOST_PARTS = 64
#: Distinct patterns of a REGEX dimension that become literals of the plan at most.
LITERAL_PATTERNS = 256
_CLASSES = {"string": "text", "boolean": "bool", "date": "time", "timestamp": "time", "timestamp_ntz": "time"}


def _class(type_name: str) -> str:
    return "number" if type_name.startswith(("decimal", "tinyint", "smallint", "int", "bigint", "float", "double")) else _CLASSES.get(type_name, type_name)


class _Named:
    """Columns by name or attribute, for custom expressions."""

    def __init__(self, prefix: str = ""):
        self._prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(f"`{self._prefix}{name}`")

    __getattr__ = __getitem__


class ExpressionRulesEngine:
    """rules: a DataFrame, one row per rule. dimension_metadata or dimension_expressions says what
    its columns mean; an expression is a Column over the rules' columns and `__ctx_<name>`, or a
    function of (rule columns, context columns) that returns one. rule_order_field names a column to
    order rules by; else rules keep the order of their partitions, which is stable for a stored table."""

    def __init__(self, rules: DataFrame, dimension_metadata: DimensionsMetadata | None = None, dimension_expressions: dict[str, Column | Callable] | None = None, rule_order_field: str | None = None, broadcast_rules: int = BROADCAST_RULES):
        if dimension_metadata is not None and dimension_expressions is not None:
            raise ValueError("give dimension_metadata or dimension_expressions, not both")
        if dimension_metadata is None and not dimension_expressions:
            raise ValueError("Must provide what the columns of the rules mean, as metadata or as expressions")
        reject_reserved(rules, "rules")
        self.rules, self.metadata, self.broadcast_rules = rules, dimension_metadata, broadcast_rules
        if dimension_metadata is not None:
            self._check_schema(rules, dimension_metadata)
            self._check_cells(rules, dimension_metadata)
            self.expressions = DimensionCompiler().compile_dimensions(dimension_metadata)
        else:
            self.expressions = {n: e if isinstance(e, Column) else e(_Named(), _Named("__ctx_")) for n, e in dimension_expressions.items()}
        self._order_field, self._indexed, self._size, self._patterns = rule_order_field, None, None, {}

    @staticmethod
    def _check_schema(rules: DataFrame, metadata: DimensionsMetadata) -> None:
        types = dict(rules.dtypes)
        for d in metadata.dimensions:
            for f in d.rule_fields:
                if f not in types:
                    raise ValueError(f"dimension '{d.dimension_name}': rules have no column '{f}'")
                want = SPARK_TYPE[d.data_type]
                have = types[f].removeprefix("array<").removesuffix(">") if d.match_strategy in SETS else types[f]
                if have != "void" and _class(have) != _class(want):
                    raise ValueError(f"dimension '{d.dimension_name}': column '{f}' is {types[f]}, not {want}")

    @staticmethod
    def _check_cells(rules: DataFrame, metadata: DimensionsMetadata) -> None:
        """One job, if there are sets or row patterns: lists hold no nulls, and the wildcard only by
        itself; patterns can be read."""
        bad = []
        for d in metadata.dimensions:
            cell = F.col(f"`{d.resolved_rule_field}`")
            if d.match_strategy in SETS:
                values = cell.cast(f"array<{SPARK_TYPE[d.data_type]}>")
                mark, none = literal(unknown_sentinel_for(d.data_type), d.data_type), not_set(d.data_type)
                mixed = F.array_contains(values, mark) & (F.size(F.array_distinct(values)) > 1)
                # without its nulls a list is shorter; array_contains would not tell of them
                wrong = F.coalesce(mixed, F.lit(False)) | F.coalesce(F.array_contains(values, none), F.lit(False)) | (F.size(F.array_compact(values)) < F.size(values))
                bad.append((f"dimension '{d.dimension_name}': a list in '{d.resolved_rule_field}' holds a null or a reserved mark", F.max(F.coalesce(wrong, F.lit(False)))))
            elif d.match_strategy is MatchStrategy.REGEX:
                text = cell.cast("string")
                bad.append(("", F.max(F.when(~is_sentinel(text, d.data_type), F.regexp_like(F.lit(""), text)))))
        if not bad:
            return
        try:
            found = rules.agg(*[c.alias(str(k)) for k, (_, c) in enumerate(bad)]).first()
        except Exception as e:
            if "PatternSyntax" in str(e) or "INVALID_REGEXP" in str(e) or "REGEX" in str(e).upper():
                raise ValueError(f"a REGEX dimension cannot read a pattern: {str(e).splitlines()[0]}") from e
            raise
        for (message, _), wrong in zip(bad, found, strict=True):
            if wrong and message:  # of a pattern it is enough that it was read
                raise ValueError(message)

    # rules -------------------------------------------------------------------------------------

    @property
    def indexed_rules(self) -> DataFrame:
        """The rules with `__rule_index`, their zero-based place."""
        if self._indexed is None:
            if self._order_field is None:
                self._indexed = with_index(self.rules, "__rule_index")
            else:  # one row per rule; the order is total for unique values
                order = Window.orderBy(F.col(f"`{self._order_field}`"))
                self._indexed = self.rules.withColumn("__rule_index", (F.row_number().over(order) - 1).cast("bigint"))
        return self._indexed

    @property
    def rules_size(self) -> tuple[int, int]:
        """The number of rules and their bytes as JSON, which bounds what a broadcast of them takes."""
        if self._size is None:
            text = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.rules.columns])))
            n, size = self.rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(text), F.lit(0))).first()
            self._size = (int(n), int(size))
        return self._size

    def _active(self, dimensions: list[str] | None) -> list[str]:
        if not dimensions:
            return list(self.expressions)
        for name in dimensions:
            if name not in self.expressions:
                raise KeyError(name)
        return list(dimensions)

    def _dimensions(self, active: list[str]) -> list[Dimension]:
        if self.metadata is not None:
            return [self.metadata.get_dimension(n) for n in active]
        return [Dimension(dimension_name=n) for n in active]

    # scoring -----------------------------------------------------------------------------------

    def _pair_compiler(self, active: list[str]) -> PairCompiler | None:
        """For the pairs of a join; None for custom expressions, which may mix both sides at will."""
        if self.metadata is None:
            return None
        dimensions = self._dimensions(active)
        for d in dimensions:
            if d.match_strategy is MatchStrategy.REGEX and d.dimension_name not in self._patterns:
                cell = F.col(f"`{d.resolved_rule_field}`").cast("string")
                found = self.rules.where(~is_sentinel(cell, d.data_type)).select(cell).distinct().limit(LITERAL_PATTERNS + 1).collect()
                self._patterns[d.dimension_name] = sorted(r[0] for r in found) if len(found) <= LITERAL_PATTERNS else None
        return PairCompiler(dimensions, {d.dimension_name: p for d in dimensions if (p := self._patterns.get(d.dimension_name)) is not None})

    def _survivors(self, pairs: DataFrame, active: list[str]) -> DataFrame:
        """The scored rows of pairs() that no dimension rules out."""
        compiler = self._pair_compiler(active)
        if compiler is None:
            return self._scored(pairs, active).where("__survived")
        left = pairs.where(compiler.survives())
        return self._scored(left, active, compiler.values()).drop(*compiler.rule_columns(), *compiler.context_columns())

    def _scored(self, pairs: DataFrame, active: list[str], expressions: dict[str, Column] | None = None) -> DataFrame:
        expressions = self.expressions if expressions is None else expressions
        values = pairs.withColumns({f"__t_{n}": F.coalesce(expressions[n], F.lit(0)) for n in active})
        t = [F.col(f"`__t_{n}`") for n in active]
        return values.withColumn("__survived", conjunction(t) >= 0).withColumn("__specificity", reduce(add, [(x == 1).cast("int") for x in t]))

    def _finish(self, df: DataFrame, active: list[str], observability: bool) -> DataFrame:
        away = ["__survived", *[ctx(n) for n in self.expressions], *([] if observability else [f"__t_{n}" for n in active])]
        return df.drop(*away)

    def _policy(self, hit_policy: HitPolicy | None) -> HitPolicy:
        return HitPolicy(hit_policy) if hit_policy is not None else self.metadata.hit_policy if self.metadata is not None else HitPolicy.COLLECT

    def _bound(self, context: Any, active: list[str]) -> DataFrame:
        if self.metadata is not None:
            literals = context_literals(context, self._dimensions(active))
        else:
            from ternary_rules.sources.contexts import extract_context_values

            literals = {ctx(n): F.lit(v) for n, v in extract_context_values(context, active).items()}
        return self.indexed_rules.withColumns(literals)

    def evaluate(self, context: Any, dimensions: list[str] | None = None, top_n: int | None = None, min_specificity: int | None = None, include_observability: bool = True, hit_policy: HitPolicy | None = None, priority_field: str | None = None) -> RuleResult:
        """The ranked survivors for one context. Ranks are given before min_specificity and top_n."""
        active, policy = self._active(dimensions), self._policy(hit_policy)
        info = selection_info_from_metadata(self.metadata, priority_field, include_observability)
        order = ordering_keys(policy, info.priority_field)
        survivors = self._scored(self._bound(context, active), active).where("__survived")
        check_assertions(survivors, policy, info, [])
        ranked = survivors.withColumn("__rank", F.row_number().over(Window.orderBy(*order)))
        if min_specificity is not None:
            ranked = ranked.where(F.col("__specificity") >= min_specificity)
        if top_n is not None:
            ranked = ranked.orderBy("__rank").limit(top_n)
        cut = top_n is not None or min_specificity is not None
        result = self._finish(apply_cardinality(ranked, policy, [], min_specificity is not None), active, include_observability)
        return RuleResult(result, active, replace(info, truncated=cut or policy in ONE_ROW))

    def explain(self, context: Any, dimensions: list[str] | None = None) -> ExplainResult:
        """All rules, scored; none dropped, none ranked."""
        active = self._active(dimensions)
        if not active:
            raise ValueError("no dimension is active")
        return ExplainResult(self._scored(self._bound(context, active), active).drop("__rule_index", *[ctx(n) for n in self.expressions]), active)

    # many contexts -----------------------------------------------------------------------------

    def _key_dimension(self, active: list[str]) -> Dimension | None:
        """An equality dimension to join large rule tables by: the one with fewest wildcards."""
        if self.metadata is None:
            return None
        usable = [d for d in self._dimensions(active) if d.match_strategy in (MatchStrategy.EXACT, MatchStrategy.EXACT_KEY) and d.data_type is not DataType.BOOL]
        if not usable:
            return None
        wild = self.rules.agg(*[F.count(F.when(is_sentinel(F.col(f"`{d.resolved_rule_field}`").cast(SPARK_TYPE[d.data_type]), d.data_type), 1)).alias(str(k)) for k, d in enumerate(usable)]).first()
        return usable[min(range(len(usable)), key=lambda k: wild[k])]

    def pairs(self, contexts: DataFrame, active: list[str], on: list[str] | None = None, indexed: bool = True) -> DataFrame:
        """Prepared contexts with every rule that may survive; `on` names columns that both sides hold."""
        rules = self.indexed_rules if indexed else self.rules
        compiler = self._pair_compiler(active)
        if compiler is not None:
            rules, contexts = rules.withColumns(compiler.rule_columns()), contexts.withColumns(compiler.context_columns())
        if on:
            return contexts.join(rules, on)
        n, size = self.rules_size
        key = None if self._fits(n, size) else self._key_dimension(active)
        if key is None:
            return self._with_all(contexts, rules, n, size)
        r = F.col(f"`{key.resolved_rule_field}`").cast(SPARK_TYPE[key.data_type])
        c = F.col(f"`{ctx(key.dimension_name)}`")
        open_rule = is_sentinel(r, key.data_type)
        n_open = rules.where(open_rule).count()
        parts = [contexts.join(rules.where(~open_rule), c == r), self._with_all(contexts, rules.where(open_rule), n_open, size)]
        missing = contexts.where(is_sentinel(c, key.data_type))
        # EXACT_KEY takes a missing value for a mismatch; where no context lacks the value there is nothing to pair
        if key.match_strategy is not MatchStrategy.EXACT_KEY and (contexts.isStreaming or not missing.isEmpty()):
            parts.append(self._with_all(missing, rules.where(~open_rule), n - n_open, size))
        return reduce(DataFrame.unionByName, parts)

    def _fits(self, n: int, size: int) -> bool:
        return n <= self.broadcast_rules and size <= BROADCAST_BYTES

    def _with_all(self, contexts: DataFrame, rules: DataFrame, n: int, size: int) -> DataFrame:
        """Every pair, by broadcasts of parts of the rules that each fit."""
        parts = max(1, -(-n // max(self.broadcast_rules, 1_000)), -(-size // BROADCAST_BYTES))
        if parts > MOST_PARTS:
            raise ValueError(f"{n} rules of {size} bytes would meet every context: give an EXACT or EXACT_KEY dimension with few wildcards, or raise broadcast_rules")
        if parts == 1:
            return contexts.crossJoin(F.broadcast(rules))  # of a checked size
        part = F.pmod(F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in self.rules.columns]))), F.lit(2 * parts))
        return reduce(DataFrame.unionByName, [contexts.crossJoin(F.broadcast(rules.where(part == k))) for k in range(2 * parts)])

    def evaluate_batch(self, contexts: DataFrame, *, context_id_field: str | None = None, dimensions: list[str] | None = None, hit_policy: HitPolicy | None = None, priority_field: str | None = None, top_n_per_context: int | None = None, min_specificity: int | None = None, include_observability: bool = True, chunk_size: int | None = None, check_ids: bool = True) -> BatchRuleResult:
        """The ranked survivors of every context; for each id what evaluate() gives for it alone.
        chunk_size is accepted and not needed: partitions bound the memory."""
        active = self._active(dimensions)
        prepared = prepare_contexts(contexts, self._dimensions(active), context_id_field, check_ids)
        return self.rank_pairs(self.pairs(prepared.repartition("__context_id"), active), active, context_id_field, hit_policy, priority_field, top_n_per_context, min_specificity, include_observability)

    def rank_pairs(self, pairs: DataFrame, active: list[str], context_id_field: str | None = None, hit_policy: HitPolicy | None = None, priority_field: str | None = None, top_n_per_context: int | None = None, min_specificity: int | None = None, include_observability: bool = True) -> BatchRuleResult:
        policy = self._policy(hit_policy)
        info = selection_info_from_metadata(self.metadata, priority_field, include_observability)
        order = ordering_keys(policy, info.priority_field)
        survivors = self._survivors(pairs, active)
        check_assertions(survivors, policy, info, ["__context_id"])
        one = Window.partitionBy("__context_id").orderBy(*order)
        ranked = survivors.withColumn("__rank", F.row_number().over(one))
        if min_specificity is not None:
            ranked = ranked.where(F.col("__specificity") >= min_specificity)
        if top_n_per_context is not None:
            if min_specificity is None:
                ranked = ranked.where(F.col("__rank") <= top_n_per_context)
            else:  # the first n rows that are left, whose ranks may have gaps
                again = Window.partitionBy("__context_id").orderBy("__rank")
                ranked = ranked.withColumn("__nth", F.row_number().over(again)).where(F.col("__nth") <= top_n_per_context).drop("__nth")
        out = self._finish(apply_cardinality(ranked, policy, ["__context_id"], min_specificity is not None), active, include_observability)
        cut = top_n_per_context is not None or min_specificity is not None
        return BatchRuleResult(out, active, context_id_field, replace(info, truncated=cut or policy in ONE_ROW))


__all__ = ["BROADCAST_RULES", "ExpressionRulesEngine", "HitPolicyViolationError"]
