"""The accumulator: all consistent combinations of rules, with merged conditions and folded values.

A build handles all partitions at once: the partition's key columns are part of every join, so
levels of independent partitions grow side by side in one job per level. Each level is a stored
table; chaining levels lazily would repeat all earlier ones.
"""

from __future__ import annotations

import weakref
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ternary_rules.functions.sentinels import SPARK_TYPE, is_unknown, unknown
from ternary_rules.plans.model import SETS, Aggregate, AggregateOp, Dimension, DimensionRole, DimensionsMetadata, MatchStrategy
from ternary_rules.sources.contexts import with_index
from ternary_rules.sources.storage import stored

from .filter_engine import ExpressionRulesEngine
from .results import RuleResult

MAX_RULES = 10_000
INT64 = 2**63 - 1


class LatticeWidthExceededError(OverflowError):
    """A combination's product of primes does not fit 64 bits."""


def _primes(n: int) -> list[int]:
    out: list[int] = []
    candidate = 2
    while len(out) < n:
        for p in out:
            if p * p > candidate:
                out.append(candidate)
                break
            if candidate % p == 0:
                break
        else:
            out.append(candidate)
        candidate += 1
    return out


_TABLE = _primes(MAX_RULES)


def get_prime(index: int) -> int:
    if not 0 <= index < MAX_RULES:
        raise IndexError(f"a partition holds {MAX_RULES} rules at most, not {index + 1}")
    return _TABLE[index]


def checked_multiply(a: int, b: int) -> int:
    if a * b > INT64:
        raise LatticeWidthExceededError(f"{a} * {b} does not fit 64 bits")
    return a * b


def co(name: str) -> str:
    return f"co_{name}"


class AccumulatorCompiler:
    """Pairwise expressions of a combination (`co_*` columns) and a further rule (`*_rhs` columns).
    Only UNKNOWN and null are wildcards here."""

    SUPPORTED = {MatchStrategy.EXACT, MatchStrategy.RANGE, MatchStrategy.GREATER_THAN, MatchStrategy.LESS_THAN, *SETS}

    def _need(self, dim: Dimension) -> MatchStrategy:
        if dim.match_strategy not in self.SUPPORTED:
            raise ValueError(f"dimension '{dim.dimension_name}': {dim.match_strategy.name} cannot be merged")
        return dim.match_strategy

    def fields(self, dim: Dimension) -> tuple[str, ...]:
        self._need(dim)
        return dim.rule_fields

    def _sides(self, field: str) -> tuple[Column, Column]:
        return F.col(f"`{co(field)}`"), F.col(f"`{co(field)}_rhs`")

    def is_wild(self, column: Column, dim: Dimension) -> Column:
        if dim.match_strategy in SETS:
            return column.isNull() | F.coalesce(F.array_contains(column, unknown(dim.data_type)), F.lit(False))
        return is_unknown(column, dim.data_type)

    def canonical(self, dim: Dimension, field: str) -> Column:
        """A rule's own column in the form that combinations keep: typed, wildcards in-band, sets sorted."""
        raw = F.col(f"`{field}`")
        if dim.match_strategy in SETS:
            values = raw.cast(f"array<{SPARK_TYPE[dim.data_type]}>")
            return F.when(self.is_wild(values, dim), F.array(unknown(dim.data_type))).otherwise(F.array_sort(F.array_distinct(values)))
        typed = raw.cast(SPARK_TYPE[dim.data_type])
        typed = typed + F.lit(0.0) if dim.data_type.value == "float" else typed  # -0.0 is 0.0
        return F.when(is_unknown(typed, dim.data_type), unknown(dim.data_type)).otherwise(typed)

    def _merged_range(self, dim: Dimension) -> tuple[Column, Column]:
        (low, low_rhs), (high, high_rhs) = self._sides(dim.range_min_field), self._sides(dim.range_max_field)
        known = lambda x: F.when(~is_unknown(x, dim.data_type), x)  # noqa: E731  greatest and least skip nulls
        return F.greatest(known(low), known(low_rhs)), F.least(known(high), known(high_rhs))

    def compile_compatible(self, dim: Dimension) -> Column:
        strategy = self._need(dim)
        if strategy is MatchStrategy.RANGE:
            low, high = self._merged_range(dim)
            inside = low <= high if dim.range_min_inclusive and dim.range_max_inclusive else low < high
            return F.coalesce(inside, F.lit(True))
        left, right = self._sides(dim.resolved_rule_field)
        if strategy is MatchStrategy.EXACT:
            return self.is_wild(left, dim) | self.is_wild(right, dim) | F.coalesce(left == right, F.lit(False))
        if strategy is MatchStrategy.SET_MEMBERSHIP:
            return self.is_wild(left, dim) | self.is_wild(right, dim) | F.coalesce(F.arrays_overlap(left, right), F.lit(False))
        return F.lit(True)

    def compile_coalesce(self, dim: Dimension) -> list[Column]:
        """The merged columns, named as the combination's."""
        strategy = self._need(dim)
        if strategy is MatchStrategy.RANGE:
            return [F.coalesce(x, unknown(dim.data_type)).alias(co(f)) for x, f in zip(self._merged_range(dim), dim.rule_fields, strict=True)]
        field = dim.resolved_rule_field
        left, right = self._sides(field)
        one = F.when(self.is_wild(left, dim), right).when(self.is_wild(right, dim), left)
        both = {
            MatchStrategy.EXACT: lambda: left,
            MatchStrategy.GREATER_THAN: lambda: F.greatest(left, right),
            MatchStrategy.LESS_THAN: lambda: F.least(left, right),
            MatchStrategy.SET_MEMBERSHIP: lambda: F.array_sort(F.array_intersect(left, right)),
            MatchStrategy.SET_EXCLUSION: lambda: F.array_sort(F.array_union(left, right)),
        }[strategy]()
        return [one.otherwise(both).alias(co(field))]

    def na_name(self, dim: Dimension) -> str:
        return f"co_{dim.dimension_name if dim.match_strategy is MatchStrategy.RANGE else dim.resolved_rule_field}_na"

    def compile_coalesce_na_flag(self, dim: Dimension) -> Column:
        wild = [self.is_wild(x, dim) for f in self.fields(dim) for x in self._sides(f)]
        out = wild[0]
        for w in wild[1:]:
            out = out & w
        return out.cast("int").alias(self.na_name(dim))

    def anchor_na_flag(self, dim: Dimension) -> Column:
        wild = [self.is_wild(self.canonical(dim, f), dim) for f in self.fields(dim)]
        return (wild[0] if len(wild) == 1 else wild[0] & wild[1]).cast("int").alias(self.na_name(dim))


_FOLD = {AggregateOp.SUM: lambda a, b: a + b, AggregateOp.MIN: F.least, AggregateOp.MAX: F.greatest, AggregateOp.PRODUCT: lambda a, b: a * b}


class AccumulatorResult(RuleResult):
    """The combinations that a context matches."""

    def accumulated(self, name: str) -> DataFrame:
        return self._df.select(f"__agg_{name}")

    @property
    def provenance(self) -> DataFrame:
        return self._df.select("__prime_product")

    @property
    def depths(self) -> DataFrame:
        return self._df.select("__level")

    @property
    def best_combination(self) -> DataFrame:
        return self.best_match


class AccumulatorEngine:
    """exclusive_field: a column whose equal values never combine, such as cells of one rate card."""

    def __init__(self, dimension_metadata: DimensionsMetadata, aggregates: list[Aggregate] | None = None, exclusive_field: str | None = None, rule_order_field: str | None = None):
        self.metadata, self.aggregates = dimension_metadata, list(aggregates or [])
        self.constraints = [d for d in dimension_metadata.dimensions if d.role is DimensionRole.CONSTRAINT]
        self.keys = [d for d in dimension_metadata.dimensions if d.role is DimensionRole.CONTEXT_KEY]
        if not self.constraints:
            raise ValueError("an accumulator needs a constraint dimension")
        self.compiler = AccumulatorCompiler()
        self._compatible = [self.compiler.compile_compatible(d) for d in self.constraints]
        self._merged = [c for d in self.constraints for c in (*self.compiler.compile_coalesce(d), self.compiler.compile_coalesce_na_flag(d))]
        self._exclusive, self._order = exclusive_field, rule_order_field
        self._engines: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()

    # build -------------------------------------------------------------------------------------

    @property
    def key_columns(self) -> list[str]:
        return [f"__key_{d.dimension_name}" for d in self.keys]

    def _anchors(self, rules: DataFrame) -> DataFrame:
        indexed = rules.withColumn("__rule_index", F.col(f"`{self._order}`")) if self._order else with_index(rules, "__rule_index")
        keyed = indexed.withColumns({k: F.col(f"`{d.resolved_rule_field}`").cast(SPARK_TYPE[d.data_type]) for k, d in zip(self.key_columns, self.keys, strict=True)}) if self.keys else indexed
        nth = (F.row_number().over(Window.partitionBy(*self.key_columns).orderBy("__rule_index")) - 1).alias("__nth")
        columns = [self.compiler.canonical(d, f).alias(co(f)) for d in self.constraints for f in self.compiler.fields(d)]
        flags = [self.compiler.anchor_na_flag(d) for d in self.constraints]
        folds = [F.col(f"`{a.column_name}`").alias(f"__agg_{a.column_name}") for a in self.aggregates]
        group = [F.col(f"`{self._exclusive}`").alias("__group")] if self._exclusive else []
        own = stored(keyed.select(*self.key_columns, nth, *columns, *flags, *folds, *group))
        most = own.agg(F.max("__nth")).first()[0]
        if most is not None:
            get_prime(most)
        table = own.sparkSession.createDataFrame(list(enumerate(_TABLE[: (most or 0) + 1])), "__nth int, __prime bigint")
        return stored(own.join(F.broadcast(table), "__nth").drop("__nth"))  # MAX_RULES rows at most

    def _expand(self, level: DataFrame, anchors: DataFrame) -> DataFrame:
        rhs = anchors.select(*[F.col(c).alias(c if c in self.key_columns else f"{c}_rhs") for c in anchors.columns if c not in ("__prime_product", "__level")])
        guard = (F.col("__prime") < F.col("__prime_rhs")) & (F.col("__prime_product") % F.col("__prime_rhs") != 0)
        for c in self._compatible:
            guard = guard & c
        if self._exclusive:
            guard = guard & ~F.exists("__groups", lambda g: g.eqNullSafe(F.col("__group_rhs")))
        for k in self.key_columns:
            guard = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) & guard
        paired = level.alias("l").join(rhs.alias("r"), guard)
        kept = [F.col(f"l.{k}").alias(k) for k in self.key_columns]
        folds = [_FOLD[a.operation](F.col(f"`__agg_{a.column_name}`"), F.col(f"`__agg_{a.column_name}_rhs`")).alias(f"__agg_{a.column_name}") for a in self.aggregates]
        group = [F.concat("__groups", F.array("__group_rhs")).alias("__groups")] if self._exclusive else []
        product = F.try_multiply(F.col("__prime_product"), F.col("__prime_rhs"))
        return paired.select(*kept, *self._merged, *folds, *group, F.col("__prime_rhs").alias("__prime"), product.alias("__prime_product"), (F.col("__level") + 1).alias("__level"))

    def _frontier(self, all_: DataFrame) -> DataFrame:
        """Without combinations that another one of the same conditions contains."""
        same = [*self.key_columns, *[c for c in all_.columns if c.startswith("co_")]]
        a, b = all_.alias("a"), all_.select(*same, "__prime_product").alias("b")
        on = (F.col("b.__prime_product") != F.col("a.__prime_product")) & (F.col("b.__prime_product") % F.col("a.__prime_product") == 0)
        for c in same:
            on = F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) & on
        return a.join(b, on, "left_anti")

    def build_frame(self, rules: DataFrame, max_levels: int = 64) -> DataFrame:
        """The combinations of all partitions, with the partitions' keys as `__key_<dimension>`."""
        anchors = self._anchors(rules)
        level = anchors.withColumn("__prime_product", F.col("__prime")).withColumn("__level", F.lit(0))
        if self._exclusive:
            level = level.withColumn("__groups", F.array("__group")).drop("__group")
        levels = [level]
        for _ in range(max_levels):
            level = stored(self._expand(level, anchors))
            if level.isEmpty():
                break
            if not level.where("__prime_product is null").isEmpty():
                raise LatticeWidthExceededError(f"combinations of {len(levels) + 1} rules do not fit 64 bits")
            levels.append(level)
        else:
            raise LatticeWidthExceededError(f"more than {max_levels} levels")
        whole = levels[0]
        for one in levels[1:]:
            whole = whole.unionByName(one)
        away = ["__prime", *(["__groups"] if self._exclusive else [])]
        return stored(self._frontier(stored(whole.drop(*away))))

    def build(self, rules: DataFrame, partition_key: dict[str, Any] | None = None):
        from .lattice import Lattice

        if partition_key:
            for name, value in partition_key.items():
                column = F.col(f"`{self.metadata.get_dimension(name).resolved_rule_field}`")
                rules = rules.where(column.eqNullSafe(F.lit(value)))
        frame = self.build_frame(rules)
        return Lattice(frame.drop(*self.key_columns), self.metadata, self.aggregates, partition_key)

    def build_all(self, rules: DataFrame) -> list:
        """One lattice for each key of the partitions, all built by one sequence of jobs."""
        from .lattice import Lattice

        if not self.keys:
            return [self.build(rules)]
        frame = self.build_frame(rules)
        found = frame.select(*self.key_columns).distinct().orderBy(*self.key_columns).collect()  # a row per partition
        out = []
        for row in found:
            part = frame
            for k in self.key_columns:
                part = part.where(F.col(k).eqNullSafe(F.lit(row[k])))
            key = {d.dimension_name: row[k] for d, k in zip(self.keys, self.key_columns, strict=True)}
            out.append(Lattice(part.drop(*self.key_columns), self.metadata, self.aggregates, key))
        return out

    # apply -------------------------------------------------------------------------------------

    def apply_metadata(self) -> DimensionsMetadata:
        """The constraints, reading the merged columns."""
        from dataclasses import replace

        out = []
        for d in self.constraints:
            if d.match_strategy is MatchStrategy.RANGE:
                out.append(replace(d, range_min_field=co(d.range_min_field), range_max_field=co(d.range_max_field)))
            else:
                out.append(replace(d, rule_field=co(d.resolved_rule_field), context_field=d.resolved_context_field))
        return DimensionsMetadata(out)

    def filter_engine(self, lattice) -> ExpressionRulesEngine:
        if lattice not in self._engines:
            order = "__prime_product" if lattice.is_composed else None
            self._engines[lattice] = ExpressionRulesEngine(lattice.combinations, self.apply_metadata(), rule_order_field=order)
        return self._engines[lattice]

    def apply(self, lattice, context: Any, dimensions: list[str] | None = None) -> AccumulatorResult:
        """All combinations that the context matches."""
        found = self.filter_engine(lattice).evaluate(context, dimensions)
        return AccumulatorResult(found.survivors, found.active_dimensions)

    def apply_auto(self, lattices: list, context: Any, dimensions: list[str] | None = None) -> AccumulatorResult:
        return self.index(lattices, validate=False).apply(context, dimensions)

    def index(self, lattices: list, validate: bool = True, max_witnesses: int = 1_000_000):
        from .lattice import LatticeIndex

        return LatticeIndex(self, lattices, validate, max_witnesses)
