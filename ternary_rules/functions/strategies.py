"""Strategies as Columns: 1 for a match, 0 for a wildcard or an unknown, -1 for a mismatch.

Every expression is total: a null never reaches `least`, which would skip it and let a rule pass.
A null in a rule's cell is a wildcard.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternary_rules.plans.model import SETS, Dimension, DimensionsMetadata, MatchStrategy

from .sentinels import SPARK_TYPE, is_sentinel, is_unknown, not_set, unknown


def ctx(name: str) -> str:
    return f"__ctx_{name}"


def ternary(test: Column) -> Column:
    return F.when(test, F.lit(1)).otherwise(F.lit(-1))


def conjunction(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.least(*columns)


class DimensionCompiler:
    """Turns dimensions into Columns over the rules' own columns and `__ctx_<dimension>`."""

    def compile_dimensions(self, metadata: DimensionsMetadata) -> dict[str, Column]:
        return {d.dimension_name: self.compile_dimension(d) for d in metadata.dimensions}

    def compile_dimension(self, dim: Dimension) -> Column:
        compiled: Callable[[Dimension], Column] | None = getattr(self, f"_{dim.match_strategy.value}", None)
        if compiled is None:
            raise ValueError(f"no compiler for {dim.match_strategy}")
        return compiled(dim)

    def _rule(self, dim: Dimension, name: str | None = None) -> Column:
        return F.col(f"`{name or dim.resolved_rule_field}`").cast(SPARK_TYPE[dim.data_type])

    def _ctx(self, dim: Dimension) -> Column:
        return F.col(f"`{ctx(dim.dimension_name)}`")

    def _compared(self, dim: Dimension, test: Callable[[Column, Column], Column], field: str | None = None) -> Column:
        r, c = self._rule(dim, field), self._ctx(dim)
        return F.when(is_sentinel(r, dim.data_type) | is_sentinel(c, dim.data_type), F.lit(0)).otherwise(ternary(test(r, c)))

    def _exact(self, dim: Dimension) -> Column:
        return self._compared(dim, lambda r, c: r == c)

    def _not_equal(self, dim: Dimension) -> Column:
        return self._compared(dim, lambda r, c: r != c)

    def _greater_than(self, dim: Dimension) -> Column:
        return self._compared(dim, lambda r, c: c > r)

    def _less_than(self, dim: Dimension) -> Column:
        return self._compared(dim, lambda r, c: c < r)

    def _range(self, dim: Dimension) -> Column:
        low = self._compared(dim, (lambda r, c: c >= r) if dim.range_min_inclusive else (lambda r, c: c > r), dim.range_min_field)
        high = self._compared(dim, (lambda r, c: c <= r) if dim.range_max_inclusive else (lambda r, c: c < r), dim.range_max_field)
        return F.least(low, high)

    def _exact_key(self, dim: Dimension) -> Column:
        r, c = self._rule(dim), self._ctx(dim)
        return F.when(is_unknown(r, dim.data_type), F.lit(0)).otherwise(ternary(F.coalesce(r == c, F.lit(False))))

    def _text(self, dim: Dimension, test: Callable[[Column, Column], Column]) -> Column:
        """Only the rule's cell can be a wildcard: a missing context is compared as its mark."""
        r, c = self._rule(dim), F.coalesce(self._ctx(dim), not_set(dim.data_type))
        return F.when(is_sentinel(r, dim.data_type), F.lit(0)).otherwise(ternary(test(c, r)))

    def _prefix(self, dim: Dimension) -> Column:
        return self._text(dim, F.startswith)

    def _suffix(self, dim: Dimension) -> Column:
        return self._text(dim, F.endswith)

    def _contains(self, dim: Dimension) -> Column:
        return self._text(dim, F.contains)

    def _regex(self, dim: Dimension) -> Column:
        return self._text(dim, F.regexp_like)

    def _context_regex(self, dim: Dimension) -> Column:
        return ternary(F.coalesce(self._ctx(dim), not_set(dim.data_type)).rlike(dim.regex_pattern))

    def _set(self, dim: Dimension, member: bool) -> Column:
        values = F.col(f"`{dim.resolved_rule_field}`").cast(f"array<{SPARK_TYPE[dim.data_type]}>")
        c = self._ctx(dim)
        has = lambda x: F.coalesce(F.array_contains(values, x), F.lit(False))
        wild = values.isNull() | has(unknown(dim.data_type)) | is_sentinel(c, dim.data_type)
        return F.when(wild, F.lit(0)).otherwise(ternary(has(c) if member else ~has(c)))

    def _set_membership(self, dim: Dimension) -> Column:
        return self._set(dim, True)

    def _set_exclusion(self, dim: Dimension) -> Column:
        return self._set(dim, False)


class PairCompiler:
    """The same strategies for pairs of a join, where each cell meets many contexts: what depends on
    one side only becomes a column of that side, computed once for each row before the join. A null
    there stands for a wildcard or a missing value, so a pair costs a test for null and a comparison.

    `patterns` holds the distinct patterns of a REGEX dimension. They are matched with the context
    as literals, compiled once in each task, and a rule's cell becomes its pattern's place among
    them; without them a pattern is compiled for every pair."""

    _CHEAP = (MatchStrategy.EXACT, MatchStrategy.EXACT_KEY, MatchStrategy.GREATER_THAN, MatchStrategy.LESS_THAN, MatchStrategy.RANGE, MatchStrategy.NOT_EQUAL)

    def __init__(self, dimensions: list[Dimension], patterns: dict[str, list[str]] | None = None):
        self.dimensions, self.patterns = dimensions, patterns or {}
        self._base = DimensionCompiler()

    @staticmethod
    def _names(dim: Dimension) -> list[str]:
        return [f"__{end}_{dim.dimension_name}" for end in (("low", "high") if dim.match_strategy is MatchStrategy.RANGE else ("cell",))]

    @staticmethod
    def _value(dim: Dimension) -> str:
        return f"__value_{dim.dimension_name}"

    def rule_columns(self) -> dict[str, Column]:
        out = {}
        for d in self.dimensions:
            if d.match_strategy is MatchStrategy.CONTEXT_REGEX:
                continue
            for name, field in zip(self._names(d), d.rule_fields, strict=True):
                if d.match_strategy in SETS:
                    cell = F.col(f"`{field}`").cast(f"array<{SPARK_TYPE[d.data_type]}>")
                    wild = F.coalesce(F.array_contains(cell, unknown(d.data_type)), F.lit(False))
                else:
                    cell = self._base._rule(d, field)
                    wild = (is_unknown if d.match_strategy is MatchStrategy.EXACT_KEY else is_sentinel)(cell, d.data_type)
                    if d.dimension_name in self.patterns:
                        known = F.array(*[F.lit(p) for p in self.patterns[d.dimension_name]]).cast("array<string>")
                        cell = F.array_position(known, cell).cast("int")
                out[name] = F.when(~wild, cell)
        return out

    def context_columns(self) -> dict[str, Column]:
        out = {}
        for d in self.dimensions:
            c, s = self._base._ctx(d), d.match_strategy
            if s in (MatchStrategy.PREFIX, MatchStrategy.SUFFIX, MatchStrategy.CONTAINS, MatchStrategy.REGEX):
                c = F.coalesce(c, not_set(d.data_type))
                if d.dimension_name in self.patterns:
                    c = F.array(*[c.cast("string").rlike(p) for p in self.patterns[d.dimension_name]]).cast("array<boolean>")
            elif s is MatchStrategy.CONTEXT_REGEX:
                c = self._base.compile_dimension(d)
            elif s is not MatchStrategy.EXACT_KEY:
                c = F.when(~is_sentinel(c, d.data_type), c)
            out[self._value(d)] = c
        return out

    def _parts(self, d: Dimension) -> list[tuple[Column, Column]]:
        """(is a wildcard, matches) of each comparison that the dimension makes; neither is ever null."""
        s, c = d.match_strategy, F.col(f"`{self._value(d)}`")
        if s is MatchStrategy.CONTEXT_REGEX:
            return [(F.lit(False), c == 1)]
        cells = [F.col(f"`{n}`") for n in self._names(d)]
        r = cells[0]
        if s is MatchStrategy.RANGE:
            low, high = cells
            return [
                (low.isNull() | c.isNull(), c >= low if d.range_min_inclusive else c > low),
                (high.isNull() | c.isNull(), c <= high if d.range_max_inclusive else c < high),
            ]
        if s is MatchStrategy.EXACT_KEY:
            return [(r.isNull(), F.coalesce(r == c, F.lit(False)))]
        if s in SETS:
            has = F.coalesce(F.array_contains(r, c), F.lit(False))
            return [(r.isNull() | c.isNull(), has if s is MatchStrategy.SET_MEMBERSHIP else ~has)]
        if s is MatchStrategy.REGEX:
            return [(r.isNull(), F.get(c, r - 1) if d.dimension_name in self.patterns else F.regexp_like(c, r))]
        text = {MatchStrategy.PREFIX: F.startswith, MatchStrategy.SUFFIX: F.endswith, MatchStrategy.CONTAINS: F.contains}
        if s in text:
            return [(r.isNull(), text[s](c, r))]
        plain = {MatchStrategy.EXACT: r == c, MatchStrategy.NOT_EQUAL: r != c, MatchStrategy.GREATER_THAN: c > r, MatchStrategy.LESS_THAN: c < r}
        return [(r.isNull() | c.isNull(), plain[s])]

    def values(self) -> dict[str, Column]:
        """1, 0 or -1 of each dimension."""
        return {d.dimension_name: conjunction([F.when(wild, F.lit(0)).otherwise(ternary(match)) for wild, match in self._parts(d)]) for d in self.dimensions}

    def survives(self) -> Column:
        """No dimension mismatches; the first that does ends the test, so cheap ones come first."""
        order = sorted(self.dimensions, key=lambda d: (d.match_strategy not in self._CHEAP, d.match_strategy is MatchStrategy.REGEX))
        tests = [wild | match for d in order for wild, match in self._parts(d)]
        return reduce(and_, tests)
