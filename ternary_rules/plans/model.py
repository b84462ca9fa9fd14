"""What a rules table means: dimensions, their strategies and types, and how survivors are selected."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, field, fields, replace
from datetime import date, datetime
from enum import StrEnum
from pathlib import Path
from typing import Any


class MatchStrategy(StrEnum):
    EXACT = "exact"
    EXACT_KEY = "exact_key"
    NOT_EQUAL = "not_equal"
    RANGE = "range"
    GREATER_THAN = "greater_than"
    LESS_THAN = "less_than"
    PREFIX = "prefix"
    SUFFIX = "suffix"
    CONTAINS = "contains"
    REGEX = "regex"
    CONTEXT_REGEX = "context_regex"
    SET_MEMBERSHIP = "set_membership"
    SET_EXCLUSION = "set_exclusion"


class DataType(StrEnum):
    STR = "str"
    INT = "int"
    FLOAT = "float"
    BOOL = "bool"
    DATE = "date"
    DATETIME = "datetime"

    @property
    def python_type(self) -> type:
        return {"str": str, "int": int, "float": float, "bool": bool, "date": date, "datetime": datetime}[self.value]


class DimensionRole(StrEnum):
    CONSTRAINT = "constraint"
    CONTEXT_KEY = "context_key"


class HitPolicy(StrEnum):
    COLLECT = "collect"
    UNIQUE = "unique"
    FIRST = "first"
    PRIORITY = "priority"
    ANY = "any"
    RULE_ORDER = "rule_order"


class AggregateOp(StrEnum):
    SUM = "sum"
    MIN = "min"
    MAX = "max"
    PRODUCT = "product"


@dataclass(frozen=True)
class Aggregate:
    column_name: str
    operation: AggregateOp = AggregateOp.SUM

    def __post_init__(self) -> None:
        object.__setattr__(self, "operation", AggregateOp(self.operation))


_ORDERED = {DataType.INT, DataType.FLOAT, DataType.DATE, DataType.DATETIME}
_TEXT = {MatchStrategy.PREFIX, MatchStrategy.SUFFIX, MatchStrategy.CONTAINS, MatchStrategy.REGEX, MatchStrategy.CONTEXT_REGEX}
SETS = {MatchStrategy.SET_MEMBERSHIP, MatchStrategy.SET_EXCLUSION}


@dataclass(frozen=True)
class Dimension:
    """One condition of the rules: the column that holds it, the context value it is held against,
    and how the two are compared."""

    dimension_name: str
    context_field: str | None = None
    rule_field: str | None = None
    match_strategy: MatchStrategy = MatchStrategy.EXACT
    data_type: DataType = DataType.STR
    valid_values: list = field(default_factory=list)
    range_min_field: str | None = None
    range_max_field: str | None = None
    range_min_inclusive: bool = True
    range_max_inclusive: bool = True
    regex_pattern: str | None = None
    role: DimensionRole = DimensionRole.CONSTRAINT
    #: Reads REGEX with a regex_pattern as one pattern for all rules, the older meaning of REGEX.
    legacy_regex: bool = False

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        if isinstance(self.data_type, type):
            warnings.warn("name data types by DataType", DeprecationWarning, stacklevel=3)
            put("data_type", next(t for t in DataType if t.python_type is self.data_type))
        put("data_type", DataType(self.data_type))
        put("match_strategy", MatchStrategy(self.match_strategy))
        put("role", DimensionRole(self.role))
        if self.legacy_regex and self.match_strategy is MatchStrategy.REGEX and self.regex_pattern:
            put("match_strategy", MatchStrategy.CONTEXT_REGEX)
        self._validate()

    def _validate(self) -> None:
        strategy, kind = self.match_strategy, self.data_type
        fail = lambda text: ValueError(f"dimension '{self.dimension_name}': {strategy.name} {text}")
        if not self.dimension_name:
            raise ValueError("a dimension needs a name")
        if strategy is MatchStrategy.RANGE and not (self.range_min_field and self.range_max_field):
            raise fail("needs range_min_field and range_max_field")
        if strategy in (MatchStrategy.RANGE, MatchStrategy.GREATER_THAN, MatchStrategy.LESS_THAN) and kind not in _ORDERED:
            raise fail(f"orders values, which {kind} does not allow")
        if strategy in _TEXT and kind is not DataType.STR:
            raise fail(f"compares text, not {kind}")
        if strategy in SETS and kind is DataType.BOOL:
            raise fail("has no wildcard for bool")
        if strategy is MatchStrategy.CONTEXT_REGEX:
            if not self.regex_pattern:
                raise fail("needs regex_pattern")
            try:
                re.compile(self.regex_pattern)
            except re.error as e:
                raise fail(f"cannot read the pattern: {e}") from e
        elif self.regex_pattern is not None:
            raise fail("takes no regex_pattern; only CONTEXT_REGEX does")

    @property
    def resolved_context_field(self) -> str:
        return self.context_field or self.dimension_name

    @property
    def resolved_rule_field(self) -> str:
        return self.rule_field or self.dimension_name

    @property
    def rule_fields(self) -> tuple[str, ...]:
        """The columns of the rules table that this dimension reads."""
        if self.match_strategy is MatchStrategy.RANGE:
            return (self.range_min_field, self.range_max_field)
        return () if self.match_strategy is MatchStrategy.CONTEXT_REGEX else (self.resolved_rule_field,)

    def to_dict(self) -> dict[str, Any]:
        """Without defaults."""
        plain = Dimension(dimension_name="x") if self.dimension_name != "x" else Dimension(dimension_name="y")
        out = {}
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "legacy_regex" or f.name != "dimension_name" and value == getattr(plain, f.name):
                continue
            out[f.name] = value.value if isinstance(value, StrEnum) else value
        return out


@dataclass(frozen=True)
class DimensionsMetadata:
    dimensions: list[Dimension]
    hit_policy: HitPolicy = HitPolicy.COLLECT
    priority_field: str | None = None
    output_fields: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        object.__setattr__(self, "hit_policy", HitPolicy(self.hit_policy))
        names = [d.dimension_name for d in self.dimensions]
        if twice := sorted({n for n in names if names.count(n) > 1}):
            raise ValueError(f"dimension names repeat: {', '.join(twice)}")
        if self.hit_policy is HitPolicy.PRIORITY and not self.priority_field:
            raise ValueError("hit_policy PRIORITY needs priority_field")

    @property
    def names(self) -> list[str]:
        return [d.dimension_name for d in self.dimensions]

    def get_dimension(self, name: str) -> Dimension:
        for d in self.dimensions:
            if d.dimension_name == name:
                return d
        raise KeyError(name)

    def with_dimensions(self, dimensions: Iterable[Dimension]) -> DimensionsMetadata:
        return replace(self, dimensions=list(dimensions))

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"dimensions": [d.to_dict() for d in self.dimensions]}
        if self.hit_policy is not HitPolicy.COLLECT:
            out["hit_policy"] = self.hit_policy.value
        if self.priority_field:
            out["priority_field"] = self.priority_field
        if self.output_fields:
            out["output_fields"] = list(self.output_fields)
        return out

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> DimensionsMetadata:
        return cls(**{**raw, "dimensions": [Dimension(**d) for d in raw["dimensions"]]})

    def to_yaml(self) -> str:
        return dump_yaml(self.to_dict())

    @classmethod
    def from_yaml(cls, text: str) -> DimensionsMetadata:
        return cls.from_dict(load_yaml(text))

    def to_yaml_file(self, path: str | Path) -> None:
        Path(path).write_text(self.to_yaml(), encoding="utf-8")

    @classmethod
    def from_yaml_file(cls, path: str | Path) -> DimensionsMetadata:
        return cls.from_yaml(Path(path).read_text(encoding="utf-8"))


def dump_yaml(value: Any) -> str:
    """YAML; where the library is missing, its subset JSON."""
    try:
        import yaml
    except ImportError:
        import json

        return json.dumps(value, indent=2, ensure_ascii=False, default=str)
    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


def load_yaml(text: str) -> Any:
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)
