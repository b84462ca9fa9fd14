"""In-band wildcards and missing values, one pair per data type.

Literals of year 1 go through SQL: the Python route moves them by the calendars' difference.
"""

from __future__ import annotations

from datetime import date, datetime
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ternary_rules.plans.model import DataType

UNKNOWN, NOT_SET = "<NA>", "<NOT_SET>"
UNKNOWN_NUMERIC, NOT_SET_NUMERIC = -999999999, -999999998
UNKNOWN_DATE, NOT_SET_DATE = date(1, 1, 1), date(1, 1, 2)
UNKNOWN_DATETIME, NOT_SET_DATETIME = datetime(1, 1, 1), datetime(1, 1, 2)

SPARK_TYPE = {DataType.STR: "string", DataType.INT: "bigint", DataType.FLOAT: "double", DataType.BOOL: "boolean", DataType.DATE: "date", DataType.DATETIME: "timestamp_ntz"}
_VALUES: dict[DataType, tuple[Any, Any]] = {
    DataType.STR: (UNKNOWN, NOT_SET),
    DataType.INT: (UNKNOWN_NUMERIC, NOT_SET_NUMERIC),
    DataType.FLOAT: (float(UNKNOWN_NUMERIC), float(NOT_SET_NUMERIC)),
    DataType.BOOL: (None, None),
    DataType.DATE: (UNKNOWN_DATE, NOT_SET_DATE),
    DataType.DATETIME: (UNKNOWN_DATETIME, NOT_SET_DATETIME),
}


def unknown_sentinel_for(data_type: DataType) -> Any:
    return _VALUES[DataType(data_type)][0]


def not_set_sentinel_for(data_type: DataType) -> Any:
    return _VALUES[DataType(data_type)][1]


def sentinels_for(data_type: DataType) -> set:
    return {v for v in _VALUES[DataType(data_type)] if v is not None}


def literal(value: Any, data_type: DataType) -> Column:
    """A typed literal; safe for year 1."""
    data_type = DataType(data_type)
    if value is None:
        return F.lit(None).cast(SPARK_TYPE[data_type])
    if data_type is DataType.DATE:
        day = value.date() if isinstance(value, datetime) else value
        return F.expr(f"DATE'{day.isoformat()}'")
    if data_type is DataType.DATETIME:
        at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        return F.expr(f"TIMESTAMP_NTZ'{at.replace(tzinfo=None).isoformat(sep=' ')}'")
    return F.lit(value).cast(SPARK_TYPE[data_type])


def unknown(data_type: DataType) -> Column:
    return literal(unknown_sentinel_for(data_type), data_type)


def not_set(data_type: DataType) -> Column:
    return literal(not_set_sentinel_for(data_type), data_type)


def is_unknown(column: Column, data_type: DataType) -> Column:
    """Null or the wildcard."""
    return column.isNull() if data_type is DataType.BOOL else column.isNull() | (column == unknown(data_type))


def is_sentinel(column: Column, data_type: DataType) -> Column:
    """Null, the wildcard or the mark of a missing value."""
    return column.isNull() if data_type is DataType.BOOL else column.isNull() | (column == unknown(data_type)) | (column == not_set(data_type))


def filled(column: Column, data_type: DataType) -> Column:
    """A context value with null (and NaN) turned into the mark of a missing value."""
    column = column.cast(SPARK_TYPE[data_type])
    if data_type is DataType.BOOL:
        return column
    if data_type is DataType.FLOAT:
        column = F.when(~F.isnan(column), column)
    return F.coalesce(column, not_set(data_type))
