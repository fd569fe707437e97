"""Logical field types of Spark columns."""

from __future__ import annotations

from pyspark.sql import types as T

from quarrylens.model import FieldType

CATEGORY_MAX = 100
CATEGORY_SHARE = 0.05


def field_type(dtype: T.DataType) -> FieldType:
    if isinstance(dtype, T.IntegralType):
        return FieldType.INTEGER
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return FieldType.FLOAT
    if isinstance(dtype, T.NumericType):
        return FieldType.NUMERIC
    if isinstance(dtype, T.BooleanType):
        return FieldType.BOOLEAN
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return FieldType.TEXT
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType)) or dtype.typeName().startswith("time("):
        return FieldType.DATETIME
    return FieldType.UNKNOWN


def is_category(n_unique: int, rows: int) -> bool:
    """A text column with few values for its rows; null counts as a value."""
    return n_unique < CATEGORY_MAX and n_unique < CATEGORY_SHARE * rows


def columns_of(schema: T.StructType, *kinds: FieldType) -> list[str]:
    return [f.name for f in schema.fields if field_type(f.dataType) in kinds]
