"""Column expressions with the semantics every analyzer shares; safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK = r"(?U)^\s*$"


def ref(name: str) -> Column:
    """A top-level column, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Share in percent; 0 for nothing of nothing."""
    return F.round(F.coalesce(F.try_divide(part.cast("double") * 100, whole.cast("double")), F.lit(0.0)), digits)


def text_of(column: Column, dtype: T.DataType) -> Column:
    """One text per distinct value; null stays null."""
    if isinstance(dtype, T.BinaryType):
        return F.hex(column)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)) or dtype.typeName() == "variant":
        return F.to_json(column)
    return column.cast("string")


def comparable(column: Column, dtype: T.DataType) -> Column:
    """Something that can be grouped; types that cannot become JSON."""
    if dtype.typeName() == "variant":
        return F.to_json(column)
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column


def no_nan(column: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(column), column) if isinstance(dtype, (T.FloatType, T.DoubleType)) else column


def pearson(a: Column, b: Column) -> Column:
    """Null where one side is constant or there are no rows, never an error."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def words(column: Column) -> Column:
    """Parts between single spaces: "a  b " has four."""
    return F.size(F.split(column, " ", -1))


def blank(column: Column) -> Column:
    return column.rlike(BLANK)
