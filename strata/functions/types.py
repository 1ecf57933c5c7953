"""Type rules: how schema types map onto the numeric / categorical split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def is_numeric(dt: T.DataType) -> bool:
    """Numeric for statistics: numbers and booleans (booleans are cast to int)."""
    return isinstance(dt, (T.NumericType, T.BooleanType))


def is_real_numeric(dt: T.DataType) -> bool:
    """Numeric excluding booleans: these are imputed and scaled."""
    return isinstance(dt, T.NumericType)


def is_float(dt: T.DataType) -> bool:
    """Float-like types, which the ID-column test skips."""
    if isinstance(dt, T.DecimalType):
        return dt.scale > 0
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def numeric_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """Columns selected by a ``number`` dtype filter (B2): booleans excluded."""
    return [f.name for f in df.schema.fields
            if is_real_numeric(f.dataType) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: list[str] | tuple = ()) -> list[str]:
    """Everything that is not a real number (B3): strings, booleans, dates."""
    return [f.name for f in df.schema.fields
            if not is_real_numeric(f.dataType) and f.name not in exclude]


def type_name(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
