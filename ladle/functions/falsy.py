"""Defaults in the two ways that source records use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_falsy(df: DataFrame, name: str) -> Column:
    """Null, empty string, 0, NaN or false."""
    c, kind = F.col(name), df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, T.BooleanType):
        return c.isNull() | ~c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c) | (c == 0)
    if isinstance(kind, T.NumericType):
        return c.isNull() | (c == 0)
    return c.isNull()


def or_default(df: DataFrame, name: str, default) -> Column:
    """The column, or the default where it is falsy."""
    return F.when(is_falsy(df, name), default if isinstance(default, Column) else F.lit(default)).otherwise(F.col(name))


def round_half_up(c: Column) -> Column:
    """Rounds .5 towards positive infinity, also below 0."""
    return F.floor(c + 0.5)
