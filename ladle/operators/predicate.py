"""Filter documents, compiled to Column expressions that Catalyst can push down.

{"f": scalar} equality; operators $gt $gte $lt $lte $ne $in $nin $regex (with $options) $exists; keys and operators are
ANDed, without wrappers that would keep them from the scan: a row that a predicate leaves unknown does not match. A row
without the field (null) meets $ne and $nin only; {"f": None} meets nulls; a list as value meets nothing;
{"id": v} also looks at _id where there is no id. Unknown operators raise.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_RANGES = {"$gt": Column.__gt__, "$gte": Column.__ge__, "$lt": Column.__lt__, "$lte": Column.__le__}


def _operator(c: Column, op: str, value, options: str) -> Column:
    if op in _RANGES:
        return _RANGES[op](c, value)
    if op == "$ne":
        return ~c.eqNullSafe(F.lit(value))
    if op in ("$in", "$nin"):
        known = [v for v in value if v is not None]
        test = c.isin(*known) if known else F.lit(False)
        has_null = len(known) < len(value)
        if op == "$in":
            return test | c.isNull() if has_null else test
        return ~test & c.isNotNull() if has_null else ~test | c.isNull()
    if op == "$regex":
        flags = "".join(f for f in "ims" if f in options)
        return F.coalesce(c.cast("string"), F.lit("")).rlike((f"(?{flags})" if flags else "") + value)
    if op == "$exists":
        return c.isNotNull() if value else c.isNull()
    raise ValueError(f"unknown operator {op}")


def _field(c: Column, condition) -> Column:
    if isinstance(condition, Mapping):
        options = condition.get("$options", "")
        tests = [_operator(c, op, v, options) for op, v in condition.items() if op != "$options"]
        if not tests:
            raise ValueError("a condition without operators")
        return reduce(Column.__and__, tests)
    if isinstance(condition, (list, tuple)):
        return F.lit(False)
    return c.isNull() if condition is None else c == F.lit(condition)


def compile_filter(df: DataFrame, query: Mapping | None) -> Column:
    """The predicate of a filter document on df's columns; unknown columns count as null."""
    tests = []
    for key, condition in (query or {}).items():
        if key == "id" and "_id" in df.columns:
            c = F.coalesce(F.col("id"), F.col("_id")) if "id" in df.columns else F.col("_id")
        else:
            c = F.col(f"`{key}`") if key in df.columns else F.lit(None)
        tests.append(_field(c, condition))
    return reduce(Column.__and__, tests, F.lit(True)) if tests else F.lit(True)
