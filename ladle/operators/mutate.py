"""Mutations as functions from table to table; io.write_collection makes a result durable."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.operators.predicate import compile_filter


def _now(at: Column | None) -> Column:
    return F.current_timestamp() if at is None else at


def _set(df: DataFrame, hit: Column, values: Mapping, at: Column | None) -> DataFrame:
    changed = {k: F.when(hit, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(k) if k in df.columns else F.lit(None)) for k, v in values.items()}
    if "updated_at" in df.columns:
        changed["updated_at"] = F.when(hit, _now(at)).otherwise(F.col("updated_at"))
    return df.withColumns(changed)


def insert_many(df: DataFrame, rows: DataFrame, at: Column | None = None) -> DataFrame:
    """Append rows: an _id and created_at where they have none, updated_at now."""
    has = set(rows.columns)
    rows = rows.withColumn("_id", F.coalesce("_id", F.uuid()) if "_id" in has else F.uuid())
    rows = rows.withColumn("created_at", F.coalesce("created_at", _now(at)) if "created_at" in has else _now(at)).withColumn("updated_at", _now(at))
    return df.unionByName(rows, allowMissingColumns=True)


def first_match(df: DataFrame, query: Mapping, order: str) -> DataFrame:
    """The place of the first match, at most one row."""
    return df.filter(compile_filter(df, query)).agg(F.min(order).alias("_hit"))


def update_one(df: DataFrame, query: Mapping, values: Mapping, order: str = "_pos", at: Column | None = None) -> DataFrame:
    """Set values in the first match."""
    marked = df.crossJoin(F.broadcast(first_match(df, query, order)))  # one row
    return _set(marked, F.coalesce(F.col(order) == F.col("_hit"), F.lit(False)), values, at).drop("_hit")


def update_many(df: DataFrame, query: Mapping, values: Mapping, at: Column | None = None) -> DataFrame:
    return _set(df, compile_filter(df, query), values, at)


def bulk_update(df: DataFrame, updates: DataFrame, key: str, columns: Sequence[str], order: str = "_seq", at: Column | None = None) -> DataFrame:
    """Set columns from updates by key; of several updates of a key the last counts. A null in updates sets null."""
    last = updates.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*columns), order).alias("_u"))
    joined = df.join(last, F.col(key) == F.col("_k"), "left")
    out = joined.withColumns({c: F.when(F.col("_k").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in columns})
    if "updated_at" in df.columns:
        out = out.withColumn("updated_at", F.when(F.col("_k").isNotNull(), _now(at)).otherwise(F.col("updated_at")))
    return out.select(*df.columns)


def bulk_update_ordered(df: DataFrame, updates: Sequence[tuple[Mapping, Mapping]], order: str = "_pos", at: Column | None = None) -> DataFrame:
    """Updates of any filters, one after another, each on its first match; for few updates."""
    for query, values in updates:
        df = update_one(df, query, values, order, at)
    return df


def delete_one(df: DataFrame, query: Mapping, order: str = "_pos") -> DataFrame:
    marked = df.crossJoin(F.broadcast(first_match(df, query, order)))  # one row
    return marked.filter(~F.coalesce(F.col(order) == F.col("_hit"), F.lit(False))).drop("_hit")


def delete_many(df: DataFrame, query: Mapping, allow_all: bool = False) -> DataFrame:
    """Drop all matches; an empty query must be allowed."""
    if not query and not allow_all:
        raise ValueError("an empty query deletes everything; pass allow_all=True")
    return df.filter(~F.coalesce(compile_filter(df, query), F.lit(False)))


def upsert(df: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of a known key replace its columns, others are inserted: a full outer join. Of several new rows of a key the last
    by `order` counts (without order the largest, so that reruns agree)."""
    new = rows.groupBy(F.col(key).alias("_k")).agg((F.max(F.struct(*columns)) if order is None else F.max_by(F.struct(*columns), order)).alias("_u"))
    joined = df.join(new, F.col(key) == F.col("_k"), "full")
    values = {c: F.when(F.col("_k").isNotNull(), F.col(f"_u.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(values | {key: F.coalesce(F.col(key), F.col("_k"))}).select(*df.columns)


def find_one_and_update(df: DataFrame, query: Mapping, values: Mapping, on_insert: Mapping | None = None, upsert: bool = False, order: str = "_pos", at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after `values` are set in the first match, and that row as it is then (no row where nothing matches).

    With upsert, where nothing matches, a row of the query's plain fields, `values` and `on_insert` is inserted.
    """
    hit = first_match(df, query, order)
    updated = update_one(df, query, values, order, at)
    found = updated.crossJoin(F.broadcast(hit)).filter(F.col(order) == F.col("_hit")).drop("_hit")  # one row
    if not upsert:
        return updated, found
    fields = {k: v for k, v in query.items() if not isinstance(v, Mapping)} | dict(values) | dict(on_insert or {})
    place = df.agg(F.coalesce(F.max(order) + 1, F.lit(0)).alias("_place"))
    given = {"_id": F.lit(uuid.uuid4().hex), "created_at": _now(at), "updated_at": _now(at), order: F.col("_place")} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in fields.items()}
    new = hit.filter("_hit IS NULL").crossJoin(F.broadcast(place)).select(*(given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema))
    return updated.unionByName(new), found.unionByName(new)


def save_scan(scans: DataFrame, scan: DataFrame, at: Column | None = None) -> DataFrame:
    """Insert completed scans with the number of their dishes."""
    return insert_many(scans, scan.withColumn("items_count", F.coalesce(F.nullif(F.size("dishes"), F.lit(-1)), F.lit(0))).withColumn("status", F.lit("completed")), at)


def unset(df: DataFrame, query: Mapping, *columns: str) -> DataFrame:
    """Make fields of the matches null."""
    return update_many(df, query, {c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def assert_unique(df: DataFrame, column: str) -> DataFrame:
    """Raises where a value stands twice; returns df."""
    twice = df.filter(F.col(column).isNotNull()).groupBy(column).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{column} is not unique: {twice[0][0]}")
    return df


def counters(before: DataFrame, after: DataFrame, query: Mapping) -> DataFrame:
    """matched and deleted rows of a mutation."""
    return before.agg(F.count_if(compile_filter(before, query)).alias("matched"), F.count("*").alias("_n")).crossJoin(F.broadcast(after.agg(F.count("*").alias("_m")))).select("matched", (F.col("_n") - F.col("_m")).alias("deleted"))
