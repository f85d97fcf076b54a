"""Reads of collections: find, paging, counts, the five-stage pipeline, projections and lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.falsy import is_falsy, or_default
from ladle.operators.predicate import compile_filter

STAGES = ("$match", "$sort", "$limit", "$skip", "$group")


def with_positions(df: DataFrame, *order: str) -> DataFrame:
    """_pos by a unique order of columns. Sorts all rows; only for tables that come without positions."""
    return df.withColumn("_pos", F.row_number().over(Window.orderBy(*order)) - 1)


def find(df: DataFrame, query: Mapping | None = None) -> DataFrame:
    return df.filter(compile_filter(df, query))


def find_one(df: DataFrame, query: Mapping | None = None, order: str = "_pos") -> DataFrame:
    return find(df, query).orderBy(order).limit(1)


def find_by_id(df: DataFrame, value, order: str = "_pos") -> DataFrame:
    return find_one(df, {"id": value}, order)


def find_all(df: DataFrame, limit: int = 50, order: str = "_pos") -> DataFrame:
    """The first rows in insertion order."""
    return df.orderBy(order).limit(limit)


def count_documents(df: DataFrame, query: Mapping | None = None) -> DataFrame:
    return find(df, query).agg(F.count("*").alias("n"))


def totals(df: DataFrame, *keys: str) -> DataFrame:
    """keys and total: the number of rows of each key."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"))


def page(df: DataFrame, query: Mapping | None, sort: str, limit: int = 50, offset: int = 0, tie: str = "_pos") -> DataFrame:
    """Latest first; limit is held to 1..200 and offset to 0 or more."""
    return find(df, query).orderBy(F.desc(sort), F.asc(tie)).offset(max(0, offset)).limit(min(200, max(1, limit)))


def group_stage(df: DataFrame, field: str | None, items: bool = True, order: str = "_pos") -> DataFrame:
    """_id, count and the rows of each group in order; falsy keys are "unknown", no field is one group "_all".

    items=False leaves the rows out: a group may hold any share of all rows.
    """
    key = F.lit("_all") if field is None else F.when(is_falsy(df, field), "unknown").otherwise(F.col(field).cast("string"))
    counted = [F.count("*").alias("count")]
    if items:
        first = [F.col(order)] if order in df.columns else []
        counted.append(F.sort_array(F.collect_list(F.struct(*first, *(c for c in df.columns if c != order)))).alias("items"))
    return df.withColumn("_id", key).groupBy("_id").agg(*counted) if items is False else df.withColumn("__key", key).groupBy(F.col("__key").alias("_id")).agg(*counted)


def aggregate(df: DataFrame, pipeline: Sequence[Mapping], items: bool = True, order: str = "_pos") -> DataFrame:
    """Stages of one operator each: $match, $sort (1 or -1 by field, ties in insertion order), $limit and $skip (0: none), $group."""
    for stage in pipeline:
        op = next((s for s in STAGES if s in stage), None)
        if op is None:
            raise ValueError(f"unknown stage {stage}")
        value = stage[op]
        if op == "$match":
            df = find(df, value)
        elif op == "$sort":
            keys = [or_default(df, f, F.lit(0).cast(df.schema[f].dataType)) if df.schema[f].dataType.typeName() in ("integer", "long", "double", "float") else F.col(f) for f in value]
            df = df.orderBy(*(k.asc_nulls_first() if d > 0 else k.desc_nulls_last() for k, d in zip(keys, value.values(), strict=True)), *([F.col(order)] if order in df.columns else []))
        elif op == "$limit":
            df = df.limit(value) if value else df
        elif op == "$skip":
            df = df.offset(value) if value else df
        else:
            df = group_stage(df, value["_id"], items, order)
    return df


def scan_summary(df: DataFrame) -> DataFrame:
    """Public columns of scans with their defaults."""
    return df.select(
        F.coalesce("_id", "id").alias("id") if "id" in df.columns else F.col("_id").alias("id"),
        F.when(is_falsy(df, "items_count"), F.coalesce(F.nullif(F.size("dishes"), F.lit(-1)), F.lit(0))).otherwise(F.col("items_count")).alias("items_count"),
        or_default(df, "status", "completed").alias("status"),
        or_default(df, "user_id", "anonymous").alias("user_id"),
        "created_at",
    )


def with_id(df: DataFrame, prefer: str = "_id") -> DataFrame:
    """id from _id and id; scans and dishes prefer _id, jobs prefer id."""
    if "id" not in df.columns:
        return df.withColumn("id", F.col("_id"))
    other = "id" if prefer == "_id" else "_id"
    return df.withColumn("id", F.coalesce(prefer, other))


def rename_id(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("id", "_id")


def build_items(scans: DataFrame, at_ms: Column | None = None) -> DataFrame:
    """A row for each dish of each scan, with an id of scan, place and time, and defaults."""
    d = scans.select(F.col("_id").alias("scan_id"), F.posexplode("dishes").alias("ix", "d"), (at_ms if at_ms is not None else F.unix_millis("created_at")).alias("ms"))
    return d.select(
        F.concat_ws("-", "scan_id", "ix", "ms").alias("_id"),
        "scan_id",
        F.col("d.name").alias("name"),
        F.coalesce("d.description", F.lit("")).alias("description"),
        F.col("d.price").alias("price"),
        F.coalesce("d.category", F.lit("other")).alias("category"),
        F.coalesce("d.confidence", F.lit(0.8)).alias("confidence"),
    )


def menu_text(dishes: DataFrame, scan: str = "scan_id", order: str = "_pos") -> DataFrame:
    """names (comma-separated) and text (one line a dish) of each scan."""
    price = F.when(F.col("price").isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", "price"))
    line = F.concat(F.col("name"), F.lit(" - $"), price, F.lit(": "), F.coalesce("description", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("name").alias("n"), line.alias("l"))))
    g = dishes.groupBy(scan).agg(rows.alias("rows"))
    return g.select(scan, F.array_join(F.transform("rows", lambda r: r["n"]), ", ").alias("names"), F.array_join(F.transform("rows", lambda r: r["l"]), "\n").alias("text"))


def compare_sides(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Full outer join by key: the last value of each key and side, 0 where it is missing."""

    def last(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("key")).agg(F.max_by(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), order).alias(name), F.lit(True).alias(f"in_{name}"))

    joined = last(left, "left_value").join(last(right, "right_value"), "key", "full")
    return joined.select("key", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("left_value", "right_value")), *(F.coalesce(f"in_{c}", F.lit(False)).alias(f"in_{c}") for c in ("left_value", "right_value")))


def ordered_by_name(df: DataFrame, name: str = "key") -> DataFrame:
    """Sorted as people sort names (case and accents after letters)."""
    return df.orderBy(F.collate(F.col(name), "UNICODE"), name)


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Parents with their children; a parent without any stays."""
    return parents.join(children, parents[parent_key] == children[child_key], "left")


def existing(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other, df[left] == other[right], "left_semi")


def missing(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other, df[left] == other[right], "left_anti")


def daily_counts(df: DataFrame, ts: str, days: int = 7, until: Column | None = None, most: int | None = None, order: str = "_pos") -> DataFrame:
    """day, n for the last days up to `until` (default: the latest row's day), zero-filled; with most, of the first rows in insertion order only."""
    df = find_all(df, most, order) if most is not None else df
    per = df.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    anchor = per.agg(F.max("day").alias("d")) if until is None else df.sparkSession.range(1).select(F.to_date(until).alias("d"))
    calendar = anchor.select(F.explode(F.sequence(F.date_sub("d", days - 1), F.col("d"), F.expr("interval 1 day"))).alias("day"))
    return calendar.join(per, "day", "left").select("day", F.coalesce("n", F.lit(0)).cast("long").alias("n")).orderBy("day")


def status_counts(df: DataFrame, status: str, values: Sequence[str], at: str) -> DataFrame:
    """total, a count of each status, and the latest value of `at`."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == v).alias(v) for v in values), F.max(at).alias("last_at"))


def first_per_key(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each key in the given order; where that is of plain columns, one row a key and task is shuffled."""
    if all(isinstance(o, str) for o in order):
        rest = [c for c in df.columns if c not in keys]
        first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
        return first.select(*(F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns)) if rest else first.select(*keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def recent_scans(df: DataFrame, most: int = 10, order: str = "_pos") -> DataFrame:
    """Summaries of the first `most` rows in insertion order (not the latest ones), latest first."""
    return scan_summary(find_all(df, most, order)).orderBy(F.desc("created_at"))


def health(results: DataFrame, ok: str = "ok") -> DataFrame:
    """healthy (any ok), all_healthy, checked: one row, also of no results."""
    return results.agg(F.coalesce(F.bool_or(ok), F.lit(False)).alias("healthy"), F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_healthy"), F.count("*").alias("checked"))


def last_per_key(df: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def fill_forward(df: DataFrame, keys: Sequence[str], value: Column, order: str, most: int | None = None) -> Column:
    """The last non-null value up to a row; with `most`, only where it is at most that many rows back."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = F.last(value, ignorenulls=True).over(w)
    if most is None:
        return filled
    at = F.last(F.when(value.isNotNull(), F.col(order)), ignorenulls=True).over(w)
    return F.when(F.col(order) - at <= most, filled)


def neighbours(keys: Sequence[str], value: Column, *order: str, before: int = 1, after: int = 1) -> dict[str, Column]:
    """before and after: a value of the row that stands so many places before and after each row of its keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return {"before": F.lag(value, before).over(w), "after": F.lead(value, after).over(w)}


def sessionise(keys: Sequence[str], order: Column, gap: Column, *ties: str) -> Column:
    """Number of the session of each row: a new one starts where order rises by more than gap."""
    w = Window.partitionBy(*keys).orderBy(order, *ties)
    starts = F.when(order - F.lag(order).over(w) > gap, 1).otherwise(0)
    return F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0))
