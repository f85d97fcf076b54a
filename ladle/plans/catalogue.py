"""The registered queries: each applies one operator to whole supplied tables, with DuckDB SQL of the same rows where SQL
can express it. Orders stand for scans, line items and parts for dishes, events for jobs and requests, documents for texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators import collection as c
from ladle.operators import food, jobs, lines, mutate, parsing, quality
from ladle.schemas import TOLD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _find(name: str, source: str, filter_doc: dict, columns: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return c.find(table(spark, sf_dir, source), filter_doc).select(*columns.split(", "))

    QUERIES[name], SQL[name] = run, f"SELECT {columns} FROM {source} WHERE {where}"


ORDER = "o_orderkey, o_custkey, o_orderstatus, o_totalprice"
_find("find_eq", "orders", {"o_orderstatus": "F"}, ORDER, "o_orderstatus = 'F'")
_find("find_range", "orders", {"o_totalprice": {"$gte": 1000, "$lt": 50000}}, ORDER, "o_totalprice >= 1000 AND o_totalprice < 50000")
_find("find_ne", "orders", {"o_orderstatus": {"$ne": "F"}}, ORDER, "o_orderstatus IS DISTINCT FROM 'F'")
_find("find_in", "orders", {"o_orderstatus": {"$in": ["F", "P"]}}, ORDER, "o_orderstatus IN ('F', 'P')")
_find("find_nin", "orders", {"o_orderstatus": {"$nin": ["F", "P"]}}, ORDER, "coalesce(o_orderstatus NOT IN ('F', 'P'), true)")
_find("find_regex_i", "part", {"p_name": {"$regex": "^[a-m].*E", "$options": "i"}}, "p_partkey, p_name", "regexp_matches(coalesce(p_name, ''), '(?i)^[a-m].*E')")
_find("find_multi_op", "part", {"p_size": {"$gt": 5, "$lte": 30, "$ne": 20}, "p_brand": {"$in": ["Brand#1", "Brand#2", "Brand#11"]}}, "p_partkey, p_size, p_brand", "p_size > 5 AND p_size <= 30 AND p_size <> 20 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#11')")
_find("find_all_rows", "nation", {}, "n_nationkey, n_name", "true")


def _customers(spark, d) -> DataFrame:
    """Customers, of whom those in machinery have no segment."""
    return table(spark, d, "customer").withColumn("c_mktsegment", F.nullif("c_mktsegment", F.lit("MACHINERY")))


@query("SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NULL")
def find_null(spark, d):
    return c.find(_customers(spark, d), {"c_mktsegment": None}).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NOT NULL AND c_name IS NOT NULL")
def find_exists(spark, d):
    return c.find(_customers(spark, d), {"c_mktsegment": {"$exists": True}, "c_name": {"$exists": True}}).select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 1")
def find_one(spark, d):
    return c.find_one(table(spark, d, "orders"), {"o_orderstatus": "O"}, "o_orderkey").select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def count_where(spark, d):
    return c.count_documents(table(spark, d, "orders"), {"o_totalprice": {"$gt": 100000}})


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50")
def find_all_limit(spark, d):
    return c.find_all(table(spark, d, "orders"), 50, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def history_page(spark, d):
    return c.page(table(spark, d, "orders"), {"o_orderstatus": "F"}, "o_orderdate", 50, 20, "o_orderkey").select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, count(*) AS total FROM orders GROUP BY o_custkey")
def total_count(spark, d):
    return c.totals(table(spark, d, "orders"), "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY coalesce(o_totalprice, 0) DESC, o_orderkey LIMIT 100 OFFSET 10")
def pipe_match_sort_skip_limit(spark, d):
    stages = [{"$match": {"o_orderstatus": "O"}}, {"$sort": {"o_totalprice": -1}}, {"$skip": 10}, {"$limit": 100}]
    return c.aggregate(table(spark, d, "orders"), stages, order="o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS _id, count(*) AS count FROM events GROUP BY 1")
def pipe_group_key(spark, d):
    return c.aggregate(table(spark, d, "events"), [{"$group": {"_id": "event_type"}}], items=False)


@query("SELECT '_all' AS _id, count(*) AS count FROM orders")
def pipe_group_all(spark, d):
    return c.aggregate(table(spark, d, "orders"), [{"$group": {"_id": None}}], items=False)


@query("SELECT * FROM (SELECT CASE WHEN o_custkey IS NULL OR o_custkey = 0 THEN 'unknown' ELSE o_custkey::VARCHAR END AS _id, count(*) AS count FROM orders GROUP BY 1) WHERE count >= 15")
def pipe_group_having(spark, d):
    return c.aggregate(table(spark, d, "orders"), [{"$group": {"_id": "o_custkey"}}, {"$match": {"count": {"$gte": 15}}}], items=False)


@query("SELECT n_regionkey::VARCHAR AS _id, count(*) AS count, array_to_string(list(n_name ORDER BY n_nationkey), ',') AS names FROM nation WHERE n_regionkey > 0 GROUP BY 1")
def pipe_group_items(spark, d):
    g = c.group_stage(table(spark, d, "nation").filter("n_regionkey > 0"), "n_regionkey", order="n_nationkey")
    return g.select("_id", "count", F.array_join(F.transform("items", lambda x: x["n_name"]), ",").alias("names"))


@query("""
WITH l AS (SELECT p_name AS key, arg_max_null(coalesce(p_retailprice, 0), p_partkey) AS v FROM part WHERE p_brand = 'Brand#1' GROUP BY 1),
r AS (SELECT p_name AS key, arg_max_null(coalesce(p_retailprice, 0), p_partkey) AS v FROM part WHERE p_brand = 'Brand#2' GROUP BY 1)
SELECT coalesce(l.key, r.key) AS key, coalesce(l.v, 0)::DOUBLE AS left_value, coalesce(r.v, 0)::DOUBLE AS right_value, l.key IS NOT NULL AS in_left_value, r.key IS NOT NULL AS in_right_value
FROM l FULL JOIN r ON l.key = r.key""")  # fmt: skip
def compare_full_outer(spark, d):
    part = table(spark, d, "part")
    return c.ordered_by_name(c.compare_sides(c.find(part, {"p_brand": "Brand#1"}), c.find(part, {"p_brand": "Brand#2"}), "p_name", "p_retailprice", "p_partkey"))


@query("SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def parent_children_left(spark, d):
    return c.with_children(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey").select("o_orderkey", "o_orderstatus", "l_linenumber", "l_partkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def exists_semi(spark, d):
    return c.existing(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def missing_anti(spark, d):
    # customers without a large order
    large = c.find(table(spark, d, "orders"), {"o_totalprice": {"$gt": 450000}})
    return c.missing(table(spark, d, "customer"), large, "c_custkey", "o_custkey").select("c_custkey", "c_name")


_COLOURS = ("red", "green", "blue", "small", "large", "steel", "brass", "copper")


@query(f"SELECT p_partkey, len(list_filter(string_split(lower(p_name), ' '), lambda w: w IN {_COLOURS})) AS hits FROM part")
def dictionary_join(spark, d):
    return table(spark, d, "part").select("p_partkey", food.dictionary_hits(F.col("p_name"), _COLOURS).cast("long").alias("hits"))


_TYPES = ("click", "view", "purchase", "login")


@query("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (event_type = '{x}') AS {x}" for x in _TYPES) + ", max(ts) AS last_at FROM events")
def queue_stats(spark, d):
    return c.status_counts(table(spark, d, "events"), "event_type", _TYPES, "ts")


@query("SELECT user_id, arg_max_null(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def arg_max_last(spark, d):
    return c.last_per_key(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


@query("""
WITH p AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(day) AS d FROM p)
SELECT day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(d - INTERVAL 6 DAY, d, INTERVAL 1 DAY))::DATE AS day FROM m) LEFT JOIN p USING (day)""")
def daily_volume_7d(spark, d):
    return c.daily_counts(table(spark, d, "events"), "ts")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def first_wins_dedup(spark, d):
    return c.first_per_key(table(spark, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


@query("SELECT o_custkey, arg_max_null(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def last_wins(spark, d):
    return c.last_per_key(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS ix, CASE WHEN event_type = 'purchase' THEN event_id END AS v FROM events),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER w AS filled, last_value(CASE WHEN v IS NOT NULL THEN ix END IGNORE NULLS) OVER w AS since FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ix))
SELECT user_id, event_id, CASE WHEN ix - since <= 15 THEN filled END AS filled FROM f""")
def fill_forward(spark, d):
    e = table(spark, d, "events").withColumn("ix", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.select("user_id", "event_id", c.fill_forward(e, ["user_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "ix", 15).alias("filled"))


@query("SELECT l_orderkey, l_linenumber, lag(l_quantity) OVER w AS before, lead(l_quantity) OVER w AS after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)")
def lead_lag_merge(spark, d):
    near = c.neighbours(["l_orderkey"], F.col("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, d, "lineitem").withColumns(near).select("l_orderkey", "l_linenumber", "before", "after")


@query("""
WITH g AS (SELECT user_id, event_id, epoch(ts) AS s, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER w > 86400 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch(ts), event_id))
SELECT user_id, event_id, sum(n) OVER (PARTITION BY user_id ORDER BY s, event_id)::BIGINT AS session FROM g""")
def gap_sessionise(spark, d):
    e = table(spark, d, "events").withColumn("s", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6))
    return e.select("user_id", "event_id", c.sessionise(["user_id"], F.col("s"), F.lit(86400), "event_id").alias("session"))


@query("""
SELECT coalesce(p.p_partkey, n.k) AS p_partkey, CASE WHEN n.k IS NOT NULL THEN n.name ELSE p.p_name END AS p_name, CASE WHEN n.k IS NOT NULL THEN n.size ELSE p.p_size END AS p_size
FROM part p FULL JOIN (SELECT p_partkey + 500 AS k, upper(p_name) AS name, p_size + 1 AS size FROM part WHERE p_size > 10) n ON p.p_partkey = n.k""")
def upsert(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    new = part.filter("p_size > 10").select((F.col("p_partkey") + 500).alias("p_partkey"), F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    return mutate.upsert(part, new, "p_partkey", ["p_name", "p_size"])


@query("""
WITH u AS (SELECT o_custkey AS k, arg_max_null(o_totalprice, o_orderkey) AS v FROM orders GROUP BY 1)
SELECT c_custkey, c_name, CASE WHEN k IS NOT NULL THEN v ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN u ON c_custkey = k""")
def bulk_update(spark, d):
    updates = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("_seq"))
    return mutate.bulk_update(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), updates, "c_custkey", ["c_acctbal"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(p_size > 25, false)")
def delete_many(spark, d):
    return mutate.delete_many(table(spark, d, "part"), {"p_size": {"$gt": 25}}).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_partkey <> (SELECT min(p_partkey) FROM part WHERE p_size > 25)")
def delete_first(spark, d):
    return mutate.delete_one(table(spark, d, "part"), {"p_size": {"$gt": 25}}, "p_partkey").select("p_partkey")


@query("SELECT p_partkey, CASE WHEN p_partkey = (SELECT min(p_partkey) FROM part WHERE p_size > 25) THEN 'sold' ELSE p_name END AS p_name FROM part")
def update_first(spark, d):
    return mutate.update_one(table(spark, d, "part"), {"p_size": {"$gt": 25}}, {"p_name": "sold"}, "p_partkey").select("p_partkey", "p_name")


@query("SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 0 ELSE p_size END AS p_size FROM part")
def update_many(spark, d):
    return mutate.update_many(table(spark, d, "part"), {"p_brand": "Brand#1"}, {"p_size": 0}).select("p_partkey", "p_size")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def insert_many(spark, d):
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return mutate.insert_many(table(spark, d, "customer"), rows).select("c_custkey", "c_name")


def _lines(spark, d) -> DataFrame:
    return lines.explode_lines(table(spark, d, "documents"), "doc_id", F.col("text"))


_LINES = "(SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x, e' \\t\\n\\x0B\\f\\r')), lambda x: x <> '')) AS line FROM documents)"


# SQL of the text rules. RE2 keeps \\b and \\s to ASCII, as the rules do; what strips lines knows all white space.
_WS = r"[\s\x0B\x{85}\pZ]"


def _rx(column: str, pattern: str) -> str:
    return "regexp_matches(" + column + ", '" + pattern.replace(t.BOUNDARY, r"\b").replace("'", "''") + "')"


def _any_of(column: str, patterns, prefix: str = "") -> str:
    return _rx(column, prefix + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")


def _among(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _words_of(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


_AT = rf"""t AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: {_stripped('x')}), lambda x: x <> '') AS l FROM documents),
r AS (SELECT doc_id, unnest(range(len(l))) AS ix, unnest(l) AS line FROM t)"""


def _food(w: str) -> str:
    return f"(lower({w}) IN {_among(t.FOOD_WORDS)} OR {_rx(f'lower({w})', '^(?:' + '|'.join(t.FOOD_PHRASES) + ')$')})"


def _price_steps(source: str, line: str = "line") -> str:
    """CTEs that add price (null: none) to a table with a stripped line."""
    digits = lambda x: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_stripped(x)}, '(?i)^[$€£¥Rs.\s]+', ''), '(?i)[$€£¥.\s]+\z', ''), '^(\d{{1,3}}),(\d{{1,2}})\z', '\1.\2'), '[^\d.]', '', 'g')"
    whole = lambda x: f"TRY_CAST({x} AS DOUBLE)"
    value = lambda x: rf"CASE WHEN {x} = '' THEN NULL WHEN length({x}) >= 4 AND NOT contains({x}, '.') THEN CASE WHEN {whole(x)} < 1000 THEN {whole(x)} WHEN floor({whole(x)} / 100) < 200 THEN floor({whole(x)} / 100) + round(({whole(x)} % 100) / 100, 2) ELSE {whole(x)} END ELSE TRY_CAST(regexp_extract({x}, '^(\d*\.?\d*)', 1) AS DOUBLE) END"
    return f"""p1 AS (SELECT *, regexp_extract({line}, '{t.TRAILING_PRICE}', 0) AS tail, regexp_extract({line}, '{t.LEADING_PRICE}', 0) AS head FROM {source}),
p2 AS (SELECT *, {digits('tail')} AS dt, {digits('head')} AS dh FROM p1), p3 AS (SELECT *, {value('dt')} AS vt, {value('dh')} AS vh FROM p2),
priced AS (SELECT *, CASE WHEN tail <> '' AND vt < {t.MOST_PRICE} THEN vt WHEN head <> '' AND vh < {t.MOST_PRICE} THEN vh END AS price FROM p3)"""


_PRICE_FORMS = """CASE event_id % 6 WHEN 0 THEN 'Soup of the day $' || v WHEN 1 THEN '€' || v || ' Soup' WHEN 2 THEN 'Soup Rs. ' || v || '.' WHEN 3 THEN 'Soup ' || replace(v, '.', ',') WHEN 4 THEN 'Soup of ' || v || ' people' ELSE 'Soup £ ' || split_part(v, '.', 1) END"""


@query("WITH e AS (SELECT event_id, (CASE WHEN value < 1000 THEN floor(value * 100) / 100 END)::DECIMAL(9, 2)::VARCHAR AS v FROM events), r AS (SELECT event_id, " + _PRICE_FORMS + " AS line FROM e), " + _price_steps("r") + " SELECT event_id, price FROM priced")
def price_find(spark, d):
    # every event, in six ways to write a price: before or after the name, with and without sign, decimal comma, no price, no cents
    v = F.when(F.col("value") < 1000, F.floor(F.col("value") * 100) / 100).cast("decimal(9,2)").cast("string")
    return table(spark, d, "events").withColumn("v", v).withColumn("line", F.expr(_PRICE_FORMS)).select("event_id", t.find_price(F.col("line"))["price"].alias("price"))


@query("SELECT event_id, CASE WHEN value >= 0 AND value < 1000 THEN floor(value * 100) / 100 END AS price FROM events")
def price_find_all(spark, d):
    # every event; a price has at most three digits before its point
    line = F.concat(F.lit("Soup of the day $"), F.format_string("%.2f", F.floor(F.col("value") * 100) / 100))
    return table(spark, d, "events").select("event_id", t.find_price(line)["price"].alias("price"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN p_size + 0.25 WHEN 2 THEN CASE WHEN p_size < 10 THEN p_size * 100 ELSE p_size END WHEN 3 THEN p_size END::DOUBLE AS price FROM part")
def price_normalise(spark, d):
    # €5,5 and $5.25 and 1200 (cents) and Rs. 5 and free
    n = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("€"), n, F.lit(",5")), F.concat(F.lit("$"), n, F.lit(".25")), F.concat(n, F.lit("00")), F.concat(F.lit("Rs. "), n), F.lit("free"))
    return table(spark, d, "part").select("p_partkey", t.price_value(F.get(forms, (F.col("p_partkey") % 5).cast("int"))).alias("price"))


_NAME_FORMS = """CASE p_partkey % 8 WHEN 0 THEN '★ ' || p_name || ' .. GF' WHEN 1 THEN '[house] ' || p_name || ' (v)' WHEN 2 THEN '12. ' || p_name WHEN 3 THEN 'SIGNATURE ' || p_name || ' --' WHEN 4 THEN p_name || ' SPICY' WHEN 5 THEN '$4.50 ' || p_name || ';' WHEN 6 THEN replace(p_name, ' ', '__') ELSE p_name || ' S' END"""


@query(r"SELECT p_partkey, CASE WHEN p_partkey % 8 IN (0, 4, 7) THEN regexp_replace(p_name, '(?i)^new\s+', '') ELSE p_name END AS name FROM part")
def name_cleanup(spark, d):
    # every part, with bullets, brackets, numbers, prices, signs and closing tokens around its name; NEW goes where it comes first
    return table(spark, d, "part").select("p_partkey", t.clean_name(F.expr(_NAME_FORMS)).alias("name"))


def _noise_sql(x: str) -> str:
    low = f"lower({x})"
    tests = [f"length({x}) < 3", _any_of(low, t.NOISE_STARTS, "^"), _any_of(low, t.NOISE_ANYWHERE), f"({_rx(low, '^www[a-z]')} AND NOT contains({x}, '.'))", f"(length({x}) <= 3 AND {_rx(x, '^[A-Z][a-z]*$')})", _rx(x, r"^[^\p{L}\p{N}]+$"), f"length(regexp_replace({x}, '[^0-9]', '', 'g')) * 2 > length({x})"]
    return "(" + " OR ".join(tests) + ")"


@query(f"WITH {_AT} SELECT doc_id, ix, {_noise_sql('line')} AS noise FROM r")
def noise_line(spark, d):
    return _lines(spark, d).select("doc_id", "ix", t.is_noise(F.col("line")).alias("noise"))


_SECTION = lambda low: f"({low} IN {_among(t.CATEGORY_TITLES)} OR regexp_replace({low}, 's$', '') IN {_among(t.CATEGORY_TITLES)})"


@query(rf"""
WITH {_AT}, w AS (SELECT *, lower(line) AS low, {_words_of('line')} AS w FROM r), {_price_steps('w')}
SELECT doc_id, ix, price IS NULL AND length(line) BETWEEN 2 AND 80 AND ({_SECTION('low')} OR (NOT {_rx('low', r'[$€£¥]\s*\d|\b\d+[.,]\d')}
  AND (lower(w[1]) IN {_among(t.CATEGORY_TITLES)} OR lower(w[-1]) IN {_among(t.CATEGORY_TITLES)} OR (len(w) <= 3 AND line = upper(line) AND len(list_filter(w, lambda x: {_food('x')})) = 0)))) AS header
FROM priced""")
def header_like(spark, d):
    return _lines(spark, d).select("doc_id", "ix", t.is_header(F.col("line"), t.find_price(F.col("line")).isNotNull()).alias("header"))


@query(rf"""
WITH {_AT}, w AS (SELECT doc_id, ix, lower(line) AS x, {_words_of('lower(line)')} AS w FROM r)
SELECT doc_id, ix, {_rx('x', t.DESCRIPTION_START)} OR {_rx('x', t.DESCRIPTION_CODE)} OR length(x) > 100 OR (len(list_filter(w, lambda v: v IN {_among(t.DESCRIPTION_WORDS)})) >= 2 AND len(w) <= 10) AS description FROM w""")
def description_line(spark, d):
    return _lines(spark, d).select("doc_id", "ix", t.is_description(F.col("line")).alias("description"))


_MIXED = "CASE p_partkey % 4 WHEN 0 THEN 'ab c2 x ' || p_name WHEN 1 THEN 'ab 12 ' || p_name WHEN 2 THEN '12 7' ELSE p_name END"


@query(rf"""
WITH w AS (SELECT p_partkey, list_filter(string_split({_MIXED}, ' '), lambda x: regexp_matches(x, '\pL')) AS w FROM part)
SELECT p_partkey, len(w) > 0 AND len(list_filter(w, lambda x: regexp_matches(x, '\pL{{3,}}'))) >= greatest(1, ceil(len(w) * 0.6)) AS ok FROM w""")
def real_words(spark, d):
    return table(spark, d, "part").select("p_partkey", t.real_words(F.expr(_MIXED)).alias("ok"))


_DISH = "CASE event_id % 9 WHEN 0 THEN 'Pizza Verde' WHEN 1 THEN 'Garden bowl' WHEN 2 THEN 'Soup' WHEN 3 THEN 'Submarine' WHEN 4 THEN 'wrap and steak' WHEN 5 THEN 'Rib eye' WHEN 6 THEN 'Apple pie' WHEN 7 THEN 'Iced tea' ELSE event_type END || ' ' || props"


@query(f"SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(lower({_DISH}), '\\b({w})\\b') THEN '{k}'" for k, w in t.CATEGORY_BY_WORD) + " ELSE 'other' END AS category FROM events")
def guess_category(spark, d):
    return table(spark, d, "events").select("event_id", t.category_of(F.expr(_DISH)).alias("category"))


_MISREAD = "p_name || ' ' || CASE p_partkey % 12 WHEN 0 THEN 'chlcken' WHEN 1 THEN 'bvrger' WHEN 2 THEN 'Pizzs' WHEN 3 THEN 'sandwish' WHEN 4 THEN 'grilld' WHEN 5 THEN 'jalapeno cheez' WHEN 6 THEN 'frid mushro0m' WHEN 7 THEN 'tiramisv' WHEN 8 THEN 'espressoo' WHEN 9 THEN '2 Ib sai mon' WHEN 10 THEN 'stout  float [pa]' ELSE 'plain' END"


def _corrections(x: str) -> str:
    for pattern, to in t.OCR_CORRECTIONS:
        x = f"regexp_replace({x}, '(?i){pattern}', '{to}', 'g')"
    return x


@query(f"SELECT p_partkey, {_corrections(_MISREAD)} AS name FROM part")
def ocr_corrections(spark, d):
    return table(spark, d, "part").select("p_partkey", t.correct_ocr(F.expr(_MISREAD)).alias("name"))


_MENU = "coalesce(text, '') || CASE doc_id % 5 WHEN 0 THEN chr(10) || 'Smoked Brisket' || chr(10) || '$18.50' || chr(10) || '$3' WHEN 1 THEN chr(10) || 'Soup' || chr(10) || '18' || chr(10) || 'www.a.example' || chr(10) || '$20' WHEN 2 THEN chr(10) || 'Tart $' || chr(10) || '7' || chr(10) || '8' || chr(10) || 'DESSERTS' || chr(10) || '9' ELSE '' END"
_KIND = f"""CASE WHEN {_rx('line', '^[\\W_]*$')} THEN 'noise' WHEN {_rx('line', t.PRICE_ONLY)} THEN 'price'
  WHEN lower(line) IN {_among(t.CLEANER_SECTIONS)} OR regexp_replace(lower(line), 's$', '') IN {_among(t.CLEANER_SECTIONS)} OR (line = upper(line) AND length(regexp_replace(line, '[^a-zA-Z]', '', 'g')) >= 3) THEN 'header'
  WHEN ({_rx('line', t.SUBTITLE)} AND {_rx('line', t.VENUE)}) OR ({_rx('line', t.HOURS)} AND {_rx('line', t.HOURS_TIME)}) OR {_any_of('line', t.CLEANER_NOISE_DIGITS, '(?i)')} OR {_any_of('line', t.CLEANER_NOISE, '(?i)')} THEN 'noise' ELSE 'dish' END"""


@query(rf"""
WITH {_AT.replace("coalesce(text, '')", _MENU)}, k AS (SELECT *, CASE WHEN ix = 0 AND line = upper(line) AND length(regexp_replace(line, '[^a-zA-Z]', '', 'g')) >= 3 AND coalesce({_rx('lead(line) OVER (PARTITION BY doc_id ORDER BY ix)', t.SUBTITLE)}, false) THEN 'noise' ELSE {_KIND} END AS kind FROM r),
g AS (SELECT *, sum(CASE WHEN kind = 'price' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ix) AS run FROM k WHERE kind <> 'noise'),
h AS (SELECT *, first_value(line) OVER w AS head, first_value(kind) OVER w AS head_kind, row_number() OVER w AS place, count(*) FILTER (kind = 'price' AND {_rx('line', t.HAS_PRICE)}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g WINDOW w AS (PARTITION BY doc_id, run ORDER BY ix)),
m AS (SELECT *, kind = 'price' AND head_kind = 'dish' AND length(head) >= 3 AND {_rx('head', '[a-zA-Z]{3,}')} AND NOT {_rx('head', t.HAS_PRICE)} AND before = 0 AND (place = 2 OR NOT {_rx('head', r'[$€£¥]\s*$')}) AS merges FROM h),
j AS (SELECT doc_id, substr(string_agg(CASE WHEN merges THEN ' ' ELSE chr(10) END || line, '' ORDER BY ix), 2) AS text, count(*) FILTER (merges) AS merged FROM m GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS dropped FROM k WHERE kind = 'noise' GROUP BY doc_id)
SELECT d.doc_id, coalesce(j.text, '') AS text, coalesce(merged, 0) AS merged, coalesce(dropped, 0) AS dropped FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""")
def clean_text(spark, d):
    # whole texts, most of them with dishes whose prices stand on the next lines
    return lines.clean_text(table(spark, d, "documents"), "doc_id", F.expr(_MENU)).select("doc_id", "text", "merged", F.size("dropped").alias("dropped"))


@query()
def basic_extract(spark, d):
    return lines.basic_extract(table(spark, d, "documents"), "doc_id", F.col("text"))


@query()
def local_dishes(spark, d):
    return parsing.run_local(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "_pos", "part", "name", "price", "category")


@query("SELECT bool_or(value < 50) AS healthy, bool_and(value < 50) AS all_healthy, count(*) AS checked FROM events")
def provider_health(spark, d):
    return c.health(table(spark, d, "events").withColumn("ok", F.col("value") < 50))


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)")
def first_ten_scans(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.lit(None).cast("int").alias("items_count"), F.lit(None).cast("array<string>").alias("dishes"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return c.recent_scans(o, 10, "_id").select("id", "status")


@query("SELECT l_orderkey AS doc, sum(l_discount * l_quantity) / sum(l_quantity) * 100 AS confidence FROM lineitem GROUP BY 1")
def weighted_confidence(spark, d):
    return quality.weighted_confidence(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc"), "doc", "l_discount", F.col("l_quantity"))


@query("SELECT c_custkey, CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer WHERE c_acctbal > 9000) THEN 'Gold' ELSE c_name END AS c_name FROM customer UNION ALL SELECT max(c_custkey) + 1, 'New' FROM customer")
def find_one_and_update(spark, d):
    # the first rich customer gets a name; one that nobody has is inserted
    people = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    once, _ = mutate.find_one_and_update(people, {"c_acctbal": {"$gt": 9000}}, {"c_name": "Gold"}, order="c_custkey")
    twice, _ = mutate.find_one_and_update(once, {"c_mktsegment": "nobody's"}, {"c_name": "New"}, {"c_acctbal": 0.0}, True, "c_custkey")
    return twice.select("c_custkey", "c_name")


# Providers by priority: model and access key. Two of them share a model, two share a key.
_PROVIDERS = ((1, 1, "a"), (2, 2, "a"), (3, 3, "b"), (4, 2, "c"), (5, 4, "d"))
_ANSWER = """CASE (event_id * 7 + priority * 5 + user_id) % 12 WHEN 0 THEN 'returned 429: slow down' WHEN 1 THEN 'returned 404: no such model' WHEN 2 THEN 'returned 400: bad request'
  WHEN 3 THEN 'The operation was aborted due to timeout' WHEN 4 THEN 'returned 503: overloaded' WHEN 5 THEN 'returned 503: busy' WHEN 6 THEN 'read ECONNRESET' WHEN 7 THEN 'quota is used up' END"""
_CHAIN_MS = 2 * 86_400_000
_CHAIN = f"""
WITH RECURSIVE e AS (
  SELECT user_id, event_id, priority, model, access, message, epoch_us(ts) / 1000.0 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id, priority) AS k,
         coalesce({_rx("message", t.TRANSIENT)}, false) AS passing, coalesce(regexp_matches(message, '\\b429\\b|rate limit|quota'), false) AS limited, coalesce(contains(message, '404'), false) AS missing
  FROM (SELECT *, {_ANSWER} AS message FROM events, (VALUES {', '.join(map(str, _PROVIDERS))}) p(priority, model, access)) WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (
  SELECT user_id, 0::BIGINT AS k, 0::BIGINT AS event_id, 0 AS priority, 0 AS model, '' AS outcome, [0, 0, 0, 0] AS failures, [0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS until, []::VARCHAR[] AS spent, []::INTEGER[] AS gone, false AS answered
  FROM e WHERE k = 1
  UNION ALL
  SELECT user_id, k, event_id, priority, model, outcome,
    list_transform(failures, lambda f, i: CASE WHEN i <> model THEN f WHEN outcome = 'answered' THEN 0 WHEN outcome = 'failed' AND passing THEN f + 1 ELSE f END),
    list_transform(until, lambda u, i: CASE WHEN i <> model THEN u WHEN outcome = 'answered' THEN 0.0 WHEN outcome = 'failed' AND passing AND failures[i] + 1 >= 3 THEN ms + {_CHAIN_MS} ELSE u END),
    CASE WHEN outcome = 'failed' AND limited THEN list_append(spent, access) ELSE spent END, CASE WHEN outcome = 'failed' AND missing AND NOT limited THEN list_append(gone, model) ELSE gone END,
    answered OR outcome = 'answered'
  FROM (SELECT *, CASE WHEN answered THEN 'unused' WHEN ms < until[model] THEN 'open' WHEN list_contains(spent, access) THEN 'limited' WHEN list_contains(gone, model) THEN 'missing' WHEN message IS NULL THEN 'answered' ELSE 'failed' END AS outcome
        FROM (SELECT e.*, r.failures, r.until, CASE WHEN e.priority = 1 THEN [] ELSE r.spent END AS spent, CASE WHEN e.priority = 1 THEN [] ELSE r.gone END AS gone, e.priority <> 1 AND r.answered AS answered
              FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
"""


def _chain(spark, d) -> DataFrame:
    providers = F.array(*(F.struct(F.lit(p).alias("priority"), F.lit(m).alias("model"), F.lit(a).alias("access")) for p, m, a in _PROVIDERS))
    calls = table(spark, d, "events").select("event_id", "user_id", "ts", F.inline(providers)).withColumn("message", F.expr(_ANSWER))
    return jobs.provider_chain(calls, "user_id", "event_id", "priority", "model", "access", "ts", "message", 3, _CHAIN_MS)


@query(f"{_CHAIN} SELECT user_id, event_id, priority, model, outcome FROM r WHERE k > 0")
def provider_chain(spark, d):
    return _chain(spark, d)


@query(f"{_CHAIN} SELECT event_id, max(CASE WHEN outcome = 'answered' THEN model END) AS model, count(*) FILTER (WHERE outcome IN ('answered', 'failed')) AS calls FROM r WHERE k > 0 GROUP BY event_id")
def chain_answers(spark, d):
    return jobs.chain_answers(_chain(spark, d), "event_id", "priority", "model")


@query()
def sequential_parse(spark, d):
    return parsing.sequential_parse(lines.spread(table(spark, d, "documents")), "doc_id", "text")


@query()
def second_extractor(spark, d):
    return parsing.second_extractor(lines.spread(table(spark, d, "documents")), "doc_id", "text")


@query()
def split_rows(spark, d):
    part = lines.spread(table(spark, d, "part"))
    fused = part.select(F.col("p_partkey").alias("_pos"), F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size") + 10, F.lit(" CHICKEN CURRY")).alias("name"), F.lit(None).cast("double").alias("price"))
    return lines.split_items(fused)


def _placed_words(spark, d) -> DataFrame:
    w = lines.spread(table(spark, d, "documents")).select("doc_id", F.posexplode(lines_words()).alias("k", "text"))
    return w.select("doc_id", "text", (F.col("k") % 8 * 60).cast("double").alias("x"), (F.floor(F.col("k") / 8) * 30).cast("double").alias("y"), F.lit(50.0).alias("w"), F.lit(12.0).alias("h"), F.lit(90.0).alias("confidence"))


def lines_words():
    return t.words(F.coalesce("text", F.lit("")))


@query()
def smart_parse(spark, d):
    return parsing.smart_parse(_placed_words(spark, d))


@query()
def readings_dishes(spark, d):
    # documents as readings of four kinds: in paragraphs, with places, with words alone, and as a text alone
    kind, told = F.col("doc_id") % 4, TOLD
    lines_ = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: t.strip(x) != "")
    box = lambda w, k, y: F.struct(w.alias("text"), F.struct((k * 60.0).alias("x0"), y.alias("y0"), (k * 60.0 + 50).alias("x1"), (y + 12).alias("y1")).alias("bbox"), F.lit(90.0).alias("confidence"))
    paragraph = lambda x, i: F.struct(x.alias("text"), F.transform(t.words(x), lambda w, k: box(w, k, i * 30.0)).alias("words"))
    words = F.transform(lines_words(), lambda w, k: box(w, k % 8, F.floor(k / 8) * 30.0))
    bare = F.transform(lines_words(), lambda w: F.struct(w.alias("text"), F.lit(None).alias("bbox"), F.lit(60.0).alias("confidence")))
    readings = lines.spread(table(spark, d, "documents")).select(
        "doc_id", "text", F.when(kind == 1, words.cast(told)).when(kind == 2, bare.cast(told)).alias("words"),
        F.when(kind == 0, F.transform(lines_, paragraph)).cast(f"array<struct<text:string,words:{told}>>").alias("paragraphs"), F.lit(None).cast(f"array<struct<paragraphs:array<struct<text:string,words:{told}>>>>").alias("blocks"),
    )
    return parsing.parse_readings(readings, "doc_id").select("doc_id", "parser", "_pos", "part", "name", "price", "category")


@query()
def text_lines(spark, d):
    return lines.text_lines(_placed_words(spark, d)).select("doc_id", "line", "segment", "text", "price", "centred", "header")


_PRICED = r"\$\s*\d|\d+\.\d{2}"


@query(f"""
WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, e' \\t\\n\\x0B\\f\\r') <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 0 THEN 0.0 ELSE len(list_filter(l, lambda x: regexp_matches(x, '{_PRICED}'))) / len(l) END::DOUBLE AS price_ratio,
       CASE WHEN len(l) = 0 THEN 0.0 ELSE list_sum(list_transform(l, lambda x: length(x))) / len(l) END::DOUBLE AS avg_line_len FROM l""")
def layout_stats(spark, d):
    s = quality.text_layout(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", s["price_ratio"].alias("price_ratio"), s["avg_line_len"].alias("avg_line_len"))


_SCORED = "SELECT l_orderkey AS doc, floor(l_discount * 1000) / 1000 AS c, CASE WHEN l_returnflag = 'R' THEN l_extendedprice END AS p FROM lineitem"


@query(f"""
WITH s AS ({_SCORED}), g AS (SELECT doc, count(*) AS n, count(p) AS priced, round(avg(c), 9) AS mean, list_sort(list(c))[count(*) // 2 + 1] AS med FROM s GROUP BY doc)
SELECT doc, round(CASE WHEN n <= 3 THEN 0.2 WHEN priced / n > 0.7 THEN greatest(0.35, mean * 0.7) WHEN priced / n < 0.2 THEN least(0.25, med * 0.8) ELSE greatest(0.2, mean * 0.6) END, 6)::DOUBLE AS threshold FROM g""")
def adaptive_threshold(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.floor(F.col("l_discount") * 1000) / 1000).alias("confidence"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).alias("price"))
    return quality.adaptive_threshold(s, "doc").select("doc", F.round("threshold", 6).alias("threshold"))


_CALLED = "CASE p_partkey % 6 WHEN 0 THEN 'grilled chicken' WHEN 1 THEN 'the and for with all' WHEN 2 THEN 'fish' WHEN 3 THEN 'no 5 of the big plates that come with all of it' WHEN 4 THEN 'pasta 12.50 with garlic cheese' ELSE p_name END"
_CONFIDENCE = f"""
WITH n AS (SELECT p_partkey, p_size > 10 AS priced, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_brand END AS category, p_size % 3 = 0 AS caps, p_size % 4 = 0 AS centred,
  CASE p_partkey % 7 WHEN 0 THEN 'fastfood' WHEN 1 THEN 'descriptive' ELSE 'compact' END AS layout, {_CALLED} AS name FROM part),
w AS (SELECT *, string_split(lower(name), ' ') AS w FROM n), f AS (SELECT *, len(list_filter(w, lambda x: {_food('x')})) AS food, len(list_filter(w, lambda x: x IN {_among(t.GENERIC_WORDS)})) AS generic FROM w)
SELECT p_partkey, round(greatest(0, least(1, CASE WHEN priced THEN 0.4 ELSE 0 END + least(food * 0.15, 0.35) + CASE WHEN category <> '' THEN 0.15 ELSE 0 END + CASE WHEN len(w) BETWEEN 2 AND 6 THEN 0.1 WHEN len(w) > 8 THEN -0.15 ELSE 0 END
  - CASE WHEN caps AND NOT priced THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(name, '\\d') AND NOT regexp_matches(name, '\\d+\\.\\d{{2}}') THEN 0.1 ELSE 0 END - CASE WHEN length(name) < 5 THEN 0.1 ELSE 0 END - CASE WHEN generic > len(w) * 0.5 THEN 0.2 ELSE 0 END
  - CASE WHEN centred THEN 0.1 ELSE 0 END - CASE WHEN layout = 'fastfood' AND NOT priced THEN 0.1 ELSE 0 END + CASE WHEN layout = 'descriptive' AND len(w) <= 3 THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS score FROM f"""


@query(_CONFIDENCE)
def confidence(spark, d):
    layout = F.when(F.col("p_partkey") % 7 == 0, "fastfood").when(F.col("p_partkey") % 7 == 1, "descriptive").otherwise("compact")
    category = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_brand"))
    score = t.confidence(F.col("p_size") > 10, F.expr(_CALLED), category, F.col("p_size") % 4 == 0, F.col("p_size") % 3 == 0, layout)
    return table(spark, d, "part").select("p_partkey", F.round(score, 6).alias("score"))


@query("""
WITH s AS (SELECT event_type, count(value) AS n, avg(value) AS m, stddev_pop(value) AS s FROM events GROUP BY event_type)
SELECT e.event_id, CASE WHEN n >= 3 AND (value < m - 3 * s OR value > m + 3 * s) THEN NULL ELSE value END AS value FROM events e JOIN s USING (event_type)""")
def three_sigma_null(spark, d):
    return quality.three_sigma_null(table(spark, d, "events"), ["event_type"], "value").select("event_id", "value")


_TEXT_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\x0B\\x{85}\\pZ]+'), lambda x: x <> ''))"


def _similar(block: str) -> str:
    return f"""
WITH h AS (SELECT doc_id, {block} AS block, {_TEXT_WORDS} AS w FROM documents WHERE length(text) > 0),
p AS (SELECT l.block, l.doc_id AS a, r.doc_id AS b, len(l.w) + len(r.w) AS n, len(list_intersect(l.w, r.w)) AS c
      FROM h l JOIN h r ON l.block = r.block AND l.doc_id < r.doc_id WHERE len(l.w) > 0 AND len(r.w) > 0 AND least(len(l.w), len(r.w)) >= 0.69 * greatest(len(l.w), len(r.w)))
SELECT block, a, b, round(c / (n - c), 9) AS similarity FROM p WHERE c / (n - c) >= 0.7"""


@query(_similar("lang"))
def jaccard_pairs(spark, d):
    # whole texts by language
    return quality.similar_texts(lines.spread(table(spark, d, "documents")), "lang", "doc_id", "text").withColumn("similarity", F.round("similarity", 9))


@query(_similar("source"))
def jaccard_pairs_text(spark, d):
    # whole texts by source
    return quality.similar_texts(lines.spread(table(spark, d, "documents")), "source", "doc_id", "text").withColumn("similarity", F.round("similarity", 9))


@query()
def jaccard_greedy(spark, d):
    # the rows of a document, as a menu's dishes are: a group is never larger than a text
    return quality.greedy_dedup(_lines(spark, d).select("doc_id", F.col("ix").cast("long").alias("_pos"), F.col("line").alias("name")), "doc_id")


@query("""
WITH n AS (SELECT DISTINCT p_name AS name, string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g')), ' ') AS w FROM part WHERE p_name IS NOT NULL)
SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name < b.name
WHERE a.w = b.w OR CASE WHEN len(a.w) <= len(b.w)
  THEN len(list_filter(a.w, lambda p: len(list_filter(b.w, lambda q: levenshtein(p, q) <= 1)) > 0)) = len(a.w)
  ELSE len(list_filter(b.w, lambda p: len(list_filter(a.w, lambda q: levenshtein(p, q) <= 1)) > 0)) = len(b.w) END""")
def fuzzy_match_pairs(spark, d):
    return quality.fuzzy_pairs(table(spark, d, "part"), "p_name")


_RAW = "p_type || ' ' || CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN translate(p_name, 'ae', 'oe') WHEN 2 THEN split_part(p_name, ' ', 1) ELSE 'nothing' END"


@query(f"""
WITH x AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9&'']+'), lambda w: length(w) >= 3) AS w, list_filter(regexp_split_to_array(lower({_RAW}), '[^a-z0-9&'']+'), lambda w: length(w) >= 3) AS k FROM part)
SELECT p_partkey, len(w) > 0 AND len(list_filter(w, lambda a: len(list_filter(k, lambda b: levenshtein(a, b) <= 1)) > 0)) = len(w) AS grounded FROM x""")
def grounded_words(spark, d):
    return table(spark, d, "part").select("p_partkey", quality.grounded(F.col("p_name"), F.expr(_RAW)).alias("grounded"))


_HOSTS = ("example.net", "example.org", "example.com")


@query("""
WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, length(url) AS len FROM pages WHERE url IS NOT NULL),
r AS (SELECT page_id, host, len, row_number() OVER (PARTITION BY host ORDER BY len DESC, page_id) AS rank FROM p)
SELECT host, page_id, rank FROM r WHERE rank <= 10""")
def image_rank_topk(spark, d):
    p = table(spark, d, "pages").filter("url IS NOT NULL").select("page_id", F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.length("url").alias("len"))
    return food.first_results(p, "host", F.desc("len"), "page_id", most=10).select("host", "page_id", F.col("rank").cast("long").alias("rank"))


_SHOWN = "CASE page_id % 5 WHEN 0 THEN url || '/plate.JPG' WHEN 1 THEN 'https://images.unsplash.com/' || page_id WHEN 2 THEN 'https://cdn.upload.wikimedia.org/x/' || page_id WHEN 3 THEN 'https://notimages.pexels.com/x/' || page_id ELSE 'http://a.example/b.svg?v=' || page_id END"


@query(rf"""
WITH p AS (SELECT page_id, {_SHOWN} AS u FROM pages),
h AS (SELECT page_id, lower(regexp_extract(u, '://([^/?#]*)', 1)) AS host, regexp_extract(u, '://[^/?#]*([^?#]*)', 1) AS path FROM p)
SELECT page_id, host <> '' AND (list_contains({list(food.IMAGE_HOSTS)}, host) OR len(list_filter({list(food.IMAGE_HOSTS)}, lambda x: ends_with(host, '.' || x))) > 0 OR regexp_matches(path, '(?i)\.(jpg|jpeg|png|gif|webp|svg)$')) AS image FROM h""")
def image_urls(spark, d):
    return table(spark, d, "pages").select("page_id", food.is_image_url(F.expr(_SHOWN)).alias("image"))


@query(f"SELECT event_type AS search, event_id, rank::INTEGER AS rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= {food.PRODUCTS}")
def first_results(spark, d):
    return food.first_results(table(spark, d, "events").withColumnRenamed("event_type", "search"), "search", F.desc_nulls_last("value"), "event_id").select("search", "event_id", "rank")


@query("""
WITH f AS (SELECT * FROM events ORDER BY event_id LIMIT 500), p AS (SELECT ts::DATE AS day, count(*) AS n FROM f GROUP BY 1), m AS (SELECT max(day) AS d FROM p)
SELECT day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(d - INTERVAL 6 DAY, d, INTERVAL 1 DAY))::DATE AS day FROM m) LEFT JOIN p USING (day)""")
def daily_volume_first_500(spark, d):
    return c.daily_counts(table(spark, d, "events"), "ts", most=500, order="event_id")


_PICTURE = "url || CASE page_id % 6 WHEN 0 THEN '/grilled-salmon.jpg?w=1200&h=500' WHEN 1 THEN '/recipe/fresh_seafood.png?q=salmon' WHEN 2 THEN '/logo-brand-icon.svg' WHEN 3 THEN '/plating/dish.webp?width=900&height=1000' WHEN 4 THEN '/salmon-grill/dinner?w=400&h=180' ELSE '' END"


def _image_steps(source: str, url: str = "url", wanted: str = "'grilled salmon'") -> str:
    """CTEs that add base (the score of a URL) and food (whether it is a dish's image) to a table of URLs without fragments."""
    shared = lambda parts: f"len(list_filter(q, lambda w: len(list_filter({parts}, lambda p: contains(p, w) OR contains(w, p))) > 0))"
    number = lambda a, b: f"coalesce(TRY_CAST(nullif(regexp_extract(url_query, '(?:^|&){a}=([^&]*)', 1), '') AS DOUBLE), TRY_CAST(nullif(regexp_extract(url_query, '(?:^|&){b}=([^&]*)', 1), '') AS DOUBLE))"
    points = " + ".join(f"CASE WHEN {_rx('low', '(?i)' + p)} THEN 10 ELSE 0 END" for p in food.FOOD_PATTERNS)
    non = "[" + _among(food.NON_FOOD)[1:-1] + "]"
    words = "|".join(food.FOOD_EXCLUSION)
    return f"""i1 AS (SELECT *, lower({url} || ' ' || {wanted}) AS low, lower(regexp_extract({url}, '^[^:]+://[^/?#]*([^?#]*)', 1)) AS url_path, lower(regexp_extract({url}, '[?]([^#]*)', 1)) AS url_query, string_split(lower({wanted}), ' ') AS q FROM {source}),
i2 AS (SELECT *, len(list_filter({non}, lambda x: contains(low, x))) AS hits, {shared("regexp_split_to_array(url_path, '[/_-]+')")} AS in_path, {shared("regexp_split_to_array(CASE WHEN url_query <> '' THEN '?' || url_query ELSE '' END, '[?&=+/_-]+')")} AS in_query, {number('w', 'width')} / nullif({number('h', 'height')}, 0) AS ratio FROM i1),
scored AS (SELECT *, greatest(0, least(100, 50 - hits * 15 + {points} + in_path * 6 + in_query * 2 - CASE WHEN in_path = 0 AND in_query = 0 THEN 20 ELSE 0 END
  - CASE WHEN ratio > 2.1 OR ratio < 0.45 THEN 15 WHEN ratio > 1.8 OR ratio < 0.55 THEN 8 ELSE 0 END))::INT AS base, hits < 3 AND NOT {_rx('low', '(?:^|[^A-Za-z0-9_])(?:' + words + ')(?:$|[^A-Za-z0-9_])')} AS food FROM i2)"""


_PAGES = f"SELECT page_id, split_part({_PICTURE}, '#', 1) AS url FROM pages"


def _pictures(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(f"split_part({_PICTURE}, '#', 1)").alias("url"))


@query(f"WITH r AS ({_PAGES}), {_image_steps('r')} SELECT page_id, base AS score, food FROM scored")
def image_score(spark, d):
    wanted = F.lit("grilled salmon")
    return _pictures(spark, d).select("page_id", food.image_score(F.col("url"), wanted).alias("score"), food.is_food_image(F.col("url"), wanted).alias("food"))


@query(f"""
WITH p AS ({_PAGES}), s AS (SELECT page_id, url, 'a' AS source, 0 AS source_ix, 35 AS weight FROM p UNION ALL SELECT page_id, url || '/salmon', 'b', 1, 25 FROM p UNION ALL SELECT page_id, url || '/dish', 'c', 2, 20 FROM p),
r AS (SELECT *, CASE page_id % 3 WHEN 0 THEN 'grilled salmon' WHEN 1 THEN 'seafood dinner' ELSE 'apple pie' END AS dish FROM s), {_image_steps('r', 'url', 'dish')},
e AS (SELECT *, coalesce(max(CASE WHEN base >= 70 AND weight >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY dish ORDER BY source_ix, page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM scored WHERE food),
k AS (SELECT dish, source, page_id, base + weight AS score, row_number() OVER (PARTITION BY dish ORDER BY base + weight DESC, source_ix, page_id) AS rank FROM e WHERE done = 0)
SELECT * FROM k WHERE rank <= 10""")
def rank_images(spark, d):
    # three sources, merged by weight; the first good result ends the search
    p = _pictures(spark, d).withColumn("dish", F.when(F.col("page_id") % 3 == 0, "grilled salmon").when(F.col("page_id") % 3 == 1, "seafood dinner").otherwise("apple pie"))
    sides = {"a": p, "b": p.withColumn("url", F.concat("url", F.lit("/salmon"))), "c": p.withColumn("url", F.concat("url", F.lit("/dish")))}
    merged = food.union_sources(sides).withColumns({"weight": F.element_at(F.array(*map(F.lit, (35, 25, 20))), F.col("source_ix") + 1), "_pos": F.col("page_id")})
    return food.rank_images(merged).select("dish", "source", "page_id", "score", F.col("rank").cast("long").alias("rank"))


@query("""
WITH f AS (SELECT user_id, event_id, coalesce(max(CASE WHEN value >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hit FROM events)
SELECT user_id, event_id FROM f WHERE hit = 0""")
def early_exit(spark, d):
    return food.early_exit(table(spark, d, "events"), ["user_id"], ["event_id"], F.coalesce(F.col("value") >= 50, F.lit(False))).select("user_id", "event_id")


def _bands(column: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {column} > {b} THEN {p}" for b, p in bands) + " ELSE 0 END"


@query(f"""
WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 6 AS kcal, l_tax * 50 AS fibre, l_discount * 100 AS protein, l_quantity / 2 AS fat, l_discount * 200 AS sugars FROM lineitem),
s AS (SELECT *, {_bands('kcal', food.ENERGY)} + {_bands('fat * 0.3::DOUBLE', food.SATURATED)} + {_bands('sugars', food.SUGARS)} + {_bands('kcal * 0.003::DOUBLE', food.SODIUM)} - {_bands('fibre', food.FIBRE)} - {_bands('protein', food.PROTEIN)} AS score FROM n)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN score <= -1 THEN 'A' WHEN score <= 2 THEN 'B' WHEN score <= 10 THEN 'C' WHEN score <= 18 THEN 'D' ELSE 'E' END AS grade FROM s""")
def nutri_score(spark, d):
    q = F.col("l_quantity")
    grade = food.nutri_score(q * 6, F.col("l_tax") * 50, F.col("l_discount") * 100, q / 2, F.col("l_discount") * 200)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", grade.alias("grade"))


_NAMES = "CASE event_id % 6 WHEN 0 THEN 'Energy (kcal)' WHEN 1 THEN 'Protein' WHEN 2 THEN 'Total fat' WHEN 3 THEN 'Carbohydrate' WHEN 4 THEN 'Fiber' ELSE 'Sugars' END"


@query("SELECT user_id, " + ", ".join(f"floor(arg_max_null(value, event_id) FILTER (event_id % 6 = {k}) * {10**dec} + 0.5) / {10**dec} AS {col}" for k, (col, _, dec) in enumerate(food.NUTRIENTS)) + " FROM events GROUP BY user_id")
def nutrient_pivot(spark, d):
    rows = table(spark, d, "events").withColumn("name", F.expr(_NAMES))
    return food.pivot_nutrient_rows(rows, ["user_id"], "name", "value", "event_id")


@query("SELECT p_partkey, len(x) AS n, array_to_string(x, '|') AS names FROM (SELECT p_partkey, list_filter(string_split(p_name, ' '), lambda w: w <> '') AS x FROM part)")
def recipe_unpivot(spark, d):
    w = F.split("p_name", " ")
    part = table(spark, d, "part").select("p_partkey", *(F.coalesce(F.get(w, F.lit(k)), F.lit(" ")).alias(f"strIngredient{k + 1}") for k in range(8)))
    found = food.recipe_ingredients(part)
    return part.select("p_partkey", F.size(found).cast("long").alias("n"), F.array_join(F.transform(found, lambda x: x["name"]), "|").alias("names"))


_SERVED = "CASE p_partkey % 5 WHEN 0 THEN 'with Pork belly' WHEN 1 THEN 'in red wine' WHEN 2 THEN 'rice and egg' ELSE p_type END"


@query(f"SELECT p_partkey, p_name FROM part WHERE NOT regexp_matches(lower(p_name || ' ' || {_SERVED}), 'pork|alcohol|wine')")
def dietary_filter(spark, d):
    keep = food.fits_diets(["halal"], F.col("p_name"), F.expr(_SERVED), F.array().cast("array<string>"))
    return table(spark, d, "part").filter(keep).select("p_partkey", "p_name")


_MAIN = "CASE event_id % 5 WHEN 0 THEN 'Fish' WHEN 1 THEN 'goat cheese' WHEN 2 THEN 'ham' WHEN 3 THEN 'lentils' END"
_SAYS = "CASE event_id % 7 WHEN 0 THEN 'Vegan and gluten free' WHEN 1 THEN 'hot' WHEN 2 THEN 'nut-free, dairy free' ELSE props END"


@query(f"""
WITH e AS (SELECT event_id, lower({_MAIN}) AS i, lower(coalesce({_SAYS}, '')) AS s FROM events),
v AS (SELECT *, i IS NULL OR i NOT IN ('fish', 'ham') AS veg FROM e)
SELECT event_id, array_to_string(list_filter([CASE WHEN veg THEN 'vegetarian' END, CASE WHEN veg AND (contains(s, 'vegan') OR NOT regexp_matches(coalesce(i, ''), 'cheese|cream|butter|milk|egg|yogurt|honey')) THEN 'vegan' END,
  CASE WHEN regexp_matches(s, 'gluten-free|gluten free') THEN 'gluten-free' END, CASE WHEN regexp_matches(s, 'dairy-free|dairy free') THEN 'dairy-free' END, CASE WHEN regexp_matches(s, 'nut-free|nut free') THEN 'nut-free' END, CASE WHEN regexp_matches(s, 'spicy|hot') THEN 'spicy' END], lambda x: x IS NOT NULL), ',') AS tags
FROM v""")
def dietary_tags(spark, d):
    return table(spark, d, "events").select("event_id", F.array_join(food.dietary_tags(F.array(F.coalesce(F.expr(_MAIN), F.lit("greens"))), F.expr(_SAYS)), ",").alias("tags"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 < 3 THEN ts + INTERVAL 1 MILLISECOND * (5000 * power(2, event_id % 5))::BIGINT END AS retry_at FROM events""")
def retry_backoff(spark, d):
    e = table(spark, d, "events")
    at = jobs.retry_at(F.col("ts"), (F.col("event_id") % 5).cast("int"))
    return e.select("event_id", at.alias("retry_at"))


@query("SELECT event_id, CASE WHEN event_id % 5 < 3 THEN 'queued' ELSE 'failed' END AS status, event_id % 5 >= 3 AS dead FROM events")
def dead_letter_split(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("_id"), F.lit("s").alias("scan_id"), (F.col("event_id") % 5).cast("int").alias("retries"), F.lit(3).alias("max_retries"), F.col("ts").alias("created_at"))
    after, dead = jobs.fail(e, F.col("created_at"), F.lit("timeout"), F.lit("stack"))
    gone = dead.select(F.col("job_id").alias("_id"), F.lit(True).alias("dead"))
    return after.join(gone, "_id", "left").select(F.col("_id").alias("event_id"), "status", F.coalesce("dead", F.lit(False)).alias("dead"))


@query("SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 3")
def fifo_pick(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("_pos"), F.when(F.col("event_type") == "click", "queued").otherwise("completed").alias("status"), F.lit(None).cast("timestamp").alias("retry_at"), F.col("ts").alias("created_at"))
    return jobs.pick(e, F.current_timestamp()).select("event_id")


_DAY_MS = 86_400_000


@query(f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
r AS (
  SELECT user_id, k, event_id, ms + {_DAY_MS} AS until, 1 AS n FROM e WHERE k = 1
  UNION ALL
  SELECT e.user_id, e.k, e.event_id, CASE WHEN e.ms > r.until THEN e.ms + {_DAY_MS} ELSE r.until END, CASE WHEN e.ms > r.until THEN 1 ELSE r.n + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, event_id, n <= 3 AS allowed FROM r""")
def rate_limit_fixed_window(spark, d):
    return jobs.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", _DAY_MS, 3)


@query("""
WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) / 1000.0 AS ms, coalesce(value < 50, false) AS ok, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS k FROM events WHERE event_type IS NOT NULL),
r AS (
  SELECT event_type, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0 AS failures, 0::DOUBLE AS until, '' AS met FROM e WHERE k = 1
  UNION ALL
  SELECT e.event_type, e.k, e.event_id, CASE WHEN e.ms < r.until THEN r.failures WHEN e.ok THEN 0 ELSE r.failures + 1 END,
         CASE WHEN e.ms < r.until THEN r.until WHEN e.ok OR r.failures + 1 < 3 THEN 0 ELSE e.ms + 600000 END, CASE WHEN e.ms < r.until THEN 'open' WHEN r.failures >= 3 THEN 'half-open' ELSE 'closed' END
  FROM r JOIN e ON e.event_type = r.event_type AND e.k = r.k + 1)
SELECT event_type, event_id, met FROM r WHERE k > 0""")
def circuit_breaker(spark, d):
    e = table(spark, d, "events").withColumn("ok", F.coalesce(F.col("value") < 50, F.lit(False)))
    return jobs.circuit_breaker(e, "event_type", "ts", "event_id", "ok", 3, 600_000)


@query("""
WITH g AS (SELECT user_id, event_id, ts, value, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def debounce(spark, d):
    return jobs.debounce(table(spark, d, "events"), "user_id", "ts", "value", "1 hour").select("user_id", "start", "n")


_ERROR = "CASE event_id % 7 WHEN 0 THEN 'connect ECONNRESET' WHEN 1 THEN 'HTTP 503' WHEN 2 THEN 'Service busy' WHEN 3 THEN 'bad request 4290' WHEN 4 THEN 'code 429' WHEN 5 THEN event_type END"


@query(f"SELECT event_id, coalesce({_rx(_ERROR, t.TRANSIENT)}, false) AS x FROM events")
def transient_errors(spark, d):
    return table(spark, d, "events").select("event_id", t.is_transient(F.expr(_ERROR)).alias("x"))


@query("SELECT o_orderkey AS id, coalesce(nullif(o_orderstatus, ''), 'completed') AS status, CASE WHEN o_custkey IS NULL THEN 'anonymous' ELSE o_custkey::VARCHAR END AS user_id FROM orders")
def scan_summary(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("_id"), F.lit(None).cast("int").alias("items_count"), F.lit(None).cast("array<string>").alias("dishes"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at"))
    return c.scan_summary(o).select("id", "status", "user_id")


@query("SELECT n_regionkey AS scan_id, string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def string_agg(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("scan_id"), F.col("n_nationkey").alias("_pos"), F.col("n_name").alias("name"), F.lit(None).cast("double").alias("price"), F.lit("").alias("description"))
    return c.menu_text(n).select("scan_id", "names")


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, s_name, 'supplier' FROM supplier")
def union_sources(spark, d):
    sides = {"customer": table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))}
    return food.union_sources(sides).select("id", "name", "source")


@query("SELECT c_custkey AS k, 'first' AS side FROM customer UNION ALL SELECT DISTINCT o_custkey + 500, 'second' FROM orders WHERE o_custkey + 500 NOT IN (SELECT c_custkey FROM customer)")
def fallback_union(spark, d):
    first = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("first").alias("side"))
    return food.with_fallback(first, table(spark, d, "orders").select((F.col("o_custkey") + 500).alias("k"), F.lit("second").alias("side")).distinct(), "k")


@query(rf"""
WITH w AS (SELECT source, doc_id, coalesce(text, '') AS text, {_words_of("coalesce(text, '')")} AS w, doc_id % 3 * 30 + 20.0 AS conf FROM documents),
n AS (SELECT source AS doc_id, doc_id AS ix, len(w) AS words, len(list_filter(w, lambda v: regexp_matches(v, '[a-zA-Z]{{3,}}'))) AS alpha, conf, len(list_filter(string_split(text, chr(10)), lambda x: {_rx('x', t.HAS_PRICE)})) AS priced FROM w),
s AS (SELECT *, alpha * 10 + words + conf / 10 + 25 + priced * 4 + CASE WHEN ix < 0 THEN 1 ELSE 0 END AS score, alpha >= 3 AND conf >= 40 AS fit FROM n),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY fit DESC, CASE WHEN fit THEN score END DESC NULLS LAST, words > 0 DESC, ix) AS rn FROM s)
SELECT doc_id, ix, score::DOUBLE AS score FROM k WHERE rn = 1""")
def best_candidate(spark, d):
    w = t.words(F.coalesce("text", F.lit("")))
    x = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("ix"), "text", F.size(w).alias("word_count"), F.size(F.filter(w, lambda v: v.rlike("[a-zA-Z]{3,}"))).alias("alpha_word_count"), (F.col("doc_id") % 3 * 30 + 20.0).alias("avg_conf"), F.lit(True).alias("has_words"), F.lit(False).alias("is_rapid"))
    return quality.best_candidate(x).select("doc_id", "ix", "score")


@query("""
WITH c AS (SELECT doc_id, list_reduce(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {'n': 0::BIGINT, 'cur': length(x)::BIGINT}),
  lambda a, b: CASE WHEN a.cur = 0 THEN {'n': a.n, 'cur': b.cur} WHEN a.cur + b.cur + 1 <= 6000 THEN {'n': a.n, 'cur': a.cur + b.cur + 1} ELSE {'n': a.n + 1, 'cur': b.cur} END) AS c FROM documents)
SELECT doc_id, c.n + CASE WHEN c.cur > 0 THEN 1 ELSE 0 END AS n FROM c""")
def text_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(quality.chunks(F.coalesce("text", F.lit("")), 6000)).alias("n"))


@query("SELECT r, c, ms FROM (SELECT event_id AS r, event_type AS c, (500 * power(2, event_id % 3))::BIGINT AS ms FROM events)")
def attempts_delay(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("r"), F.col("event_type").alias("c"), jobs.attempts_delay(F.col("event_id") % 3).alias("ms"))


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE value < 50 GROUP BY user_id")
def first_success(spark, d):
    return jobs.first_success(table(spark, d, "events").withColumn("ok", F.coalesce(F.col("value") < 50, F.lit(False))), "user_id", "event_id", "ok")
