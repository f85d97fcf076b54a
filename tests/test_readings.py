"""Readings with words: routes, rows of several prices, and dishes of each route."""

import pytest
from pyspark.sql import functions as F

from ladle.operators import lines, parsing

WORDS = "array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>"
PARAGRAPHS = f"array<struct<text:string,words:{WORDS}>>"
READINGS = f"doc int, text string, words {WORDS}, paragraphs {PARAGRAPHS}, blocks array<struct<paragraphs:{PARAGRAPHS}>>"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def placed(line, y, x=10.0, confidence=90.0):
    """The words of a line from left to right."""
    out = []
    for w in line.split():
        out.append((w, (x, y, x + 9.0 * len(w), y + 12.0), confidence))
        x += 9.0 * len(w) + 8
    return out


def paragraph(line, y):
    return (line, placed(line, y))


MENU = ["Tomato Soup $4.50", "Grilled Chicken $12.50", "Garlic Bread $3.00"]
WHOLE = [w for k, x in enumerate(MENU) for w in placed(x, 30.0 * k)]
TEXT = "STARTERS\nTomato Soup $4.50\nApple Pie $6.00"


def readings(spark, given):
    return spark.createDataFrame(given, READINGS)


def test_routes(spark):
    unsure = [(w, box, 40.0) for w, box, _ in WHOLE]
    given = [
        (1, TEXT, None, [paragraph(x, 30.0 * k) for k, x in enumerate(MENU)], None),
        (2, TEXT, None, [], [([paragraph(MENU[0], 0.0)],), (None,), ([paragraph(MENU[1], 30.0)],)]),
        (3, TEXT, WHOLE, [paragraph(MENU[0], 0.0)], None),  # one paragraph is none
        (4, TEXT, WHOLE, [("a", placed("a b", 0.0)), ("b", placed("c", 9.0))], None),  # paragraphs of few words
        (5, TEXT, WHOLE, [("  ", placed("a b c", 0.0)), ("b", None), ("c", placed("c d e", 9.0))], None),  # without a text or words
        (6, TEXT, unsure, None, None),
        (7, TEXT, [(w, None, 90.0) for w, _, _ in WHOLE], None, None),
        (8, TEXT, [(w, box, 24.0) for w, box, _ in WHOLE], None, None),  # words that count for nothing
        (9, TEXT, WHOLE[:3], None, None),
        (10, None, None, None, None),
        (11, TEXT, [(None, None, None)] * 9, None, None),
    ]
    got = parsing.routed(readings(spark, given), "doc")
    assert {r.doc: r.parser for r in got.collect()} == {1: "paragraph", 2: "paragraph", 3: "smart", 4: "smart", 5: "smart", 6: "sequential", 7: "sequential", 8: "basic", 9: "basic", 10: "basic", 11: "basic"}


def test_dishes_of_each_route(spark):
    given = [
        (1, "", None, [paragraph(x, 30.0 * k) for k, x in enumerate(MENU)], None),
        (2, "", WHOLE, None, None),
        (3, TEXT, [(w, None, 90.0) for w, _, _ in WHOLE], None, None),
        (4, TEXT, None, None, None),
        (5, "", None, None, None),
        (6, None, None, None, None),
    ]
    got = parsing.parse_readings(readings(spark, given), "doc").collect()
    dishes = [("Garlic Bread", 3.0), ("Grilled Chicken", 12.5), ("Tomato Soup", 4.5)]
    by = {k: sorted((r.name, r.price) for r in got if r.doc == k) for k in range(1, 7)}
    assert by == {1: dishes, 2: dishes, 3: [("Apple Pie", 6.0), ("Tomato Soup", 4.5)], 4: [("Apple Pie", 6.0), ("Tomato Soup", 4.5)], 5: [], 6: []}
    assert {(r.doc, r.parser) for r in got} == {(1, "paragraph"), (2, "smart"), (3, "sequential"), (4, "basic")}


@pytest.mark.parametrize(
    ("line", "gaps", "cut"),
    [
        ("Soup $4 Bread $3", {2: 100.0}, ["Soup $4", "Bread $3"]),
        ("Soup $4 Bread 9x", {2: 100.0}, ["Soup $4 Bread 9x"]),  # one price
        ("Soup $4 Bread $3 77 $5", {2: 100.0, 4: 100.0}, ["Soup $4 Bread $3 77 $5"]),  # a part that begins without a letter: nothing is cut
        ("12 Soup $4 Bread $3", {3: 100.0}, ["12 Soup $4 Bread $3"]),
        ("Cola Small $2 / Tea Large $3", {3: 100.0}, ["Cola Small $2 / Tea Large $3"]),  # sizes
        ("Soup $4 with Bread $3", {2: 100.0}, ["Soup $4 with Bread $3"]),
        ("Soup $4 Bread $3", {2: 20.0}, ["Soup $4 Bread $3"]),
    ],
)
def test_rows_of_several_prices(spark, line, gaps, cut):
    words, x = [], 0.0
    for k, w in enumerate(line.split()):
        x += gaps.get(k, 0.0)
        words.append((1, w, x, 0.0, 9.0 * len(w), 12.0, 90.0))
        x += 9.0 * len(w) + 8
    got = lines.text_lines(spark.createDataFrame(words, "doc_id int, text string, x double, y double, w double, h double, confidence double"))
    assert [r.text for r in got.orderBy("segment").collect()] == cut


PLACED = "doc_id int, text string, x double, y double, w double, h double, confidence double"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_words_of_a_page_are_shuffled_once(spark):
    words = [(d, w, 60.0 * (k % 3), 30.0 * (k // 3), 50.0, 12.0, 90.0) for d in (1, None) for k, w in enumerate("Tomato Soup $4 Garlic Bread $3 -".split())]
    found = lines.text_lines(spark.createDataFrame(words[::-1], PLACED))
    logical, physical = plan_of(found)
    # window after window sorted wide rows of all words, which did not fit a task's memory
    assert "Window" not in logical and physical.count("Exchange hashpartitioning") == 1
    assert rows(found, "doc_id", "line", "segment", "text", "price") == rows(spark.createDataFrame([(d, n, 0, x, p) for d in (1, None) for n, (x, p) in enumerate((("Tomato Soup $4", 4.0), ("Garlic Bread $3", 3.0), ("-", None)))], "doc_id int, line long, segment long, text string, price double"), "*")


def test_columns_without_dishes_are_left_out_early(spark):
    text = {1: "nothing of that kind is here", 2: "many more words", 3: "Grilled Salmon", 4: "PIZZA", 5: "Large 5", 6: "Soup $4"}
    words = [(d, w, 60.0 * k, 30.0 * n, 50.0, 12.0, 90.0) for d, line in text.items() for n, part in enumerate(("just so", line, "and so on")) for k, w in enumerate(part.split())]
    placed = spark.createDataFrame(words, PLACED)
    found = parsing.smart_parse(placed)
    assert "Join" not in plan_of(found)[0]  # for a join all lines were made twice
    kept = parsing._column_features(lines.detect_columns(lines.text_lines(placed)), "doc_id")
    assert sorted(r.doc_id for r in kept.collect()) == sorted([3, 4, 5, 6] * 3)
    assert rows(found, "doc_id", "name", "price") == [(6, "Soup", 4.0)]


def test_documents_in_one_split_are_read_by_all_cores(spark, tmp_path, monkeypatch):
    from ladle.plans import catalogue

    spark.createDataFrame([(k, "Tomato Soup $4.50") for k in range(8)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    monkeypatch.setattr(parsing, "parse_readings", lambda r, doc: given.append(r) or spark.createDataFrame([], "doc_id long, parser string, _pos long, part string, name string, price double, category string"))
    catalogue.QUERIES["readings_dishes"](spark, str(tmp_path))
    assert given[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
