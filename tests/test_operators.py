"""Operators without SQL: small tables with the rows that their rules give by hand."""

from pyspark.sql import functions as F

from ladle.functions import dictionaries as words
from ladle.functions import text as t
from ladle.operators import collection as c
from ladle.operators import food, jobs, lines, mutate, parsing, quality
from ladle.sources import io


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_whole_dictionaries(spark):
    titles = spark.createDataFrame([(x,) for x in words.CATEGORY_TITLES], "x string")
    assert titles.filter(~t.is_section(F.col("x"))).count() == 0 and len(set(words.CATEGORY_TITLES)) == len(words.CATEGORY_TITLES) > 200
    dishes = [*words.FOOD_WORDS, *(p.replace(r"\s*", " ") for p in words.FOOD_PHRASES), "DimSum", "Pad Thai"]
    assert spark.createDataFrame([(x,) for x in dishes], "x string").filter(~t.is_food(F.col("x"))).count() == 0
    others = spark.createDataFrame([(x,) for x in ("hot rice curry", "chicke", "a,b", "", "main courses of the day")], "x string")
    assert others.filter(t.is_section(F.col("x")) | t.is_food(F.col("x"))).count() == 0
    urls = spark.createDataFrame([(f"{a} {b} {d}",) for a, b, d in zip(food.NON_FOOD, food.NON_FOOD[1:], food.NON_FOOD[2:])], "u string")
    assert urls.filter(food.is_food_image(F.col("u"), F.lit("x"))).count() == 0  # three words that are no food


def test_rows_of_one_document_are_apart(spark):
    docs = spark.createDataFrame([(1, "Tomato Soup\n$4.50"), (1, "Tomato Stew\n$4.50"), (None, "SALADS\nGreen Salad $5.00"), (None, "Green Salad $6.00"), (2, ""), (3, None)], "id int, txt string")
    cleaned = lines.clean_text(docs, "id", F.col("txt"))
    assert rows(cleaned, "id", "text", "merged") == [(1, "Tomato Soup $4.50", 1), (1, "Tomato Stew $4.50", 1), (None, "Green Salad $6.00", 0), (None, "SALADS\nGreen Salad $5.00", 0)]
    assert rows(lines.basic_extract(docs.filter("id IS NULL"), "id", F.col("txt")), "name", "price", "category") == [("Green Salad", 5.0, "SALADS"), ("Green Salad", 6.0, "salad")]


def test_prices_on_their_own_lines(spark):
    texts = {"Soup\n18\n$20\n$3": "Soup 18 $20\n$3", "Soup $\n18\n7": "Soup $ 18\n7", "$5\nSoup": "$5\nSoup", "7\n8": "7\n8", "SOUPS\n$5": "SOUPS\n$5", "STEEL & OAK\nGastro Pub · Est. 2011\nTart\n3": "Tart 3", "Soup\nwww.a.example\n4": "Soup 4"}
    got = lines.clean_text(spark.createDataFrame([(x,) for x in texts], "txt string"), "txt", F.col("txt")).collect()
    assert {r.txt: r.text for r in got} == texts
    assert all([x["text"] for x in r.lines] == r.text.split("\n") for r in got)


def test_local_run(spark):
    text = "STARTERS\nTomato Soup $4.50\nTomato Soup Hot $4.60\nDelivery\nGrilled Chicken 12.50 CHICKEN CURRY\nApple Pie\n$6.00\nLemon Tart $5.00\n"
    got = parsing.run_local(spark.createDataFrame([(1, text), (2, "")], "id int, txt string"), "id", "txt")
    names = [r.name for r in got.orderBy("_pos", "part").collect()]
    assert names[0] == "Tomato Soup" and "Apple Pie" in names and "Lemon Tart" in names and not any("Delivery" in n for n in names)


def test_find_one_and_update(spark):
    df = spark.createDataFrame([(0, "a", "x", 1), (1, "b", "x", 2)], "_pos long, _id string, kind string, n int")
    table, doc = mutate.find_one_and_update(df, {"kind": "x"}, {"n": 9})
    assert rows(table, "_id", "n") == [("a", 9), ("b", 2)] and rows(doc, "_id", "n") == [("a", 9)]
    table, doc = mutate.find_one_and_update(df, {"kind": "y", "n": {"$gt": 0}}, {"n": 7}, {"n": 8}, upsert=True)
    (new,) = doc.collect()
    assert (new._pos, new.kind, new.n) == (2, "y", 8) and new._id and rows(table, "_id") == sorted([("a",), ("b",), (new._id,)])
    table, doc = mutate.find_one_and_update(df, {"kind": "y"}, {"n": 7})
    assert rows(table, "n") == [(1,), (2,)] and doc.count() == 0


def test_upsert_of_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 1), (2, "e", 5)], "k int, v string, at int")
    assert rows(mutate.upsert(df, new, "k", ["v"], "at"), "k", "v") == [(1, "b"), (2, "e")]
    assert rows(mutate.upsert(df, new, "k", ["v"]), "k", "v") == [(1, "c"), (2, "e")]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "c")
    names = [io.write_collection(spark.range(n), root) for n in (1, 2, 3)]
    assert io.read_current(spark, root).count() == 3 and len(set(names)) == 3
    assert io.remove_old(spark, root, keep=2) == names[:1]
    assert io.read_current(spark, root).count() == 3 and io.remove_old(spark, root) == []


def test_queue_actions(spark):
    j = spark.createDataFrame([(0, "a", "queued", 0, "", 2), (1, "b", "queued", 0, "", 1), (2, "c", "failed", 3, "boom", 0), (3, "d", "completed", 0, None, 0)], "_pos long, _id string, status string, retries int, error string, s int")
    j = j.withColumns({"retry_at": F.lit(None).cast("timestamp"), "created_at": F.timestamp_seconds("s")})
    table, job = jobs.process_next(j, F.current_timestamp())
    assert rows(job, "_id") == [("b",)] and rows(table, "_id", "status") == [("a", "queued"), ("b", "processing"), ("c", "failed"), ("d", "completed")]
    assert rows(jobs.reset_failed(j).filter("_id = 'c'"), "status", "retries", "error") == [("queued", 0, "")]
    assert rows(jobs.clear_finished(j), "_id") == [("a",), ("b",)]


def test_bounded_cache(spark):
    looked = [("a", 0), ("b", 1), ("a", 2), ("c", 3), ("a", 4), ("b", 5), ("c", 400)]
    df = spark.createDataFrame([("s", k, i, s) for i, (k, s) in enumerate(looked)], "shard string, k string, i int, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: r.hit for r in jobs.bounded_cache(df, "shard", "k", "ts", "i", 300, 2).collect()}
    # c takes the place of a, a that of b, b that of c; c is stored anew
    assert [got[i] for i in range(7)] == [False, False, True, False, False, False, False]


def test_groups_by_height(spark):
    w = [(1, "a", 0, 10, 8, 0, 0), (1, "b", 9, 12, 8, 0, 0), (1, "c", 0, 40, 8, 0, 0), (1, "top", 0, 1, 0, 1, 0)]
    got = lines.group_by_height(spark.createDataFrame(w, "doc_id int, text string, x int, y int, h int, block int, line int"))
    assert rows(got, "text", "group") == [("a", 1), ("b", 1), ("c", 2), ("top", 0)]


def test_readings(spark):
    schema = "doc_id int, paragraphs array<struct<text:string,words:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>>>, blocks array<struct<paragraphs:array<struct<text:string,words:array<struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>>>>>"
    word = lambda x, k: (x, (0.0, 10.0 * k, 30.0, 10.0 * k + 8), 90.0)
    para = lambda k, *x: ("text", [word(y, k) for y in x])
    df = spark.createDataFrame([(1, [para(0, "Soup"), ("  ", [word("gone", 1)])], None), (2, [], [([para(3, "Pie", "$4")],), (None,)])], schema)
    assert rows(lines.flatten_reading(df), "doc_id", "paragraph", "text", "h") == [(1, 0, "Soup", 8.0), (2, 0, "$4", 8.0), (2, 0, "Pie", 8.0)]
    noisy = spark.createDataFrame([(1, float(k)) for k in (90, 80, 20, 70)] + [(2, 4.0), (2, 6.0)], "doc_id int, confidence double")
    assert rows(quality.filter_words(noisy), "doc_id", "confidence") == [(1, 70.0), (1, 80.0), (1, 90.0), (2, 4.0), (2, 6.0)]
    (cut,) = spark.range(1).select(lines.slice_line(F.lit("ab  c"), F.lit(10.0), F.lit(40.0)).alias("s")).first()
    assert [(x["text"], x["x"], x["w"]) for x in cut] == [("ab", 10.0, 20.0), ("c", 40.0, 10.0)]


def test_paragraphs_are_columns(spark):
    w = [(1, p, x, 10.0 + 60 * k, 20.0 * p + 10, 50.0, 12.0, 90.0) for p, line in enumerate(["Grilled Chicken $12.50", "Tomato Soup $4.50"]) for k, x in enumerate(line.split())]
    got = parsing.paragraph_parse(spark.createDataFrame(w, "doc_id int, paragraph int, text string, x double, y double, w double, h double, confidence double"))
    assert rows(got, "name", "price") == [("Grilled Chicken", 12.5), ("Tomato Soup", 4.5)]


def test_picks(spark):
    parsed = spark.createDataFrame([(1, "a", True, 5.0), (1, "b", False, 5.0), (1, "b", False, 6.0), (2, "a", True, 5.0), (2, "b", False, 7.0)], "doc int, cand string, base boolean, price double")
    assert rows(quality.best_parse(parsed, "doc", "cand", "base"), "doc", "cand") == [(1, "b"), (2, "a")]
    extra = spark.createDataFrame([(1, "x", False, float(k)) for k in range(3)] + [(9, "x", False, 1.0)], "doc int, cand string, base boolean, price double")
    assert rows(quality.rescue_pick(parsed, extra, "doc", "cand", "base"), "doc", "cand") == [(1, "x"), (2, "a")]
    assert rows(quality.best_strategy(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.9), (1, "c", 0.1), (1, "c", 0.2)], "doc int, s string, confidence double"), "doc", "s"), "s", "n") == [("c", 2)]
    assert rows(quality.best_mode(spark.createDataFrame([(1, 6, 4), (1, 11, 4), (2, 6, 2)], "doc int, mode int, alpha int"), "doc", "mode", "alpha"), "doc", "mode") == [(1, 6)]
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, 3)], "doc_id int, layer int")
    assert rows(quality.cascade(items, spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")), "doc_id", "layer", "confidence") == [(1, "2", 60), (2, "3", 85), (3, "failed", 0)]
    conf = spark.createDataFrame([(1, 0.5, 1), (1, 1.0, 3), (2, None, 1)], "doc int, conf double, n int")
    assert rows(quality.weighted_confidence(conf, "doc"), "doc", "confidence") == [(1, 75.0), (2, 0.0)]
    assert rows(quality.weighted_confidence(conf, "doc", weight=F.col("n")), "confidence") == [(0.0,), (87.5,)]


def test_accepted_lists(spark):
    old = spark.createDataFrame([(1, 0, "Tomato Soup", 4.0), (2, 0, "Apple Pie", 5.0), (3, 0, "Tart", None)], "doc int, _pos int, name string, price double")
    new = spark.createDataFrame([(1, 0, "Tomato Soop", 4.0), (2, 0, "Cake", 5.0)], "doc int, _pos int, name string, price double")
    assert rows(quality.accept_list(old, new, "doc"), "doc", "accepted") == [(1, True), (2, False), (3, False)]


def test_small_rules(spark):
    one = spark.range(1)
    fenced = one.select(t.fenced_json(F.lit('```json\n{"a": 1}\n```'), "a int").alias("x"), t.fenced_json(F.lit("no json"), "a int").alias("y")).first()
    assert fenced.x.value.a == 1 and fenced.x.text is None and fenced.y.value is None and fenced.y.text == "no json"
    product = F.from_json(F.lit('{"energy-kcal_100g": "250.26", "fat_100g": 0}'), "map<string,string>")
    got = one.select(*food.nutriments(product)).first()
    assert (got.calories, got.fat_g, got.protein_g) == (250.3, None, None)
    errors = spark.createDataFrame([("j", "a", "bad"), ("j", "b", None), ("k", "c", "worse")], "job_id string, dish string, error string")
    assert {r.job_id: r.dish_errors for r in jobs.dish_errors(errors).collect()} == {"j": {"a": "bad"}, "k": {"c": "worse"}}
    steps = spark.createDataFrame([("j", 0, None), ("j", 8, None), ("k", 2, "x"), ("k", 99, None)], "job string, step int, error string")
    assert rows(jobs.progress_events(steps, "job", "step"), "job", "step", "event", "progress") == [("j", 0, "status", 5), ("j", 8, "complete", 100), ("k", 2, "error", 20), ("k", 99, "complete", 100)]
    assert rows(food.food_results(spark.createDataFrame([("A fresh pie", None), ("a car", "red"), (None, "SOUP")], "d string, alt string"), "d", "alt"), "d") == [("A fresh pie",), (None,)]
    classes = spark.createDataFrame([("i", "soup", 0.5), ("i", "soup", 0.7), ("i", "pie", 0.6), ("i", "car", 0.001)], "image string, name string, confidence double")
    assert rows(food.top_classes(classes, "image"), "name", "confidence", "rank") == [("pie", 0.6, 2), ("soup", 0.7, 1)]
    assert rows(c.health(spark.createDataFrame([], "ok boolean")), "healthy", "all_healthy", "checked") == [(False, True, 0)]
    assert rows(c.first_per_key(spark.createDataFrame([(1, 2, "b"), (1, 1, None), (2, None, "c")], "k int, o int, v string"), ["k"], "o"), "k", "o", "v") == [(1, 1, None), (2, None, "c")]
    assert rows(jobs.latest_per_key(spark.createDataFrame([(1, 2, "b"), (1, None, "a"), (2, None, "c")], "k int, o int, v string"), "k", "o"), "k", "v") == [(1, "b"), (2, "c")]
    assert rows(lines.reading_order(spark.createDataFrame([(1, 30.0, 5.0), (1, 10.0, 3.0), (1, 0.0, 40.0)], "doc int, x double, y double"), "doc"), "x", "band") == [(0.0, 2.0), (10.0, 0.0), (30.0, 0.0)]


def test_one_small_file_is_split_among_all_cores(spark):
    from ladle.plans import catalogue

    assert catalogue.split_rows(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
