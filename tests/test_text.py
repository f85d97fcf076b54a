"""Golden cases of the text rules, extractors and scores."""

import pytest
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators import food, lines, parsing, quality

S = F.col("s")


def values(spark, texts, f):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string")
    return [r.v for r in df.select("k", f.alias("v")).orderBy("k").collect()]


def test_prices(spark):
    assert values(spark, ["1250", "999", "12,50", "$4.50", "1,250.00", "abc", "", "250000"], t.price_value(S)) == [12.5, 999, 12.5, 4.5, 1250, None, None, 250000]
    assert values(spark, ["$4.50", "$3", "€12,5", "12.50"], t.price_in_word(S)) == [4.5, 3, 12.5, None]
    assert values(spark, ["Soup $4.50", "$4 Soup", "Soup", "Soup 12,50 .."], t.find_price(S)["price"]) == [4.5, 4, None, 12.5]
    assert values(spark, ["Soup $4.50", "$4 Soup", "Soup 18 or 18"], t.without_price(S, t.find_price(S))) == ["Soup", "Soup", "Soup 18 or"]
    assert values(spark, ["a $4\nb 4.50\nc", None], t.count_price_lines(S)) == [2, 0]


def test_lines_and_names(spark):
    assert values(spark, ["Smoked Brisket", "$18.50", "TACOS", "Order Online", "~~~", "Gastro Pub · Est. 2011", "123 Main Street", "Page 1 of 2"], t.line_kind(S)) == ["dish", "price", "header", "noise", "noise", "noise", "noise", "noise"]
    assert values(spark, ["Order Online", "ab", "call 555-123-4567", "Mushroom Soup", "12345 67"], t.is_noise(S)) == [True, True, True, False, True]
    assert values(spark, ["★ NEW! Fish & Chips GF", "1. Soup .. (hot)", "Soup of the day an ab", "a-b -- c", "!!"], t.clean_name(S)) == ["Fish & Chips", "Soup", "Soup of the day", "a-b", "!!"]
    assert values(spark, ["grilled chiken", "plain"], t.correct_ocr(S)) == ["Grilled Chicken", "plain"]
    assert values(spark, ["Desserts", "Margherita Pizza $9.99", "soups"], t.is_header(S, F.contains(S, F.lit("$")))) == [True, False, True]
    assert values(spark, ["with cream", "Lamb Chop"], t.is_description(S)) == [True, False]
    assert values(spark, ["Lamb Chop", "Ice Cream", "Rocket"], t.category_of(S)) == ["entree", "dessert", "other"]
    assert values(spark, ["Pad Thai ab", "a b c", "éclair"], t.real_words(S)) == [True, False, True]
    assert values(spark, ["GREEK", "german ", "klingon"], t.language_of(S)) == [None, "German", None]
    assert values(spark, ["HTTP 429", "boom"], t.error_message(S)) == ["Service is busy. Please try again in a minute.", "Something went wrong. Please try again."]
    assert values(spark, ["A dish from Northern Italy, served", None], t.origin_of(S)) == ["Northern Italy", ""]


MENU = "STEEL & OAK\nGastro Pub · Est. 2011\nSmoked Brisket\n$18.50\nSoup\n18\n$20\n$21\nDESSERTS\nChocolate Cake 7.50"


def test_cleaning_merges_split_prices(spark):
    docs = spark.createDataFrame([(1, MENU), (2, None), (3, "")], "doc int, txt string")
    (row,) = lines.clean_text(docs, "doc", F.col("txt")).collect()
    assert row.text == "Smoked Brisket $18.50\nSoup 18 $20\n$21\nDESSERTS\nChocolate Cake 7.50"
    assert row.dropped == ["STEEL & OAK", "Gastro Pub · Est. 2011"] and row.merged == 3
    again = lines.clean_text(spark.createDataFrame([(1, row.text)], "doc int, txt string"), "doc", F.col("txt")).first()
    assert again.merged == 0 and again.text == row.text


def test_extractors(spark):
    docs = spark.createDataFrame([(1, "STARTERS\n\nTomato Soup 5.50\nGarlic Bread\n4.00\n\nMAINS\n\nGrilled Salmon $18.00\nTomato Soup 9\nDESSERTS\nChocolate Cake 7.50")], "doc int, txt string")
    got = [(r.name, r.price, r.category) for r in parsing.sequential_parse(docs, "doc", "txt").orderBy("ix").collect()]
    assert got == [("Tomato Soup", 5.5, "STARTERS"), ("Garlic Bread", 4.0, "STARTERS"), ("Grilled Salmon", 18.0, "MAINS"), ("Chocolate Cake", 7.5, "DESSERTS")]
    plain = spark.createDataFrame([(1, "DESSERTS\nChocolate Cake 7.50\nwith cream\nchocolate cake 8\nLemon Tart $6")], "doc int, txt string")
    assert [(r.name, r.price, r.category) for r in lines.basic_extract(plain, "doc", F.col("txt")).orderBy("ix").collect()] == [("Chocolate Cake", 7.5, "DESSERTS"), ("Lemon Tart", 6.0, "DESSERTS")]


def test_positioned_words(spark):
    rows = [("STARTERS", 10, 10), ("Tomato", 10, 40), ("Soup", 55, 41), ("$5.50", 200, 40), ("Garlic", 10, 70), ("Bread", 55, 70), ("$4", 200, 72)]
    words = spark.createDataFrame([(1, w, float(x), float(y), 40.0, 12.0, 90.0) for w, x, y in rows], "doc_id int, text string, x double, y double, w double, h double, confidence double")
    assert [(r.name, r.price, r.category) for r in parsing.smart_parse(words).orderBy("ix").collect()] == [("Tomato Soup", 5.5, "STARTERS"), ("Garlic Bread", 4.0, "STARTERS")]


def test_fused_rows(spark):
    assert values(spark, ["BEEF STEW 77 CHICKEN CURRY", "Chicken Soup 5.50", "Soup of 10 days"], F.transform(lines.split_fused(S), lambda d: d["name"])) == [["BEEF STEW", "CHICKEN CURRY"], None, None]


def test_fuzzy_gates(spark):
    df = spark.createDataFrame([("Chicken Soup", "chickn soup"), ("Sandwich", "fresh sandw1ch plate"), ("aaa bbb", "xxx yyy"), ("", "a")], "a string, b string")
    assert [r.v for r in df.select(quality.names_match(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, False, False]
    assert [r.v for r in df.select(quality.grounded(F.col("a"), F.col("b")).alias("v")).collect()] == [True, True, False, False]
    answer = 'Here: ```[{"name":"Chicken Soup","price":"1,005.50"},{"name":"TACOS","price":4},{"name":"Fish Pie","price":null}]```'
    assert [(d.name, d.price) for d in values(spark, [answer], quality.dish_array(S))[0]] == [("Chicken Soup", 1005.5)]
    assert values(spark, ["no list", "[broken"], quality.dish_array(S)) == [[], []]
    assert values(spark, ["aaa\nbbb\nccc"], quality.chunks(S, 7)) == [["aaa\nbbb", "ccc"]]


def test_scores(spark):
    none = F.lit(None)
    assert values(spark, ["x"], food.nutri_score(none, none, none, none, none)) == ["B"]
    assert values(spark, ["x"], food.nutri_score(F.lit(300), F.lit(0), F.lit(0), F.lit(40), F.lit(20))) == ["E"]
    assert values(spark, ["x"], food.dietary_tags(F.array(F.lit("Rice"), F.lit("butter")), F.lit("gluten free and hot"))) == [["vegetarian", "gluten-free", "spicy"]]
    assert values(spark, ["Eggplant curry", "Chicken"], food.fits_diets(["vegan"], S, none.cast("string"), F.array().cast("array<string>"))) == [False, True]
    urls = ["https://x/grilled-salmon.jpg", "https://x/cookies.png", "https://x/cook.png"]
    assert values(spark, urls, food.is_food_image(S, F.lit("dish"))) == [True, True, False]


@pytest.mark.parametrize("query, reject", [("cookies", False), ("cook", True)])
def test_exclusions_are_whole_words(spark, query, reject):
    assert values(spark, [f"https://x/{query}.jpg"], food.is_food_image(S, F.lit("d"))) == [not reject]


def test_parse_menu_in_sql(spark):
    parsing.register_parse_menu(spark)
    rows = spark.sql("SELECT m.name, m.price FROM VALUES ('Soup $4.50\nnothing\nPie 3') AS t(x), LATERAL parse_menu(x) m").collect()
    assert sorted((r.name, r.price) for r in rows) == [("Pie", 3.0), ("Soup", 4.5)]


def test_cleaning_twice_changes_nothing(spark):
    docs = spark.createDataFrame([(1, MENU), (2, "BURGERS\nHouse Burger\n12\nopen daily 9 am\nwww.x.com\nTacos 3.50")], "doc int, txt string")
    once = lines.clean_text(docs, "doc", F.col("txt")).select("doc", "text").cache()
    twice = lines.clean_text(once, "doc", F.col("text"))
    assert sorted((r.doc, r.text) for r in once.collect()) == sorted((r.doc, r.text) for r in twice.collect())


def test_second_scorer(spark):
    texts = ["APPETIZERS", "Margherita Pizza $9.99", "fresh tomato and basil on sourdough", "Call 555-123-4567", "---", "Mon to Fri open 9am", "• Lamb Chops 12.50", "Pasta dishes"]
    assert values(spark, texts, lines.score_line(S)["kind"]) == ["section", "dish", "garbage", "footer", "garbage", "footer", "dish", "section"]
    docs = spark.createDataFrame([(1, "PIZZA\nMargherita Pizza $9.99\nfresh tomato and basil\n• Lamb Chops Rosemary\n12.50")], "doc int, txt string")
    got = [(r.name, r.price, r.description, r.category) for r in parsing.second_extractor(docs, "doc", "txt").orderBy("ix").collect()]
    assert got == [("Margherita Pizza", 9.99, "fresh tomato and basil", "pizza"), ("• Lamb Chops Rosemary", 12.5, "", "pizza")]


def test_skew(spark):
    import math

    tilt = math.radians(5)
    rows = [(1, 0.0, 0.0, 60.0, 20 * math.cos(tilt) + 60 * math.sin(tilt)) for _ in range(3)] + [(1, 0.0, 0.0, 300.0, 20 * math.cos(tilt) + 300 * math.sin(tilt)) for _ in range(4)]
    rows += [(2, 0.0, 0.0, 60.0, 20.0), (2, 0.0, 0.0, 300.0, 20.0)]
    boxes = spark.createDataFrame(rows, "doc_id int, x0 double, y0 double, x1 double, y1 double")
    got = {r.doc_id: r.theta for r in quality.estimate_skew(boxes).collect()}
    assert got[1] == pytest.approx(5, abs=0.3) and got[2] == 0


def test_similar_texts_reads_all_lines(spark):
    import random

    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(40)] for _ in range(6)]
    rows = []
    for k in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 1, 3, 6, 9])):
            w[rng.randrange(40)] = f"new{rng.randint(0, 999)}"
        # first lines differ, so only the lines below them are alike
        rows.append((k, f"Title{k}\n" + " ".join(w[:20]) + "\r\n\n" + " ".join(w[20:]), rng.choice(["a", "b", None])))
    rows += [(60, None, "a"), (61, "", "a"), (62, " \n", "a"), (63, "one", "a"), (64, "ONE\none", "a")]
    sets = {k: set((x or "").lower().split()) for k, x, _ in rows}
    block = {k: b for k, _, b in rows}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and block[a] is not None and block[a] == block[b] and sets[a] and sets[b]}
    got = quality.similar_texts(spark.createDataFrame(rows, "k int, txt string, source string"), "source", "k", "txt", heavy=(10, 30)).collect()
    assert {(r.a, r.b): r.similarity for r in got} == pytest.approx({p: s for p, s in want.items() if s >= 0.7}) and len(got) > 20
    assert len(got) == len({(r.a, r.b) for r in got})


def test_price_find_all_keeps_every_event(spark, tmp_path):
    from ladle.plans import catalogue

    rows = [(1, None, 4.5), (2, "a", 12.349), (3, "a", 560.21), (4, "a", 999.99), (5, "a", 1000.0), (6, "a", -1.0), (7, "a", None), (8, "a", 0.0)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.price for r in catalogue.QUERIES["price_find_all"](spark, str(tmp_path)).collect()}
    assert got == {1: 4.5, 2: 12.34, 3: 560.21, 4: 999.99, 5: None, 6: None, 7: None, 8: 0.0}


def test_food_dictionary_is_whole(spark):
    from ladle.functions.dictionaries import FOOD_PHRASES, FOOD_WORDS

    assert len(set(FOOD_WORDS)) == len(FOOD_WORDS) == 509 and len(set(FOOD_PHRASES)) == len(FOOD_PHRASES) == 13
    texts = ["gnocchi", "TORTILLA", "Scallop", "oyster", "enchilada", "tapas", "ricotta", "pho", "dim sum", "Dimsum", "baba  ganoush", "t-bone", "gado-gado", "CHÈVRE", "smörgås", "dim", "sum", "dim sums", "chair", "", None]
    assert values(spark, texts, t.is_food(S)) == [True] * 15 + [False] * 5 + [None]
    assert values(spark, ["a dimsum with ricotta and salt", "dim sum"], t.food_count(S)) == [2, 0]
    assert values(spark, ["GNOCCHI", "KLINGON"], t.is_header(S, F.lit(False))) == [False, True]
    # a word of the list scores as much as any other
    score = lambda name: values(spark, [name], t.confidence(F.lit(False), S, F.lit(""), F.lit(False), F.lit(False), F.lit("compact")))
    assert score("Ricotta Plate") == score("Chicken Plate") != score("Klingon Plate")


def test_shared_values_of_a_line_are_computed_once():
    # a name's rewrites stand in the plan in two forms for each place that cleans it; they stood there once for every question
    line = F.struct(F.lit("Soup 5").alias("text"), F.lit(True).alias("priced"), F.lit(False).alias("centred"), F.lit(False).alias("caps"), F.lit("compact").alias("layout"))
    for c in (parsing._asked(line), parsing._line_struct(S, F.lit(0), F.lit("compact"))):
        assert c._jc.toString().count("NEW!?") <= 4


def test_spaces_are_those_of_unicode(spark):
    odd = "\u2003a\u00a0\u3000b\x85c \t"
    assert values(spark, [odd, "a b", ""], t.squeeze(S)) == ["a b c", "a b", ""]
    assert values(spark, [odd, "", None], t.words(S)) == [["a", "b", "c"], [], None]
    assert values(spark, [odd], t.strip(S)) == ["a\u00a0\u3000b\x85c"]


def test_word_lists_are_filed(spark):
    known = ("ab", "cd e", "é")
    assert values(spark, ["ab", "cd e", "é", "", "a", "ab,cd e", "\0", "\0\0", None], t.among(S, known)) == [True, True, True, False, False, False, False, False, None]
    assert values(spark, ["a -- -- b", "x _ _y", "[a] (b) Stew .. {x}. S", "NEW Pie N"], t.clean_name(S)) == ["a b", "x y", "Stew", "Pie"]


def test_no_dish_of_a_long_text_is_dropped(spark):
    dish = lambda k: f"{chr(65 + k % 26)}{'aeiou'[k // 26] * 2}rt{chr(97 + k % 26)}l Soup"
    text = "\n".join(("DESSERTS\n" if k == 60 else "") + f"{dish(k)} {k + 2}.50\n{dish(k).upper()} 3.50" for k in range(120))
    docs = spark.createDataFrame([(1, text), (2, text.replace("\n", "\n\n"))], "doc int, txt string")
    got = lines.basic_extract(docs.filter("doc = 1"), "doc", F.col("txt")).orderBy("ix").collect()
    assert [(r.name, r.price, r.category) for r in got] == [(dish(k), k + 2.5, "soup" if k < 60 else "DESSERTS") for k in range(120)]
    assert [r.name for r in lines.basic_extract(docs.filter("doc = 1"), "doc", F.col("txt"), 7).orderBy("ix").collect()] == [dish(k) for k in range(7)]
    assert parsing.sequential_parse(docs, "doc", "txt").groupBy("doc").count().filter("count = 120").count() == 2
    assert parsing.run_local(docs.filter("doc = 1"), "doc", "txt").count() > 50


def test_second_scorer_asks_prose_little(spark):
    prose = "the long prose of a page about the garden and the old house beside the sea"
    text = f"PIZZA\n{prose}\nMargherita Pizza $9.99\n{prose}\nfresh tomato and basil\n• Lamb Chops Rosemary\n12.50\n• {prose}\n{prose} 12.50\n{prose[:40]}"
    docs = spark.createDataFrame([(1, text), (2, prose), (3, None)], "doc int, txt string")
    got = [(r.doc, r.name, r.price, r.description) for r in parsing.second_extractor(docs, "doc", "txt").orderBy("ix").collect()]
    assert got == [(1, "Margherita Pizza", 9.99, ""), (1, "• Lamb Chops Rosemary", 12.5, ""), (1, prose, 12.5, prose[:40])]
    # letters are counted once a line; each question counted them anew
    assert lines.score_line(S)._jc.toString().count("p{L}]") == 1


def test_dishes_are_made_once_before_they_are_checked(spark):
    docs = spark.createDataFrame([(1, "Tomato Soup $4.50\nOnion Tart $5\nApple Pie $6\nLemon Pie 7.50"), (None, "Plum Cake $4"), (None, "Rice Pudding $3")], "id long, txt string")
    got = parsing.run_local(docs, "id", "txt")
    # for a join with each document's mean price, texts were cleaned and dishes extracted twice
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.id or 0, r.name) for r in got.collect()) == [(0, "Plum Cake"), (0, "Rice Pudding"), (1, "Apple Pie"), (1, "Lemon Pie"), (1, "Onion Tart"), (1, "Tomato Soup")]
    far = spark.createDataFrame([(k // 20, 900.0 if k == 7 else 5.0 + k % 3) for k in range(40)] + [(2, None), (3, 1.0), (3, 99.0)], "doc int, price double")
    both = [sorted(((r.doc, r.price) for r in quality.three_sigma_null(far, ["doc"], "price", small=small).collect()), key=str) for small in (False, True)]
    assert both[0] == both[1] and (0, None) in both[0]


def test_noise_is_asked_of_lines_that_hold_a_part_of_it(spark):
    assert [t.literal(p) for p in ("https?://\\S+", "gluten[- ]free option", r"facebook\.com", r"copyright\s*\d{0,4}", "(?:find|visit)\\s+us", r"^menu\z", r"\bfr[ie]d\b", "[©®™]", "to[- ]?go", r"espresso\w*")] == ["http", "free option", "facebook.com", "copyright", "us", "menu", "fr", "", "to", "espresso"]
    parts = ("Pick-up", "pick up", "TO GO", "togo", "©", "Copyright 2020", "menu", "a menu", "@joe", "https://x", "Gluten Free Option", "visit  us", "Soup", "ALLERGENS", "grilld", "PIZZS", "fred", "saimon", "İ", "")
    texts = [f"{a} {b}".strip() for a in parts for b in parts]
    for patterns in (t.CLEANER_NOISE, t.NOISE_ANYWHERE, [p for p, _ in t.OCR_CORRECTIONS]):
        assert values(spark, texts, t._any(S, patterns, "(?i)")) == values(spark, texts, t._any_held(S, F.lower(S), t._alternatives(patterns), "(?i)"))
