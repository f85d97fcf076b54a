"""Extractors that consume lines in order. All questions about a line are answered by Column expressions first; what is
left is a small state machine over each document's lines, run in Arrow batches where the document is, without a shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators import quality
from ladle.schemas import TOLD
from ladle.session import written

ITEM = "ix INT, name STRING, description STRING, price DOUBLE, category STRING, confidence DOUBLE"
LINE_ONLY_PRICE = r"^[$€£¥]?\s*\d+(?:[.,]\d{1,2})?[\s.]*\z"
#: Under titles with these words two words are a dish, without a food word.
LOOSE_TITLES = ("pizza", "dessert")
SIZES = r"(Small|Regular|Single|Large|Double|Medium|Kids?)\s+[$€£¥]?\s*\d+(?:[.,]\d+)?\s*/?\s*"


def _line_struct(line, block, layout):
    """What the sequential extractor asks of a line. Values that several questions share are bound once."""
    score = lambda priced, name: t.confidence(F.lit(priced), name, F.lit(""), F.lit(False), t.is_upper(name), layout)

    def asked(x, price, clean, base):
        first = F.replace(F.regexp_extract(x, r"\d+(?:[.,]\d{1,2})?", 0), F.lit(","), F.lit("."))
        sizes = x.rlike(t.SIZE_VARIANT)
        return F.struct(
            block.alias("block"), t.is_noise(x).alias("noise"), t.is_header(x, price.isNotNull()).alias("header"), t.header_category(x).alias("title"),
            price["price"].alias("price"), (price["position"] == "trailing").alias("trailing"), F.length(t.strip(F.replace(x, F.coalesce(price["raw"], F.lit("\0")), F.lit("")))).alias("rest"),
            x.rlike(r"^\d+(?:\.\d{1,2})?\z").alias("number"), t.is_description(x).alias("description"), sizes.alias("sizes"),
            base.alias("base"), first.try_cast("double").alias("first"), clean.alias("clean"), F.substring(t.correct_ocr(clean), 1, 200).alias("fixed"), F.when(sizes, F.substring(t.correct_ocr(base), 1, 200)).alias("base_fixed"),
            (clean.rlike(r"\p{L}{3,}") & t.real_words(clean) & ~t.is_noise(clean) & (F.length(clean) >= 3)).alias("real"), (t.food_count(clean) > 0).alias("food"),
            score(True, clean).alias("with_price"), score(False, clean).alias("no_price"),
        )

    # only lines of sizes are asked for their base
    base = lambda x: F.when(x.rlike(t.SIZE_VARIANT), t.clean_name(t.strip(F.regexp_replace(x, SIZES, ""))))
    named = lambda x, price: t.let(t.clean_name(F.coalesce(t.without_price(x, price), x)), lambda clean: t.let(base(x), lambda b: asked(x, price, clean, b)))
    return t.let(line, lambda x: t.let(t.find_price(x), lambda price: named(x, price)))


def _sequential(lines: list[dict], layout: str) -> list[tuple]:
    """Dishes of a text's lines: headers set the category, a price may stand on the next line, names count once."""
    has_headers = any(x["header"] for x in lines)
    out, seen, category, started, skip = [], set(), "", False, -1
    for i, x in enumerate(lines):
        if i == skip or x["noise"]:
            continue
        if x["header"]:
            category, started = x["title"], True
            continue
        price = x["price"]
        if price is None and ((has_headers and not started) or x["number"] or x["description"]):
            continue
        if x["sizes"]:
            key = x["base"].lower()
            if len(x["base"]) > 3 and key not in seen:
                seen.add(key)
                out.append((x["base_fixed"], x["first"], category, 0.6))
            continue
        follower = lines[i + 1] if i + 1 < len(lines) and lines[i + 1]["block"] == x["block"] else None
        if price is None and follower and follower["price"] is not None and follower["trailing"] and follower["rest"] < 3:
            price, skip = follower["price"], i + 1
        if not x["real"] or (layout == "fastfood" and price is None and not x["food"]) or x["clean"].lower() in seen:
            continue
        seen.add(x["clean"].lower())
        score = x["with_price"] if price is not None else x["no_price"]
        out.append((x["fixed"], price, category, min(1.0, score + (0.15 if category else 0.0))))
    return out


def _threshold(rows: list[tuple]) -> float:
    """As quality.threshold_of, on a document in hand."""
    n = len(rows)
    if n <= 3:
        return 0.2 if n else 0.3
    scores = sorted(r[3] for r in rows)
    mean, median, priced = sum(scores) / n, scores[n // 2], sum(r[1] is not None for r in rows) / n
    return max(0.35, mean * 0.7) if priced > 0.7 else min(0.25, median * 0.8) if priced < 0.2 else max(0.2, mean * 0.6)


def _per_document(docs: DataFrame, doc: str, columns: list[str], extract: Callable[[dict], list[tuple]]) -> DataFrame:
    kind = docs.schema[doc].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(key, *r) for key, *values in zip(pdf[doc], *(pdf[c] for c in columns), strict=True) for r in extract(dict(zip(columns, values, strict=True)))]
            yield pd.DataFrame(rows, columns=[doc, "ix", "name", "description", "price", "category", "confidence"])

    return docs.select(doc, *columns).mapInPandas(run, f"{doc} {kind}, {ITEM}")


def sequential_parse(docs: DataFrame, doc: str, text: str, most: int | None = None) -> DataFrame:
    """Dishes (all, or the first `most`) of texts of two or more blocks (blank lines between them); others go to lines.basic_extract."""
    from ladle.operators.lines import basic_extract

    blocks = F.filter(F.transform(F.split(F.col(text), r"\n\s*\n"), t.strip), lambda b: b != "")
    many = docs.withColumn("_blocks", blocks).withColumn("_many", F.coalesce(F.size("_blocks") >= 2, F.lit(False)))
    layout = quality.text_layout(F.col(text))["layout"]
    lines = F.flatten(F.transform("_blocks", lambda b, k: F.transform(F.filter(F.transform(F.split(b, r"\r?\n"), t.strip), lambda x: F.length(x) > 1), lambda x: _line_struct(x, k, F.col("_layout")))))
    work = many.filter("_many").withColumn("_layout", layout).withColumn("_lines", lines)

    def extract(d: dict) -> list[tuple]:
        rows = _sequential([dict(x) if not isinstance(x, dict) else x for x in d["_lines"]], d["_layout"])
        least = _threshold(rows)
        kept = [r for r in rows if r[3] >= least][:most]
        return [(k, name, "", price, category or "other", score) for k, (name, price, category, score) in enumerate(kept)]

    return _per_document(work, doc, ["_layout", "_lines"], extract).unionByName(basic_extract(many.filter("NOT _many"), doc, F.col(text), most).select(doc, *(c.split()[0] for c in ITEM.split(", "))))


@dataclass
class _Column:
    """State of the scan of one column of positioned lines."""

    layout: str
    out: list[dict] = field(default_factory=list)
    pending: dict | None = None
    price: float | None = None
    category: str = ""
    category_at: int = -1
    started: bool = False

    def flush(self) -> None:
        if self.pending:
            self.out.append(self.pending)
        self.pending = None

    def dish(self, x: dict, price: float | None, score: float, description: str = "") -> dict:
        return {"name": x["fixed"], "price": price, "category": self.category, "confidence": min(1.0, score + (0.15 if self.category else 0.0)), "description": description}

    def scan(self, lines: list[dict]) -> list[dict]:
        i = 0
        while i < len(lines):
            i += self.step(i, lines[i], *(lines[k] if k < len(lines) else None for k in (i + 1, i + 2)))
        self.flush()
        return self.out

    def step(self, i: int, x: dict, y: dict | None, z: dict | None) -> int:
        """Take line x; returns how many lines are done with."""
        below = y is not None and y["price"] is not None and y["y"] - x["y"] < 60
        if x["only_price"] and x["price"] is not None:
            self.price = x["price"]
            return 1
        if x["noise"]:
            return 1
        if x["priced"]:
            self.price = None
        if x["header"]:
            return self.header(i, x, y, below)
        if not x["priced"] and x["caps_section"]:
            self.flush()
            self.price, self.started, self.category, self.category_at = None, True, x["caps_section"], i
            return 1
        if self.category and i - self.category_at > 15:
            self.category = ""
        if x["number"]:
            return 1
        if x["sizes"]:
            self.flush()
            if len(x["base"]) > 3:
                self.out.append(self.dish(x | {"fixed": x["base"]}, x["first"], x["with_price"]))
            return 1
        if not x["priced"] and self.price is not None:
            if x["real"]:
                self.flush()
                self.out.append(self.dish(x, self.price, x["with_price"]))
            self.price = None
            return 1
        if not x["priced"] and below and y["only_price"] and x["letters"]:
            self.flush()
            self.out.append(self.dish(x, y["price"], x["with_price"]))
            return 2
        described = z is not None and not x["priced"] and not y["priced"] and z["priced"] and not y["header"] and not y["noise"]
        if described and not x["centred"] and not x["digit"] and not y["caps"] and len(x["clean"]) > 3 and len(y["text"]) > 3:
            self.flush()
            self.out.append(self.dish(x | {"fixed": x["clean"]}, z["price"], x["with_price"], y["text"]))
            return 3
        if x["priced"]:
            self.flush()
            if len(x["bare"]) >= 3 and not x["bare_noise"]:
                self.pending = self.dish(x | {"fixed": x["bare"]}, x["price"], x["with_price"])
            return 1
        if x["n_words"] <= 25 and x["ascii"] and len(x["clean"]) >= 3:
            self.unpriced(x)
        return 1

    def header(self, i: int, x: dict, y: dict | None, below: bool) -> int:
        mixed = not x["upper"]
        if self.price is None and self.started and mixed and below and x["real"]:
            self.pending = self.dish(x, y["price"], 0.6) | {"confidence": 0.6}
            return 2
        self.flush()
        if self.price is not None and mixed:
            if x["real"]:
                self.pending = self.dish(x, self.price, 0.6) | {"confidence": 0.6}
            self.price = None
            return 1
        self.price = None
        subtitle = y is not None and not y["priced"] and not y["header"] and not y["upper"] and y["subtitle"]
        if not self.started and (not x["section_like"] or subtitle):
            return 1
        self.started, self.category, self.category_at = True, x["title"], i
        return 1

    def unpriced(self, x: dict) -> None:
        loose = any(w in self.category.lower() for w in LOOSE_TITLES)
        enough = x["clean_words"] >= 2 or x["food_whole"]
        if enough and (x["food"] or (loose and x["clean_words"] >= 2)):
            self.flush()
            self.pending = self.dish(x | {"fixed": x["clean"]}, None, x["no_price"])
        elif self.pending and not self.pending["description"]:
            if x["clean_description"]:
                self.pending["description"] = x["clean"]
            elif x["n_words"] <= 6:
                self.pending["name"] += " " + x["clean"]
                self.pending["confidence"] = min(self.pending["confidence"] + 0.05, 1.0)


def _asked(line):
    """struct of what the scan of a column asks of a line (text, priced, centred, caps, layout), a struct. Values that several questions share are bound once."""
    bare_of = lambda c: t.clean_name(t.strip(F.regexp_replace(c, r"\s*[$€£¥]?\s*\d+(?:[.,]\d{1,2})?[\s.]*\z", "")))

    def asked(x, c, clean, bare, words, real_words):
        score = lambda priced, name: t.confidence(F.lit(priced), name, F.lit(""), x["centred"], x["caps"], x["layout"])
        caps_word = F.get(F.filter(words, lambda w: (F.length(w) >= 3) & t.is_upper(w) & t.among(F.lower(w), t.CATEGORY_TITLES)), F.lit(0))
        long = F.length(clean) >= 3
        return F.struct(
            c.rlike(LINE_ONLY_PRICE).alias("only_price"), t.is_noise(c).alias("noise"), c.rlike(r"^\d+(?:\.\d+)?\z").alias("number"), c.rlike(r"\d").alias("digit"), c.rlike("[a-zA-Z]{3,}").alias("ascii"),
            c.rlike(t.SIZE_VARIANT).alias("sizes"), t.strip(F.regexp_replace(c, SIZES, "")).alias("base"), F.replace(F.regexp_extract(c, r"\d+(?:[.,]\d{1,2})?", 0), F.lit(","), F.lit(".")).try_cast("double").alias("first"),
            clean.alias("clean"), F.substring(t.correct_ocr(clean), 1, 200).alias("fixed"), (long & ~t.is_noise(clean) & real_words).alias("real"), (long & real_words).alias("letters"), bare.alias("bare"), t.is_noise(bare).alias("bare_noise"),
            t.is_upper(c).alias("upper"), c.rlike(t.SUBTITLE).alias("subtitle"), (t.is_section(F.lower(c)) | t.is_upper(c)).alias("section_like"), t.header_category(c).alias("title"),
            F.when(c.rlike(r"\d"), caps_word).alias("caps_section"), F.size(words).alias("n_words"), F.size(t.words(clean)).alias("clean_words"), (t.food_count(clean) > 0).alias("food"), t.is_food(clean).alias("food_whole"),
            t.is_description(clean).alias("clean_description"), score(True, F.when(x["priced"], bare).otherwise(clean)).alias("with_price"), score(False, clean).alias("no_price"),
        )

    def named(x, c):
        return t.let(t.clean_name(c), lambda clean: t.let(bare_of(c), lambda bare: t.let(t.words(c), lambda words: t.let(t.real_words(clean), lambda real: asked(x, c, clean, bare, words, real)))))

    return t.let(line, lambda x: t.let(x["text"], lambda c: named(x, c)))


def _may_give(line, price):
    """Whether a line can make the scan of its column give a dish: it has a price, sizes or a food word, or may be a title under which food
    words are not asked for. A column without such a line gives none, whatever else its lines are (see _Column)."""
    loose = t.let(F.lower(line), lambda low: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in LOOSE_TITLES)))
    return price.isNotNull() | line.rlike(t.SIZE_VARIANT) | loose | (t.food_count(t.clean_name(line)) > 0)


def _column_features(lines: DataFrame, doc: str) -> DataFrame:
    column = Window.partitionBy(doc, "column")
    share, length = F.avg(F.col("priced").cast("double")).over(column), F.avg(F.length("text")).over(column)
    rows = lines.withColumn("_may", _may_give(F.col("text"), F.col("price")))
    rows = rows.withColumns({"layout": F.when(share < 0.15, "fastfood").when(length > 45, "descriptive").when(length < 25, "compact").otherwise("unknown"), "_may": F.max("_may").over(column)})
    rows = rows.filter("_may").drop("_may")
    return rows.withColumn("_asked", _asked(F.struct("text", "priced", "centred", "caps", "layout"))).select("*", "_asked.*").drop("_asked")


def parse_columns(lines: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Dishes of positioned lines (lines.text_lines with a `column`): columns interleave by place, names count once."""
    rows = _column_features(lines, doc)
    cells = F.sort_array(F.collect_list(F.struct("column", "y", "x", "line", "segment", *(c for c in rows.columns if c not in (doc, "column", "y", "x", "line", "segment")))))
    work = rows.groupBy(doc).agg(cells.alias("_cells"))

    def extract(d: dict) -> list[tuple]:
        columns: dict[int, list[dict]] = {}
        for x in d["_cells"]:
            x = dict(x)
            columns.setdefault(x["column"], []).append(x)
        dishes = sorted(((k, c, dish) for c in sorted(columns) for k, dish in enumerate(_Column(columns[c][0]["layout"]).scan(columns[c]))), key=lambda z: (z[0], z[1]))
        least, seen, out = _threshold([(None, z[2]["price"], None, z[2]["confidence"]) for z in dishes]), set(), []
        for k, _, dish in dishes:
            key = dish["name"].lower().strip()
            if len(key) < 3 or key in seen:
                continue
            seen.add(key)
            if dish["confidence"] >= least:
                out.append((k, dish["name"][:200], dish["description"][:500], dish["price"], dish["category"] or None, dish["confidence"]))
        return out

    items = _per_document(work, doc, ["_cells"], extract)
    name = t.strip(t.correct_ocr(F.col("name")))
    items = items.withColumn("name", name).filter((F.length("name") >= 3) & ~t.is_noise(F.concat("name", F.lit(" x"))) & t.real_words(F.col("name")))
    return items.withColumn("category", F.coalesce("category", t.category_of(F.col("name"))))


def smart_parse(words: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Dishes of positioned words."""
    from ladle.operators.lines import detect_columns, text_lines

    return parse_columns(detect_columns(text_lines(words, doc), doc), doc)


def paragraph_parse(words: DataFrame, doc: str = "doc_id", paragraph: str = "paragraph") -> DataFrame:
    """Dishes of words in paragraphs: each paragraph is a column of its own, in order."""
    from ladle.operators.lines import text_lines

    keyed = words.withColumn("_cell", F.struct(doc, paragraph))
    lines = text_lines(keyed.drop(doc, paragraph), "_cell").withColumns({doc: F.col(f"_cell.{doc}"), "column": F.col(f"_cell.{paragraph}")}).drop("_cell")
    return parse_columns(lines, doc)


def second_extractor(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """Dishes by additive line scores: sections give the category, up to two describing lines or a price line may follow a dish."""
    from ladle.operators.lines import score_line

    # A price anywhere in a line, and a line that is one.
    anywhere, alone = r"(?i)\$?\s*(\d+\.?\d*)\s*(?:USD)?", r"(?i)^\$?\s*(\d+\.?\d*)\s*(?:USD)?\z"
    number = lambda x, pattern: F.nullif(F.regexp_extract(x, pattern, 1), F.lit("")).try_cast("double")
    before = lambda x: F.regexp_replace(t.strip(F.when(x.rlike(anywhere), F.regexp_extract(x, r"(?i)^(.*?)\$?\s*\d", 1)).otherwise(x)), r"[,\-–— ]+\z", "")

    def cell(x, c):
        dish, numbered = c["kind"] == "dish", x.rlike(t.DIGIT)
        told = (x.alias("text"), c["kind"].alias("kind"), c["score"].alias("score"), F.when(c["kind"] == "section", c["title"]).alias("title"), c["priced"].alias("priced"), c["letters"].alias("letters"))
        return F.struct(*told, F.when(dish & numbered, number(x, anywhere)).alias("price"), F.when(numbered, number(x, alone)).alias("alone"), F.when(dish, before(x)).alias("name"))

    # of 60 characters and 29 letters or more, without a digit or bullet: 10 points at most, no title, and no text that describes a dish
    prose = lambda x: (F.length(x) >= 60) & ~x.rlike(r"\p{Nd}") & ~x.rlike(r"^[•·*\-–—]") & (F.length(F.regexp_replace(x, r"[^\p{L}]+", "")) > 28)
    blank = F.struct(*(F.lit(v).cast(kind).alias(k) for k, v, kind in (("text", "", "string"), ("kind", "garbage", "string"), ("score", 0, "int"), ("title", None, "string"), ("priced", False, "boolean"), ("letters", 0, "int"), ("price", None, "double"), ("alone", None, "double"), ("name", None, "string"))))
    asked = lambda x: F.when(prose(x), blank).otherwise(t.let(score_line(x), lambda c: cell(x, c)))
    lines = F.transform(F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), t.strip), lambda x: x != ""), asked)
    lines = t.let(lines, lambda found: F.when(F.exists(found, lambda x: x["kind"] == "dish"), found))

    def describes(x: dict) -> bool:
        weak = x["kind"] in ("description", "garbage") or (x["kind"] == "dish" and x["score"] < 25)
        return weak and x["letters"] > 6 and not x["priced"] and 3 < len(x["text"]) < 60

    def extract(d: dict) -> list[tuple]:
        rows, out, category, i = [dict(x) for x in (d["_lines"] if d["_lines"] is not None else ())], [], "menu", 0
        while i < len(rows):
            x = rows[i]
            i += 1
            if x["kind"] == "section":
                category = x["title"].lower()
            if x["kind"] != "dish":
                continue
            name, price = (x["name"] if len(x["name"] or "") >= 2 else x["text"]), x["price"]
            more = [y["text"] for y in rows[i : i + 2]] if all(map(describes, rows[i : i + 2])) else [y["text"] for y in rows[i : i + 1] if describes(y)]
            if more:
                i += len(more)
            elif i < len(rows) and price is None and rows[i]["alone"] is not None:
                price, i = rows[i]["alone"], i + 1
            out.append((len(out), name.strip()[:200] or "Menu Item", " ".join(more)[:500], price, category, round(x["score"] / 100, 2)))
        return out

    return _per_document(docs.withColumn("_lines", lines), doc, ["_lines"], extract)


def run_local(docs: DataFrame, doc: str, text: str, most: int | None = None) -> DataFrame:
    """Text in, dishes out: lines are cleaned, dishes extracted, prices far off made null, similar names merged, fused lines
    split; doc, _pos, part, name, description, price, category, confidence of all dishes, or of at most `most` of each document.

    doc tells documents apart; give each row a value of its own.
    """
    from ladle.operators.lines import basic_extract, clean_text

    return checked(basic_extract(clean_text(docs, doc, F.col(text)), doc, F.col("text"), most), doc, most)


#: The least confidence of a word, and what positions must bear to be trusted: words above a confidence.
LEAST_CONFIDENCE, SURE_CONFIDENCE, SURE_WORDS = 25, 50, 3


def _boxes(words):
    """Words of a reading (text, bbox, confidence) as placed words."""
    edge = lambda w, k: F.coalesce(w["bbox"][k].cast("double"), F.lit(0.0))
    return F.transform(
        F.coalesce(words.cast(TOLD), F.array().cast(TOLD)),
        lambda w: F.struct(F.coalesce(w["text"], F.lit("")).alias("text"), edge(w, "x0").alias("x"), edge(w, "y0").alias("y"), (edge(w, "x1") - edge(w, "x0")).alias("w"), (edge(w, "y1") - edge(w, "y0")).alias("h"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence")),
    )


def routed(readings: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """doc, clean (the text's lines that stay), cells (arrays of placed words) and parser of each reading.

    readings: doc, text, words and, as their reader gives them, paragraphs or blocks of paragraphs. parser: paragraph (two or
    more paragraphs with words, of which one has three), smart (more than three words of LEAST_CONFIDENCE whose places and
    confidence can be trusted), sequential (so many words without that, or a text of several blocks) or basic.
    """
    from ladle.operators.lines import cleaned

    nested = F.flatten(F.transform("blocks", lambda b: F.coalesce(b["paragraphs"], F.array())))
    filled = lambda paragraphs: F.filter(F.coalesce(paragraphs, F.array()), lambda p: (t.strip(F.coalesce(p["text"], F.lit(""))) != "") & (F.size(F.coalesce(p["words"], F.array())) > 0))
    direct = filled(F.col("paragraphs"))
    rows = readings.select(
        doc,
        cleaned(F.col(text))["text"].alias("clean"),
        F.filter(_boxes(F.col("words")), lambda w: w["confidence"] >= LEAST_CONFIDENCE).alias("_words"),
        F.transform(F.when(F.size(direct) > 0, direct).otherwise(filled(nested)), lambda p: _boxes(p["words"])).alias("_paragraphs"),
    )
    placed = F.exists("_words", lambda w: (w["x"] != 0) | (w["y"] != 0))
    sure = F.size(F.filter("_words", lambda w: w["confidence"] > SURE_CONFIDENCE)) >= SURE_WORDS
    many = F.size("_words") > 3
    parser = F.when((F.size("_paragraphs") >= 2) & F.exists("_paragraphs", lambda p: F.size(p) >= 3), "paragraph").when(many & placed & sure, "smart")
    parser = parser.when(many | (F.size(F.split("clean", r"\n\s*\n")) >= 2), "sequential").otherwise("basic")
    cells = F.when(F.col("parser") == "paragraph", F.col("_paragraphs")).when(F.col("parser") == "smart", F.array("_words"))
    return rows.withColumn("parser", parser).select(doc, "clean", cells.alias("cells"), "parser")


def placed_dishes(rows: DataFrame, doc: str) -> DataFrame:
    """Dishes of the cells of routed() readings: a paragraph is a column of its own, the words of a whole page may make two."""
    from ladle.operators.lines import detect_columns, text_lines

    words = rows.select(doc, "parser", F.posexplode("cells").alias("cell", "ws")).select(F.struct(F.col(doc).alias("doc"), "cell", (F.col("parser") == "paragraph").alias("own")).alias("_cell"), F.inline("ws"))
    lines = detect_columns(text_lines(words, "_cell"), "_cell")
    lines = lines.withColumns({doc: F.col("_cell.doc"), "column": F.when(F.col("_cell.own"), F.col("_cell.cell")).otherwise(F.col("column"))}).drop("_cell")
    return parse_columns(lines, doc)


def checked(items: DataFrame, doc: str, most: int | None = None) -> DataFrame:
    """Items (doc, ix, name, price, ...) with prices far off made null, similar names merged and fused lines split: all, or at most `most` of each doc, by _pos and part."""
    from ladle.operators.lines import split_items

    items = items.withColumn("_pos", F.col("ix").cast("long")).drop("ix")
    items = split_items(quality.greedy_dedup(quality.three_sigma_null(items, [doc], "price", small=True), doc))
    if most is None:
        return items
    place = Window.partitionBy(doc).orderBy("_pos", "part")
    return items.withColumn("_rn", F.row_number().over(place)).filter(F.col("_rn") <= most).drop("_rn")


def parse_readings(readings: DataFrame, doc: str, text: str = "text", most: int | None = None) -> DataFrame:
    """Readings in, dishes out (all, or at most `most` of each), each by the parser that its words and text allow: doc, parser,
    _pos, part, name, description, price, category, confidence.

    readings are read once: routed rows are written in a folder for each parser, and each parser reads its own. Null texts and words are
    empty. doc tells readings apart; give each row a value of its own.
    """
    from ladle.operators.lines import basic_extract

    rows = written("readings", routed(readings, doc, text), by=("parser",))
    of = lambda *parsers: rows.filter(F.col("parser").isin(*parsers))
    found = (placed_dishes(of("paragraph", "smart"), doc), sequential_parse(of("sequential"), doc, "clean", most), basic_extract(of("basic"), doc, F.col("clean"), most))
    # dishes are written before they are checked, as the rules of all parsers make too large a plan together
    items = written("dishes", *(f.select(doc, *(c.split()[0] for c in ITEM.split(", "))) for f in found))
    return checked(items, doc, most).join(rows.select(doc, "parser"), doc)


def register_parse_menu(spark) -> None:
    """SQL: SELECT * FROM parse_menu(text) gives ix, name and price of each line that ends with a price; lighter than the extractors."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ix INT, name STRING, price DOUBLE")
    class ParseMenu:
        def eval(self, text: str):
            import re

            for k, line in enumerate(x.strip() for x in (text or "").splitlines() if x.strip()):
                m = re.search(r"^(.*\S)\s+[$€£¥]?\s*(\d{1,3}(?:[.,]\d{1,2})?)[\s.]*$", line)
                if m:
                    yield k, m[1], float(m[2].replace(",", "."))

    spark.udtf.register("parse_menu", ParseMenu)
