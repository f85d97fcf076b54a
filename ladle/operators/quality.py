"""Set-level quality: thresholds, outliers, duplicates, best readings, fuzzy gates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators.similar import similar_pairs


def menu_layout(lines: Column) -> Column:
    """Layout of array<struct(text, has_price)>: few prices are fast food, long lines descriptive, short ones compact."""
    n = F.size(lines)
    share = F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.when(x["has_price"], 1.0).otherwise(0.0)) / n
    length = F.aggregate(lines, F.lit(0.0), lambda s, x: s + F.length(x["text"])) / n
    return F.when(n == 0, "unknown").when(share < 0.15, "fastfood").when(length > 45, "descriptive").when(length < 25, "compact").otherwise("unknown")


def text_layout(text: Column) -> Column:
    """struct(price_ratio, avg_line_len, layout) of a text's lines that are not blank."""
    lines = F.filter(F.split(text, "\n"), lambda x: t.strip(x) != "")
    n = F.size(lines)
    priced = F.size(F.filter(lines, lambda x: x.rlike(r"\$\s*\d|\d+\.\d{2}")))
    length = F.aggregate(lines, F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    ratio = F.when(n == 0, 0.0).otherwise(F.try_divide(priced.cast("double"), n))
    mean = F.when(n == 0, 0.0).otherwise(F.try_divide(length.cast("double"), n))
    layout = F.when(ratio < 0.15, "fastfood").when(mean > 45, "descriptive").otherwise("compact")
    return F.struct(ratio.alias("price_ratio"), mean.alias("avg_line_len"), layout.alias("layout"))


def upper_median(values: Column) -> Column:
    """The element at n // 2 of the sorted array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def threshold_of(n: Column, priced: Column, mean: Column, median: Column) -> Column:
    """The least confidence of a document's rows, from their number, share of prices, mean and upper median."""
    ratio = F.try_divide(priced.cast("double"), n)
    return (
        F.when(n == 0, 0.3)
        .when(n <= 3, 0.2)
        .when(ratio > 0.7, F.greatest(F.lit(0.35), mean * 0.7))
        .when(ratio < 0.2, F.least(F.lit(0.25), median * 0.8))
        .otherwise(F.greatest(F.lit(0.2), mean * 0.6))
    )


def adaptive_threshold(rows: DataFrame, doc: str, confidence: str = "confidence", price: str = "price") -> DataFrame:
    """threshold by document. percentile_disc-like upper median by rank, so no document's rows are collected into one cell."""
    w = Window.partitionBy(doc)
    ranked = rows.select(doc, F.col(confidence).alias("c"), F.col(price).alias("p")).withColumn("n", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy("c")))
    g = ranked.groupBy(doc).agg(F.count("*").alias("n"), F.count("p").alias("priced"), F.avg("c").alias("mean"), F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("c"))).alias("median"))
    return g.select(doc, threshold_of(F.col("n"), F.col("priced"), F.col("mean"), F.col("median")).alias("threshold"))


def above_threshold(rows: DataFrame, doc: str) -> DataFrame:
    return rows.join(adaptive_threshold(rows, doc), doc).filter("confidence >= threshold").drop("threshold")


def three_sigma_null(rows: DataFrame, keys: Sequence[str], value: str, least: int = 3, small: bool = False) -> DataFrame:
    """Values over three population deviations from their group's mean become null, in groups of at least `least` values.

    Statistics are pre-aggregated and joined back, so a group of any size is never held by one task; the rows are made twice for
    that. Groups told to be small (a document's dishes) come together instead, and their rows are made once.
    """
    if small:
        group = Window.partitionBy(*keys)
        n, mean, three = F.count(value).over(group), F.avg(value).over(group), 3 * F.stddev_pop(value).over(group)
        far = (n >= least) & ((F.col(value) < mean - three) | (F.col(value) > mean + three))
        return rows.withColumn("_far", far).withColumn(value, F.when(F.col("_far"), None).otherwise(F.col(value))).select(*rows.columns)
    stats = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    far = (F.col("_n") >= least) & ((F.col(value) < F.col("_m") - 3 * F.col("_s")) | (F.col(value) > F.col("_m") + 3 * F.col("_s")))
    return rows.join(stats, list(keys)).withColumn(value, F.when(far, None).otherwise(F.col(value))).select(*rows.columns)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def name_words(name: Column) -> Column:
    return F.array_distinct(F.split(F.lower(name), r"(?U)\s+"))


def similar_texts(rows: DataFrame, block: str, key: str, text: str, least: float = 0.7, heavy: int | Sequence[int] = 200_000) -> DataFrame:
    """similar_pairs of texts, as the sets of all their words."""
    return similar_pairs(rows, block, key, t.words(F.lower(text)), least, heavy)


def greedy_dedup(rows: DataFrame, doc: str, order: str = "_pos", name: str = "name", least: float = 0.7) -> DataFrame:
    """In order, each row absorbs later rows of similar names; the shortest name of them stays, at the first one's place.

    The choice depends on the order, so it is a fold over each document's names; a document's rows are few (a menu). Names meet
    on a word of their prefix (all but least * n words, rare ones first), as in similar_pairs.
    """

    def fold(names: list[str | None]) -> list[dict[str, int]]:
        sets = [set((x or "").lower().split()) or {""} for x in names]
        count = Counter(word for s in sets for word in s)
        # the epsilon keeps least * n from being rounded up past a whole number
        firsts = [sorted(s, key=lambda w: (count[w], w))[: len(s) - math.ceil(least * len(s) - 1e-9) + 1] for s in sets]
        index: dict[str, list[int]] = {}
        for k, first in enumerate(firsts):
            for word in first:
                index.setdefault(word, []).append(k)
        used, kept = [False] * len(sets), []
        for i, s in enumerate(sets):
            if used[i]:
                continue
            best = i
            for j in sorted({j for word in firsts[i] for j in index[word] if j > i and not used[j]}):
                common = len(s & sets[j])
                if common / (len(s) + len(sets[j]) - common) >= least:
                    used[j] = True
                    best = j if len(names[j] or "") < len(names[best] or "") else best
            kept.append({"place": i, "best": best})
        return kept

    @F.pandas_udf("array<struct<place:int,best:int>>")
    def folded(names: pd.Series) -> pd.Series:
        return pd.Series([fold(list(x)) for x in names], dtype=object)

    others = [c for c in rows.columns if c not in (doc, order)]
    cells = F.sort_array(F.collect_list(F.struct(F.col(order).isNull().alias("_last"), order, *others)))
    work = rows.groupBy(doc).agg(cells.alias("_rows")).withColumn("_kept", folded(F.transform("_rows", lambda x: x[name])))
    kept = F.transform("_kept", lambda k: F.struct(F.get("_rows", k["place"])[order].alias(order), *(F.get("_rows", k["best"])[c].alias(c) for c in others)))
    return work.select(doc, F.inline(kept)).select(*rows.columns)


def best_candidate(candidates: DataFrame, doc: str = "doc_id", deskewed: int = 0) -> DataFrame:
    """The best reading of each document; without a fit one, the first that has any words.

    Columns: ix, text, word_count, alpha_word_count, avg_conf, has_words, is_rapid. Fit: at least 3 words of letters and a
    mean confidence of 40.
    """
    score = F.col("alpha_word_count") * 10 + F.col("word_count") + F.col("avg_conf") / 10 + F.when(F.col("has_words"), 25).otherwise(0) + t.count_price_lines(F.col("text")) * 4
    score = score + F.when(F.col("ix") < deskewed, 1).otherwise(0) + F.when(F.col("is_rapid"), 2).otherwise(0)
    fit = (F.col("alpha_word_count") >= 3) & (F.col("avg_conf") >= 40)
    ranked = candidates.withColumn("score", score)
    # pre-aggregated: of a document's readings one a task is shuffled
    place = F.struct(~fit, F.when(fit, -F.col("score")), F.col("word_count") <= 0, "ix")
    best = F.min_by(F.struct(*(c for c in ranked.columns if c != doc)), place)
    return ranked.groupBy(doc).agg(best.alias("_b")).select(doc, "_b.*")


def best_parse(parsed: DataFrame, doc: str, candidate: str, base: str, price: str = "price") -> DataFrame:
    """The candidate of each document with the most priced items; the base one (a boolean column) unless another has more."""
    g = parsed.groupBy(doc, candidate).agg(F.count(price).alias("priced"), F.count("*").alias("items"), F.max(base).alias("is_base"))
    w = Window.partitionBy(doc).orderBy(F.desc("priced"), F.desc("is_base"), candidate)
    return g.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def needs_rescue(parsed: DataFrame, doc: str, items: int = 3, priced: int = 2, price: str = "price") -> DataFrame:
    """Documents whose parse has too few items or prices, for which another reading should be made."""
    return parsed.groupBy(doc).agg(F.count("*").alias("items"), F.count(price).alias("priced")).filter((F.col("items") < items) | (F.col("priced") < priced))


def rescue_pick(parsed: DataFrame, extra: DataFrame, doc: str, candidate: str, base: str, price: str = "price") -> DataFrame:
    """best_parse, with an extra reading (the items of one more candidate) for documents whose base parse has too little."""
    need = needs_rescue(parsed.filter(base), doc, price=price).select(doc)
    return best_parse(parsed.unionByName(extra.join(need, doc, "left_semi")), doc, candidate, base, price)


def weighted_confidence(lines: DataFrame, doc: str, confidence: str = "conf", weight: Column | None = None) -> DataFrame:
    """doc, confidence: the mean confidence of a reading's lines in percent, weighted (by default all alike); 0 without weight."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    mean = F.try_divide(F.sum(F.coalesce(F.col(confidence), F.lit(0.0)) * w), F.sum(w))
    return lines.groupBy(doc).agg((F.coalesce(mean, F.lit(0.0)) * 100).alias("confidence"))


def best_strategy(parsed: DataFrame, doc: str, strategy: str, confidence: str = "confidence") -> DataFrame:
    """Most items, then the highest mean confidence."""
    g = parsed.groupBy(doc, strategy).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean"))
    return g.groupBy(doc).agg(F.max_by(F.struct(strategy, "n", "mean"), F.struct("n", "mean")).alias("b")).select(doc, "b.*")


def best_mode(readings: DataFrame, doc: str, mode: str, alpha: str, least: int = 3) -> DataFrame:
    """The segmentation mode with the most words of letters, where there are at least `least`."""
    return readings.groupBy(doc).agg(F.max_by(F.col(mode), F.struct(F.col(alpha), -F.col(mode))).alias(mode), F.max(alpha).alias(alpha)).filter(F.col(alpha) >= least)


#: Least items of each layer of recognition, and the confidence of its result and items.
LAYERS = ((1, 2, 50, 0.5), (2, 2, 60, 0.6), (3, 1, 85, 0.9))


def cascade(items: DataFrame, docs: DataFrame, doc: str = "doc_id", layer: str = "layer") -> DataFrame:
    """doc, layer and confidence of the first layer with enough items; "failed" where none has."""
    g = items.groupBy(doc, layer).agg(F.count("*").alias("n"))
    enough = F.lit(False)
    level = F
    for number, least, confidence, _ in LAYERS:
        enough = enough | ((F.col(layer) == number) & (F.col("n") >= least))
        level = level.when(F.col("l") == number, confidence)
    first = g.filter(enough).groupBy(doc).agg(F.min(layer).alias("l"))
    return docs.select(doc).distinct().join(first, doc, "left").select(doc, F.coalesce(F.col("l").cast("string"), F.lit("failed")).alias("layer"), F.coalesce(level.otherwise(0), F.lit(0)).alias("confidence"))


def close(a: Column, b: Column, most: int = 1) -> Column:
    """Words within `most` edits; lengths are compared first."""
    return (a == b) | ((F.abs(F.length(a) - F.length(b)) <= most) & (F.levenshtein(a, b, most) >= 0))


def names_match(a: Column, b: Column) -> Column:
    """Equal names, or every word of the shorter one close to a word of the longer."""
    na, nb = t.norm_name(a), t.norm_name(b)
    wa, wb = F.split(na, " "), F.split(nb, " ")
    inside = lambda x, y: F.forall(x, lambda p: F.exists(y, lambda q: close(p, q)))
    return (na != "") & (nb != "") & ((na == nb) | F.when(F.size(wa) <= F.size(wb), inside(wa, wb)).otherwise(inside(wb, wa)))


def _variants(word: Column) -> Column:
    """A word and what is left of it without one character: words within one edit share one of them."""
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1))), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), cut))


def fuzzy_pairs(names: DataFrame, name: str) -> DataFrame:
    """a, b: distinct names of which one is before the other and that match (names_match).

    The first word of the shorter name is close to a word of the longer, so they share a variant: an equi-join finds all
    candidates.
    """
    n = names.select(F.col(name).alias("name")).filter(F.col(name).isNotNull()).distinct().withColumn("w", F.split(t.norm_name(F.col("name")), " "))
    n = n.filter(F.get("w", F.lit(0)) != "")
    short = n.select(F.col("name").alias("s"), F.size("w").alias("ns"), F.explode(_variants(F.get("w", F.lit(0)))).alias("v"))
    long = n.select(F.col("name").alias("l"), F.size("w").alias("nl"), F.explode(F.array_distinct(F.flatten(F.transform("w", lambda x: _variants(x))))).alias("v"))
    pairs = short.join(long, "v").filter((F.col("ns") <= F.col("nl")) & (F.col("s") != F.col("l"))).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).distinct()
    return pairs.filter(names_match(F.col("a"), F.col("b")))


def _long_words(c: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9&']+"), lambda w: F.length(w) >= least))


def grounded(name: Column, raw: Column) -> Column:
    """Whether every longer word of a name is close to a word of the raw text."""
    words, known = _long_words(name), _long_words(raw)
    return (F.size(words) > 0) & F.forall(words, lambda w: F.array_contains(known, w) | F.exists(known, lambda k: close(k, w)))


def is_junk_name(name: Column) -> Column:
    n = t.norm_name(name)
    return (n == "") | t.is_section(n) | t.is_noise(name)


DISHES = "array<struct<name:string,price:string,category:string>>"


def dish_array(answer: Column, raw: Column | None = None) -> Column:
    """array<struct(name, price, category)> of the JSON array in a model's answer: only real, grounded, priced dishes."""
    start = F.instr(answer, "[")
    end = F.length(answer) - F.instr(F.reverse(answer), "]") + 1
    body = F.when((start > 0) & (end > start), F.substring(answer, start, end - start + 1))
    parsed = F.coalesce(F.from_json(body, DISHES), F.array().cast(DISHES))
    tidy = F.transform(
        F.filter(parsed, lambda d: d.isNotNull()),
        lambda d: F.struct(
            F.substring(t.strip(d["name"]), 1, 200).alias("name"),
            F.when(F.regexp_replace(d["price"], ",", "").rlike(r"^\d+(?:\.\d{1,2})?\z"), F.regexp_replace(d["price"], ",", "").try_cast("double")).alias("price"),
            F.nullif(t.strip(d["category"]), F.lit("")).alias("category"),
        ),
    )
    ok = lambda d: (F.coalesce(d["name"], F.lit("")) != "") & d["price"].isNotNull() & t.real_words(d["name"], "[a-zA-Z]") & ~is_junk_name(d["name"]) & (grounded(d["name"], raw) if raw is not None else F.lit(True))
    return F.filter(tidy, ok)


def accept_list(old: DataFrame, new: DataFrame, doc: str, key: str = "_pos") -> DataFrame:
    """doc, accepted: the new list replaces the old one if it is not empty, has as many prices, and matches every old name."""
    counts = old.groupBy(doc).agg(F.count("price").alias("old_priced")).join(new.groupBy(doc).agg(F.count("*").alias("n"), F.count("price").alias("new_priced")), doc, "left")
    o, n = old.select(doc, F.col(key).alias("k"), F.col("name").alias("a")), new.select(doc, F.col("name").alias("b"))
    met = o.join(n, doc).filter(names_match(F.col("a"), F.col("b"))).select(doc, "k").distinct()
    lost = o.join(met, [doc, "k"], "left_anti").select(doc).distinct().withColumn("lost", F.lit(True))
    fine = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("new_priced", F.lit(0)) >= F.col("old_priced")) & F.col("lost").isNull()
    return counts.join(lost, doc, "left").select(doc, fine.alias("accepted"))


def chunks(text: Column, most: int = 6000) -> Column:
    """Lines packed in order into pieces of at most `most` characters (a longer line is a piece of its own)."""
    start = F.array(F.lit("")).cast("array<string>")

    def add(acc: Column, line: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = F.length(last) + F.length(line) + 1 <= most
        head = F.slice(acc, F.lit(1), F.size(acc) - 1)
        return F.when(last == "", F.array_append(head, line)).when(fits, F.array_append(head, F.concat(last, F.lit("\n"), line))).otherwise(F.array_append(acc, line))

    return F.filter(F.aggregate(F.split(text, "\n"), start, add), lambda c: c != "")


def estimate_skew(boxes: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, theta: a page's angle in degrees from its text boxes (x0, y0, x1, y1), 0 if it is unclear.

    In four rounds the upper median height of narrow boxes, less what the angle adds to it, gives the line height, and the
    upper median angle of wide boxes the angle.
    """

    def upper_median(v: np.ndarray) -> float:
        return float(np.sort(v)[len(v) // 2])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h, theta = (pdf.x1 - pdf.x0).to_numpy(float), (pdf.y1 - pdf.y0).to_numpy(float), 0.0
        narrow, wide = w < 90, w >= 120
        for _ in range(4):
            if len(pdf) < 6 or narrow.sum() < 2 or wide.sum() < 3:
                break
            angle = np.radians(theta)
            line = upper_median(h[narrow] - w[narrow] * np.sin(angle))
            slope = np.clip((h[wide] - line * np.cos(angle)) / w[wide], -0.35, 0.35)
            theta = upper_median(np.degrees(np.arcsin(slope)))
        return pd.DataFrame({doc: [pdf[doc].iloc[0]], "theta": [theta if 1 <= abs(theta) <= 14 else 0.0]})

    return boxes.groupBy(doc).applyInPandas(fold, f"{doc} {boxes.schema[doc].dataType.simpleString()}, theta double")


def filter_words(words: DataFrame, doc: str = "doc_id", confidence: str = "confidence") -> DataFrame:
    """Words above a limit that falls with the document's mean confidence (25, 10, 5); all, where fewer than 3 are left."""
    w = Window.partitionBy(doc)
    limit = F.when(F.avg(confidence).over(w) > 30, 25).when(F.avg(confidence).over(w) > 15, 10).otherwise(5)
    kept = words.withColumn("_ok", F.col(confidence) > limit)
    return kept.withColumn("_left", F.count_if("_ok").over(w)).filter(F.col("_ok") | (F.col("_left") < 3)).drop("_ok", "_left")


