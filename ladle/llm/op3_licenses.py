"""License scans: an exact set-similarity join of text blocks with license templates, on DataFrame operations only.

A block is a line, or, for a template of n words, any n words in a row, whatever line breaks stand between them. A template
matches a block that contains at least `threshold` of its distinct words. The words of all templates are
ordered by their frequency over all documents, rarest first. A pair that meets a template's least overlap a has its
first common word among the template's first |T| - a + 1 words (prefix filter) and among the block's first |B| - a + 1
template words; |B| >= a (length filter); and the words from there on must still suffice (positional filter). Survivors
are verified exactly. Windows are looked at only for templates that the whole text meets as if it were one block. Templates
are configuration, refused above `MAX_TEMPLATES`; their index is a literal of the plan, so documents are scanned in place
and nothing but word counts (one row a template word) is shuffled.

Beside the templates, fixed phrases are located as runs of whole words.

Defined results: null and empty texts have no words, no labels and score 0; repeated rows and null doc_ids give a row
each; an empty table gives an empty table; extra columns are ignored; texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import spread

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATES = 2_000
THRESHOLD = 0.9
#: Fixed values of the query's contract: phrase, label.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template(label: str, text: str) -> tuple[str, str]:
    """A template of a text: its words in lower case."""
    return label, " ".join(_WORD.findall(text.translate(str.maketrans(_UPPER, _LOWER))))


#: Well-known license statements, and the whole notices that stand in files. Statements of under ten words must stand whole
#: at this threshold.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("agpl", "gnu affero general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("reserved", "all rights reserved"),
    template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    template(
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
        this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
        COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES.""",
    ),
    template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS.""",
    ),
    template(
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
    ),
    template(
        "gpl",
        """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
        warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
    ),
)


def lower_ascii(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def spaced(lowered: Column) -> Column:
    """The words with one space before, between and after; "" if there are none."""
    joined = F.trim(F.regexp_replace(lowered, NOT_WORD, " "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def word_frequencies(docs: DataFrame, vocabulary: Sequence[str], text: str = "text") -> dict[str, int]:
    """In how many documents each word stands; at most one row a word reaches the driver."""
    words = F.split(spaced(lower_ascii(F.col(text))), " ")
    rows = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, vocabulary)), words)).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    return {r.w: r.n for r in rows}


def _overlap(size: int, threshold: float) -> int:
    return max(1, math.ceil(round(threshold * size, 9)))


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches for each document.

    score: 1 where a phrase stands, else the largest contained share of a matching template. matches: label and share of
    each match of a template in a line, and of the best window of a template whose label no line has with that share.
    """
    docs = spread(docs)
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"{len(templates)} templates; at most {MAX_TEMPLATES} are planned as literals")
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    frequency = word_frequencies(docs, vocabulary)
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
    sets = [sorted(set(t.split()), key=order.__getitem__) for _, t in templates]
    least = [_overlap(len(s), threshold) for s in sets]
    index: dict[str, list[tuple[int, int]]] = {}
    for k, s in enumerate(sets):
        for i, w in enumerate(s[: len(s) - least[k] + 1]):
            index.setdefault(w, []).append((k, i))
    fewest = min(least)

    ordered = F.array(*(F.lit(w) for w in sorted(vocabulary, key=order.__getitem__)))
    postings = F.create_map(*(x for w, e in index.items() for x in (F.lit(w), F.array(*(F.struct(F.lit(k).alias("t"), F.lit(i).alias("i"), F.lit(len(sets[k])).alias("size"), F.lit(least[k]).alias("least")) for k, i in e)))))
    words_of = F.array(*(F.array(*map(F.lit, s)) for s in sets))
    label_of = F.array(*(F.lit(label) for label, _ in templates))

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lower_ascii(F.col("text").cast("string")).alias("_low"))
    d = d.withColumn("_c", spaced(F.col("_low")))
    c = F.col("_c")
    d = d.withColumn("n_words", F.greatest(_spaces(c) - 1, F.lit(0)).cast("long"))
    phrase = [f" {p} " for p, _ in phrases]
    d = d.withColumn("_has", F.array(*(F.contains(c, F.lit(p)) for p in phrase)))
    # a document without any indexed word has no block that matches
    d = d.withColumn("_maybe", c.rlike(" (?:" + "|".join(sorted(index)) + ") "))

    def fetched_of(b: Column) -> Column:
        """The templates that a block meets, and the number of common words."""
        fetched = F.flatten(
            F.transform(
                F.slice(b, F.lit(1), F.size(b) - fewest + 1),
                lambda w, j: F.transform(
                    F.filter(F.coalesce(postings[w], F.array().cast("array<struct<t:int,i:int,size:int,least:int>>")), lambda e: (F.size(b) >= e["least"]) & (F.least(e["size"] - e["i"], F.size(b) - j) >= e["least"])),
                    lambda e: e["t"],
                ),
            )
        )
        verified = F.transform(F.array_distinct(fetched), lambda t: F.struct(t.alias("t"), F.size(F.array_intersect(F.element_at(words_of, t + 1), b)).alias("n")))
        return F.filter(verified, enough)

    sizes, leasts, lengths = F.array(*(F.lit(len(s)) for s in sets)), F.array(*map(F.lit, least)), F.array(*(F.lit(len(t.split())) for _, t in templates))
    enough = lambda v: v["n"] >= F.element_at(leasts, v["t"] + 1)

    def matches_of(found: Column) -> Column:
        return F.transform(found, lambda v: F.struct(F.element_at(label_of, v["t"] + 1).alias("label"), (v["n"].cast("double") / F.element_at(sizes, v["t"] + 1)).alias("share")))

    def in_block(b: Column) -> Column:
        return matches_of(fetched_of(b))

    def best_window(words: Column, t: Column) -> Column:
        """The template and the most of its words in a window of its length; windows begin with one of its words."""
        own = F.element_at(words_of, t + 1)
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(own, w), i + 1)), lambda i: i.isNotNull())
        return F.struct(t.alias("t"), F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect(own, F.slice(words, i, F.element_at(lengths, t + 1)))))).alias("n"))

    def in_windows(words: Column) -> Column:
        return matches_of(F.filter(F.transform(bind(F.array_intersect(ordered, words), fetched_of), lambda v: best_window(words, v["t"])), enough))

    blocks = F.filter(F.transform(F.split(F.col("_low"), "\n"), lambda line: F.array_intersect(ordered, F.split(F.trim(F.regexp_replace(line, NOT_WORD, " ")), " "))), lambda b: F.size(b) >= fewest)
    none = F.array().cast("array<struct<label:string,share:double>>")
    d = d.withColumn("_blocks", F.when(F.col("_maybe"), blocks)).withColumn("_lines", F.when(F.size("_blocks") > 0, F.flatten(F.transform("_blocks", in_block))).otherwise(none))
    # within one line, a line has what its windows have
    d = d.withColumn("_windows", F.when(F.col("_maybe") & F.contains("_low", F.lit("\n")), bind(F.split(F.trim("_c"), " "), in_windows)).otherwise(none))
    more = F.filter("_windows", lambda x: ~F.exists("_lines", lambda y: (y["label"] == x["label"]) & (y["share"] >= x["share"])))
    d = d.withColumn("matches", F.concat("_lines", more))

    counts, firsts, lasts = [], [], []
    doubled, back = F.replace(c, F.lit(" "), F.lit("  ")), F.reverse(c)
    for k, p in enumerate(phrase):
        wide = p.strip().replace(" ", "  ")
        wide, size, has = f" {wide} ", len(p.split()), F.col("_has")[k]
        counts.append(F.when(has, (F.length(doubled) - F.length(F.replace(doubled, F.lit(wide), F.lit("")))) / len(wide)).otherwise(0).cast("long"))
        firsts.append(F.when(has, _spaces(F.substring(c, F.lit(1), F.instr(c, p))) - 1))
        lasts.append(F.when(has, F.col("n_words") - size - (_spaces(F.substring(back, F.lit(1), F.instr(back, p[::-1]))) - 1)))
    base = F.array_compact(F.array(*(F.when(F.col("_has")[k], F.lit(label)) for k, (_, label) in enumerate(phrases))))
    d = d.withColumn("n_base", sum(counts[1:], counts[0])).withColumn("_base", F.array_sort(F.array_distinct(base)))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("_base"), F.transform("matches", lambda m: m["label"]))))
    return d.select(
        "doc_id",
        "n_words",
        "n_base",
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))).alias("score"),
        "matches",
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("matches")


def _sql() -> str:
    low = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
    words = lambda x: f"list_filter(string_split(regexp_replace({x}, '{NOT_WORD}', ' ', 'g'), ' '), lambda v: v <> '')"
    rows = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))!r}, {len(set(t.split()))}, {_overlap(len(set(t.split())), THRESHOLD)})" for k, (label, t) in enumerate(TEMPLATES))
    starts = " || ".join(f"list_filter(range(1, len(w) + 1), lambda i: w[i : i + {len(p.split()) - 1}] = {p.split()!r})" for p, _ in PHRASES)
    base = ", ".join(f"CASE WHEN contains(' ' || array_to_string(w, ' ') || ' ', ' {p} ') THEN '{label}' END" for p, label in PHRASES)
    return f"""
WITH t(id, label, tokens, size, least) AS (VALUES {rows}),
d AS (SELECT row_number() OVER () AS k, doc_id, {low} AS low, {words(low)} AS w FROM documents),
m AS (
  SELECT k, list(DISTINCT label) AS own, max(n / size) AS share
  FROM (SELECT k, label, size, least, len(list_intersect(tokens, {words('line')})) AS n
        FROM (SELECT k, unnest(string_split(low, chr(10))) AS line FROM d), t)
  WHERE n >= least GROUP BY k),
b AS (SELECT k, doc_id, len(w) AS n_words, {starts} AS starts, list_filter([{base}], lambda v: v IS NOT NULL) AS base FROM d)
SELECT doc_id, n_words, len(starts) AS n_base, list_min(starts) - 1 AS first_word, list_max(starts) - 1 AS last_word,
       array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(base || coalesce(own, []))), ',') AS labels,
       CASE WHEN len(starts) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN m USING (k)"""


SQL = _sql()
