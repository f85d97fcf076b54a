"""Source divergence audit: how far the sources of a language lie apart, and by which terms, by a frequent-pattern tree.

A term's row lists the sources of a language that have it, in order of their names, with their counts. Every pair of sources needs
the sum over all terms of f(p, q) = floor((p - q)^2 / (p + q)). Written out by what is nonzero,

    sum = V * f(0, 0) + sum over a's terms of f(p, 0) - f(0, 0) + the same over b's + sum over common terms of
          f(p, q) - f(p, 0) - f(0, q) + f(0, 0)            (0: the share of a term that does not occur)

only the last part needs pairs. Rows are inserted into a prefix tree whose nodes are (source, count) with multiplicities, and each
combination of a node and an ancestor of it adds its correction once, times the node's multiplicity. A task holds the
tree of at most `ENTRIES` counts (and one row) at a time and emits sums per pair, which are added up by Spark. The two parts of single sources
need one row for each distinct count of a source.

Counts per language, source and term are all that is shuffled of the texts. Group totals are joined to them, by broadcast only below Spark's
size threshold. The report has a row for each pair of sources of a language, so their number bounds a term's row.
Arithmetic is exact: shares are divided as decimals, all else fits 64 bits.

Defined results: null text, lang and source are read as ''; a group without kept terms has pair rows of value 0 and no term
rows; a language of one source has no pair rows; repeated rows count again; doc_ids are not read, so null ids are documents like others; bytes that
are no UTF-8 become U+FFFD; empty tables give an empty table; extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.common import SALTS, materialize, rows_of

SCALE, LEAST_DOCS, TOP = 1_000_000_000, 10, 10
ENTRIES, HELD_TERMS = 500_000, 300_000
_TERMS = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); one row of null term for each (lang, source) and task.

    Each task adds up its rows and lets go of what it holds at HELD_TERMS terms.
    """
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        size = 0

        def release() -> pa.RecordBatch:
            rows = [(*group, None, 0, 0) for group in held]
            rows += [(*group, term, n, docs[term]) for group, (count, docs) in held.items() for term, n in count.items()]
            held.clear()
            text = lambda v: None if v is None else v.decode("utf-8", "replace")
            return pa.record_batch([pa.array([text(v) if i < 3 else v for v in c], f.type) for i, (c, f) in enumerate(zip(zip(*rows, strict=True), schema, strict=True))], schema=schema)

        for text, lang, source in rows_of(batches, "text", "lang", "source"):
            count, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(count)
            found = Counter(text.translate(_TERMS).split())
            count.update(found)
            docs.update(found.keys())
            size += len(count) - before
            if size >= HELD_TERMS:
                yield release()
                size = 0
        if held:
            yield release()

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = docs.select(blank("text"), blank("lang"), blank("source")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 * (count + 2) / (total + 2 * terms)); null where nothing is kept."""
    of = total + 2 * terms
    return F.when(of > 0, F.call_function("div", F.lit(Decimal(SCALE)) * (count + 2), of) + 1)


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def build_tree(lengths: np.ndarray, items: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The prefix tree of rows of items, level by level: item, parent (a node of the level before) and multiplicity of each node."""
    starts, width = np.cumsum(lengths) - lengths, int(items.max()) + 1 if len(items) else 1
    rows, at, levels = np.arange(len(lengths)), np.zeros(len(lengths), np.int64), []
    for depth in range(int(lengths.max()) if len(lengths) else 0):
        on = lengths[rows] > depth
        rows, at = rows[on], at[on]
        key, at, n = np.unique(at * width + items[starts[rows] + depth], return_inverse=True, return_counts=True)
        levels.append((key % width, key // width, n))
    return levels


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def tree_sums(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]], group: np.ndarray, p: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of groups (as first * 2^32 + second) and their summed corrections: one term for each node and ancestor.

    group, p, none: of each item, its group, its share and the share of a term that does not occur there.
    """
    keys, sums, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0

    def add_up() -> tuple[np.ndarray, np.ndarray]:
        pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, place, np.concatenate(sums))
        return pairs, total

    for depth in range(1, len(levels)):
        item, ancestor, n = levels[depth]
        for above in range(depth - 1, -1, -1):
            other = levels[above][0][ancestor]
            keys.append((group[other] << 32) + group[item])
            sums.append(n * (_apart(p[item], p[other]) - _apart(p[item], none[other]) - _apart(none[item], p[other]) + _apart(none[item], none[other])))
            held += len(item)
            if held > 4 * ENTRIES:
                pairs, total = add_up()
                keys, sums, held = [pairs], [total], 0
            ancestor = levels[above][1][ancestor]
    return add_up()


def pair_corrections(rows: DataFrame) -> DataFrame:
    """lang, source, item, value: sums over the terms that both sources have, of term rows (lang, entries: source, p, none)."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])

    def of_tree(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        entries = table.column("entries").combine_chunks()
        lengths = np.asarray(entries.value_lengths(), np.int64)
        flat = entries.flatten()
        langs = table.column("lang").combine_chunks().dictionary_encode()
        names = flat.field("source").dictionary_encode()
        lang, source = np.repeat(np.asarray(langs.indices, np.int64), lengths), np.asarray(names.indices, np.int64)
        groups, group = np.unique((lang << 32) + source, return_inverse=True)
        shares = np.asarray(flat.field("p"), np.int64)
        codes, first, item = np.unique((group << 31) + shares, return_index=True, return_inverse=True)  # a share is below 2^31
        pairs, total = tree_sums(build_tree(lengths, item), codes >> 31, shares[first], np.asarray(flat.field("none"), np.int64)[first])
        a, b = groups[pairs >> 32], groups[pairs & 0xFFFFFFFF]
        name = lambda g: names.dictionary.take(pa.array(g & 0xFFFFFFFF))
        return pa.record_batch([langs.dictionary.take(pa.array(a >> 32)), name(a), name(b), pa.array(total)], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(1).flatten())
            if size >= ENTRIES:
                yield of_tree(held)
                held, size = [], 0
        if held:
            yield of_tree(held)

    return rows.mapInArrow(run, "lang string, source string, item string, value long")


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank: the report of all groups; top: terms of a group."""
    counts = materialize(term_counts(docs), "op12-counts")
    terms = counts.filter(F.col("term").isNotNull())
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs).drop("docs")
    cells = materialize(terms.select("lang", "term", "source", "n").join(kept, ["lang", "term"]), "op12-cells")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0)
    groups = materialize(groups.withColumn("none", share(F.lit(0), F.col("total"), F.col("terms"))), "op12-groups")

    shared = cells.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    common = pair_corrections(shared.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "p", "none"))).alias("entries")).select("lang", "entries"))
    single = shared.groupBy("lang", "source", "p", "none").agg(F.count("*").alias("n"))
    left = single.unionByName(groups.select("lang", "source", F.lit(None).cast("long").alias("p"), "none", F.col("terms").alias("n")))
    right = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("none_item"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    met = left.withColumn("_salt", F.pmod(F.xxhash64("source", "p"), F.lit(SALTS)).cast("int")).join(right, ["lang", "_salt"]).filter("source <> item")
    nothing = distance(F.col("none"), F.col("none_item"))
    parts = met.groupBy("lang", "source", "item").agg(
        F.sum(F.when(F.col("p").isNull(), F.col("n") * F.coalesce(nothing, F.lit(0))).otherwise(0)).alias("base"),
        F.sum(F.when(F.col("p").isNull(), 0).otherwise(F.col("n") * (distance(F.col("p"), F.col("none_item")) - nothing))).alias("single"),
    )
    both = lambda there, back: F.explode(F.array(F.struct("source", "item", there.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), back.alias("value"))))
    sums = parts.select("lang", both(F.col("base") + F.col("single"), F.col("single")).alias("x")).unionAll(common.select("lang", both(F.col("value"), F.col("value")).alias("x")))
    pairs = sums.groupBy("lang", "x.source", "x.item").agg(F.sum("x.value").alias("value"))

    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    above = shared.select("lang", "source", F.col("term").alias("item"), "p", q.alias("q")).filter("p > q").select("lang", "source", "item", distance(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda rows, part: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))).withColumn("part", F.lit(part))
    found = ranked(pairs, "pair").unionByName(ranked(above, "term").filter(F.col("rank") <= top))
    return found.select("lang", "source", "part", "item", "value", "rank")


def op12_divergence(spark, sf_dir: str) -> DataFrame:
    return divergences(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
u AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM u GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM u GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT lang, g.source, term, coalesce(c.n, 0) AS n, kept.n AS n_lang
          FROM grp g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n) AS total, sum(n_lang) AS total_lang, count(*) AS v FROM dense GROUP BY ALL),
p AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + 2)) // (total + 2 * v) AS p, 1 + ({SCALE}::HUGEINT * (n_lang + 2)) // (total_lang + 2 * v) AS q
      FROM dense JOIN tot USING (lang, source)),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
          FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                     FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
            ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {TOP}"""
