"""Document fingerprints: closed syncmers of words with their positions, on DataFrame operations only.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. Of the windows of `K` words (k-mers), those are
chosen whose least inner window of `S` words (by MD5) stands at either edge: whether a k-mer is chosen depends on its own
words alone, and of any K - S k-mers in a row one is chosen at least. A chosen k-mer is an anchor: nine hex digits of its inner
windows' digests and the number of its first word. A fingerprint lists the anchors in order, e.g. "3f09ab2c10 77d0014fe3".

`likeness` matches anchors by position: the first, the middle and the last anchor that two fingerprints share propose
displacements, and an anchor counts where its counterpart stands at one of them; 2 * matches / all anchors.

`with_next` gives each row its successor in an order of all rows in one shuffle of the texts: bounds of ranges come from a
range partitioning of the keys alone, and the first row of each range also visits the range before it. The rows of a range
are sorted by one task and may spill; there are `RANGES` of them for every shuffle partition. Bounds (a key each) are
broadcast as one row. docs is read twice and must split the same way both times, as tables do; if not, the job fails.

Defined results: a null text is empty; a text without words has the fingerprint ""; one without a chosen k-mer (only such
of fewer than 2 * K - S - 1 words) is one anchor as a whole. Two empty fingerprints have likeness 1, an empty and another 0. In the order of
documents null ids stand last, equal ids by MD5 of their texts; repeated rows follow each other; a single document is its own
successor. An empty table gives an empty table; extra columns are ignored; texts are read whole, whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 5, 2
HASH = 9
RANGES = 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), with c computed once however often f uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def anchors(text: Column) -> Column:
    """array<string>: the anchors of a text in order, each its hash and the number of its first word."""
    joined = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), NOT_WORD, " "))

    def of_inner(inner: Column, plain: Column) -> Column:
        at = lambda i: F.get(inner, i)
        closed = lambda i: F.least(at(i), at(i + K - S)) <= F.least(*(at(i + j) for j in range(1, K - S)))
        token = lambda i: F.concat(F.left(at(i), F.lit(3)), F.left(at(i + K - S - 1), F.lit(3)), F.left(at(i + K - S), F.lit(3)), i.cast("string"))
        # inner windows 0, K - S - 1 and K - S hold all words of a k-mer of five
        starts = F.when(F.size(inner) > K - S, F.sequence(F.lit(0), F.size(inner) - (K - S + 1))).otherwise(F.array().cast("array<int>"))
        return bind(F.transform(F.filter(starts, closed), token), lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(F.concat(F.left(F.md5(plain), F.lit(HASH)), F.lit("0")))))

    def of_words(words: Column) -> Column:
        inner = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (S - 1), F.lit(0))), lambda w, i: F.md5(F.concat_ws(" ", w, *(F.get(words, i + j) for j in range(1, S)))))
        return bind(inner, lambda m: of_inner(m, F.array_join(words, " ")))

    return bind(joined, lambda j: F.when(j == "", F.array().cast("array<string>")).otherwise(bind(F.split(j, " "), of_words)))


def fingerprint(found: Column) -> Column:
    return F.array_join(found, " ")


def parse(stored: Column) -> Column:
    """The anchors of a fingerprint."""
    return F.when(stored == "", F.array().cast("array<string>")).otherwise(F.split(stored, " "))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: how many anchors of both lists match by position."""
    hashes = lambda x: F.transform(x, lambda t: F.left(t, F.lit(HASH)))
    place = lambda t: F.substring(t, HASH + 1, 12).cast("int")
    moved = lambda x, by: F.when(by == 0, x).otherwise(F.transform(x, lambda t: F.concat(F.left(t, F.lit(HASH)), (place(t) + by).cast("string"))))

    def matched(ha: Column, hb: Column) -> Column:
        first = lambda x, h, c: place(F.get(x, (F.array_position(h, c) - 1).cast("int")))
        proposed = lambda common: F.transform(F.array_distinct(F.array(F.get(common, F.lit(0)), F.get(common, F.floor((F.size(common) - 1) / 2).cast("int")), F.get(common, F.size(common) - 1))), lambda c: first(b, hb, c) - first(a, ha, c))
        here = lambda common: F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(proposed(common)), lambda by: F.array_intersect(moved(a, by), b)))))
        return bind(F.array_intersect(ha, hb), lambda common: F.when(F.size(common) == 0, F.lit(0)).otherwise(here(common)))

    n = F.size(a) + F.size(b)
    same = bind(hashes(a), lambda ha: bind(hashes(b), lambda hb: matched(ha, hb)))
    return F.when(n == 0, F.lit(1.0)).otherwise(2.0 * F.least(same, F.size(a), F.size(b)) / n)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns anchors and fingerprint; nothing is shuffled."""
    return docs.withColumn("anchors", anchors(F.col(text).cast("string"))).withColumn("fingerprint", fingerprint(F.col("anchors")))


def with_next(docs: DataFrame, keys: list[Column], columns: dict[str, Column]) -> DataFrame:
    """docs with the struct `next`: `columns` (computed once, after the shuffle) of the row that follows in ascending order of
    keys, after the last that of the first."""
    n = RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("_row", F.monotonically_increasing_id()).withColumn("_key", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys)), F.col("_row").alias("row")))
    ranges = keyed.select("_key").repartitionByRange(n, "_key").groupBy(F.spark_partition_id().alias("part")).agg(F.min("_key").alias("least"))
    bounds = ranges.agg(F.sort_array(F.collect_list("least")).alias("_bounds"))
    dealt = keyed.crossJoin(F.broadcast(bounds)).withColumn("_range", F.size(F.filter("_bounds", lambda b: b <= F.col("_key"))) - 1)
    home = F.struct(F.col("_range").alias("range"), F.lit(False).alias("visits"))
    before = F.struct(F.when(F.col("_range") == 0, F.size("_bounds") - 1).otherwise(F.col("_range") - 1).alias("range"), F.lit(True).alias("visits"))
    opens = F.get("_bounds", F.col("_range")) == F.col("_key")
    placed = dealt.withColumn("_at", F.explode(F.when(opens, F.array(home, before)).otherwise(F.array(home)))).withColumn("_range", F.col("_at.range")).withColumn("_visits", F.col("_at.visits")).drop("_at", "_bounds", "_row")
    here = placed.repartition("_range").withColumns(columns)
    after = F.lead(F.struct(*columns)).over(Window.partitionBy("_range").orderBy("_visits", "_key"))
    found = here.withColumn("next", after).filter(~F.col("_visits"))
    return found.withColumn("next", F.coalesce("next", F.raise_error(F.lit("docs was split in two ways when it was read twice")).cast(found.schema["next"].dataType))).drop("_range", "_visits", "_key")


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors of each document, edited (its last third replaced by the beginning of the document with the next
    smaller id) and next_anchors."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").isNull(), F.bitwise_not(F.coalesce("doc_id", F.lit(0))), F.md5("text")]
    found = with_next(own, order, {"text": F.col("text"), "anchors": anchors(F.col("text"))})
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.left("text", F.length("text") - third), F.left("next.text", third))
    return found.select("doc_id", "text", "anchors", edited.alias("edited"), F.col("next.anchors").alias("next_anchors"))


def op11_syncmers(spark, sf_dir: str) -> DataFrame:
    rows = edited_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("edited_anchors", anchors(F.col("edited")))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"),
        fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def _sql() -> str:
    joined = f"trim(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '{NOT_WORD}', ' ', 'g'))"
    least = lambda *i: "least(" + ", ".join(f"m[i + {j}]" for j in i) + ")"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
o AS (SELECT row_number() OVER w AS k, doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next
      FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
t AS (SELECT k, doc_id, 'own' AS kind, text FROM o
      UNION ALL SELECT k, doc_id, 'edited', left(text, length(text) - length(text) // 3) || left(next, length(text) // 3) FROM o
      UNION ALL SELECT k, doc_id, 'next', next FROM o),
w AS (SELECT *, {joined} AS plain, CASE WHEN {joined} = '' THEN [] ELSE string_split({joined}, ' ') END AS w FROM t),
m AS (SELECT *, list_transform(range(1, len(w)), lambda i: md5(w[i] || ' ' || w[i + 1])) AS m FROM w),
c AS (SELECT *, list_filter(range(1, len(m) - {K - S} + 1), lambda i: {least(0, K - S)} <= {least(*range(1, K - S))}) AS starts FROM m),
p AS (SELECT k, doc_id, kind, text,
        CASE WHEN len(w) = 0 THEN [] WHEN len(starts) = 0 THEN [{{'h': left(md5(plain), {HASH}), 'pos': 0}}]
             ELSE list_transform(starts, lambda i: {{'h': left(m[i], 3) || left(m[i + {K - S - 1}], 3) || left(m[i + {K - S}], 3), 'pos': i - 1}}) END AS a
      FROM c),
f AS (SELECT *, array_to_string(list_transform(a, lambda x: x.h || x.pos), ' ') AS print FROM p),
u AS (SELECT k, kind, x.h AS h, x.pos AS pos FROM (SELECT k, kind, unnest(a) AS x FROM f)),
lows AS (SELECT k, kind, h, min(pos) AS pos FROM u GROUP BY ALL),
shared AS (SELECT k, b.kind, b.pos - a.pos AS by_, row_number() OVER (PARTITION BY k, b.kind ORDER BY a.pos) AS r, count(*) OVER (PARTITION BY k, b.kind) AS n
           FROM lows a JOIN lows b USING (k, h) WHERE a.kind = 'own' AND b.kind <> 'own'),
moves AS (SELECT DISTINCT k, kind, by_ FROM shared WHERE r IN (1, (n - 1) // 2 + 1, n)),
same AS (SELECT b.k, b.kind, count(DISTINCT (b.h, b.pos)) AS n
         FROM moves JOIN u a ON a.k = moves.k AND a.kind = 'own' JOIN u b ON b.k = a.k AND b.kind = moves.kind AND b.h = a.h AND b.pos = a.pos + by_ GROUP BY ALL),
near AS (SELECT a.k, b.kind, CASE WHEN len(a.a) + len(b.a) = 0 THEN 1.0
             ELSE 2.0 * least(coalesce(n, 0), len(a.a), len(b.a)) / (len(a.a) + len(b.a)) END::DOUBLE AS near
         FROM f a JOIN f b USING (k) LEFT JOIN same ON same.k = b.k AND same.kind = b.kind WHERE a.kind = 'own' AND b.kind <> 'own')
SELECT o.doc_id, length(o.text) AS n_chars, sha256(e.text) AS edited_sha256, o.print AS fingerprint, e.print AS edited_fingerprint,
       x.near AS near_edited, y.near AS near_next
FROM f o JOIN f e ON e.k = o.k AND e.kind = 'edited' JOIN near x ON x.k = o.k AND x.kind = 'edited' JOIN near y ON y.k = o.k AND y.kind = 'next'
WHERE o.kind = 'own'"""


SQL = _sql()
