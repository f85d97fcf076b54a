"""Mixing sources to target weights as a time-varying curriculum, on DataFrame operations only.

Each source has a share of the mix (its weight, capped at `max_epochs` times its size, the excess reshared by weight)
and a schedule: its weight at training time t in [0, 1] is share * (1 + slope * (1 - 2t)), whose integral from 0 to t is
share * (t + slope * (t - t^2)). A source's documents stand in a fixed pseudo-random order; the words before a document
are the cumulative demand at which it is read, and inverting the integral gives its training position. The result is
range-sorted by position. Each source's own rate is integrated, so a position is training time and no offset in the mixed
stream: the rates of all sources at a time do not sum up to a constant.

The running sum of a source is made in two steps (sums of hash ranges, then within one range), so that a source with a
third of all rows is dealt over all tasks. One row a source meets in one task, to share out the weights, and one row a
range of a source, for its offsets. Text is shuffled to its range and, by position, to its place: the words at a time vary
by the slopes only, so equal spans of time are partitions of like size and nothing has to be sampled.

Defined results: null and empty texts have size 0 and are not taken; a null source is a source of its own, sorted last;
a repeated row is a row of its own (its place among equal rows does not matter); null doc_ids are kept; an empty table
gives an empty table; extra columns are ignored by mix_sources and kept by mixed_documents, whatever their names (working
columns begin with _mix_).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.common import materialize, spread

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the query's contract.
WEIGHTS, SHARE, MAX_EPOCHS = (5, 2, 1), 1.5, 2
#: The schedule's slope of each weight: heavy sources come early, light ones late.
SLOPES = (0.5, 0.0, -0.5)
ROWS_A_RANGE = 2_000


def word_count(text: Column) -> Column:
    """Number of words (maximal runs of other than ASCII white space); null: 0."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], slopes: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """source, source_size, target, slope: one row a source.

    With caps, the targets are min(cap, level * weight) for one level. Sources are sorted by cap / weight; the level is
    the first at which the sources that come later stay below their caps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    place = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("_k", place)
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("_k") + 1)).withColumn("slope", F.element_at(F.array(*map(F.lit, map(float, slopes))), F.col("_k") + 1))
    cap = F.col("source_size") * float(max_epochs)
    ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source")
    before, everything = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumn("_cap", cap)
    per = per.withColumn("_level", (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    # the level is the one at the first source whose cap is not below it; min() finds it, as levels fall from there on only for capped sources
    fits = F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_level"))
    first = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("_at", F.first(fits, ignorenulls=True).over(first))
    return per.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_at") * F.col("_w"), F.col("_cap"))).alias("target"), "slope")


def _sized(docs: DataFrame) -> DataFrame:
    """docs with its documents' sizes, source keys (never null) and places in their sources' order."""
    source = F.col("source").cast("string")
    # the text decides where there is no id, and between rows of one id
    return docs.withColumn("_mix_t", F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))).withColumns(
        {
            "_mix_size": word_count(F.col("text").cast("string")),
            "_mix_key": F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source)),
            "_mix_h": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("_mix_t")).cast("binary")),
        }
    )


def _ranged(rows: DataFrame, n: int) -> DataFrame:
    """rows with the range of the order (one of n) that holds them."""
    return rows.withColumn("_mix_r", F.floor(F.conv(F.substring("_mix_h", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * n).cast("long"))


def _offsets(sizes: DataFrame, n: int, weights: Sequence[float], slopes: Sequence[float], share: float, max_epochs: int) -> DataFrame:
    """For each source and range of its order: the words before it, and the source's target and slope."""
    source = F.when(F.col("_mix_key") != "n", F.substring("_mix_key", 2, 1 << 30))
    ranges = materialize(_ranged(sizes, n).groupBy("_mix_key", "_mix_r").agg(F.sum("_mix_size").alias("_mix_s")), "mix-sums")
    targets = source_targets(ranges.select(source.alias("source"), F.col("_mix_s").alias("size")), weights, slopes, share, max_epochs)
    targets = targets.select(F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))).alias("_mix_key"), *(F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "slope")))
    before = Window.partitionBy("_mix_key").orderBy("_mix_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("_mix_before", F.coalesce(F.sum("_mix_s").over(before), F.lit(0))).drop("_mix_s")
    return materialize(offsets.join(targets, "_mix_key"), "mix-ranges")


def _placed(rows: DataFrame, offsets: DataFrame, max_epochs: int) -> DataFrame:
    """rows with their source's size and target and _mix_uses: (position, words taken) for each time that the mix takes the document.

    The join and the sums within a range need the same, single shuffle of rows; offsets grow with the documents, so they are
    never broadcast.
    """
    placed = rows.join(offsets.hint("shuffle_hash"), ["_mix_key", "_mix_r"])
    within = Window.partitionBy("_mix_key", "_mix_r").orderBy("_mix_h", "doc_id", "_mix_size", "_mix_t").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_mix_c", F.coalesce(F.sum("_mix_size").over(within), F.lit(0)))
    demand, a = F.round("_mix_target").cast("long"), F.col("_mix_slope")

    def use(epoch: int) -> Column:
        start = F.col("_mix_source_size") * epoch + F.col("_mix_before") + F.col("_mix_c")
        u = F.least(F.coalesce(F.try_divide(start.cast("double"), F.col("_mix_target")), F.lit(0.0)), F.lit(1.0))
        root = (1 + a) - F.sqrt(F.greatest((1 + a) * (1 + a) - 4 * a * u, F.lit(0.0)))
        position = F.when(a == 0, u).otherwise(F.abs(F.try_divide(root, 2 * a)))
        return F.struct(position.alias("position"), F.least(F.greatest(demand - start, F.lit(0)), F.col("_mix_size")).cast("long").alias("taken"))

    return placed.withColumn("_mix_uses", F.filter(F.array(*map(use, range(max_epochs))), lambda x: x["taken"] > 0))


def _check(weights: Sequence[float], slopes: Sequence[float]) -> None:
    if len(weights) != len(slopes) or any(not -1 <= s <= 1 for s in slopes) or any(w <= 0 for w in weights):
        raise ValueError("one slope from -1 to 1 for each weight above 0")


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, position for each document, range-sorted by position (null: not taken).

    taken: words that the mix takes of the document; the document at the end of a source's demand is cut there.
    position: training time of its first use, from 0 to 1.
    """
    _check(weights, slopes)
    base = _sized(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")))
    sizes = materialize(base.drop("text"), "mix-sizes")
    n = max(64, sizes.count() // ROWS_A_RANGE)
    placed = _placed(_ranged(sizes, n), _offsets(sizes, n, weights, slopes, share, max_epochs), max_epochs)
    taken = F.aggregate("_mix_uses", F.lit(0).cast("long"), lambda s, x: s + x["taken"])
    named = {"size": "_mix_size", "source": "source", "source_size": "_mix_source_size", "target": "_mix_target"}
    out = placed.select("doc_id", *(F.col(c).alias(name) for name, c in named.items()), taken.alias("taken"), F.get("_mix_uses", F.lit(0))["position"].alias("position"))
    return materialize(out, "mix-placed").repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, slopes: Sequence[float] = SLOPES, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The rows of docs, once for each time that the mix takes them whole or in part, range-sorted by training position.

    Documents without words are never taken.
    """
    _check(weights, slopes)
    # words are counted once; what is read of the table for the offsets are its narrow columns
    whole = materialize(_sized(docs), "mix-documents")
    n = max(64, whole.count() // ROWS_A_RANGE)
    placed = _placed(_ranged(whole, n), _offsets(whole, n, weights, slopes, share, max_epochs), max_epochs)
    used = placed.select(*docs.columns, F.explode("_mix_uses.position").alias("_mix_position"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole.rdd.getNumPartitions())
    part = F.least(F.floor(F.col("_mix_position") * parts), F.lit(parts - 1)).cast("int")
    return used.repartitionById(parts, part).sortWithinPartitions("_mix_position", "doc_id").drop("_mix_position")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "position")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS t, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda v: v <> ''))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS k, source_size * 2.0::DOUBLE AS cap FROM s),
w AS (SELECT *, ([5, 2, 1])[k]::DOUBLE AS w, ([0.5, 0, -0.5])[k]::DOUBLE AS slope FROM k),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, slope,
         least(cap, coalesce((SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, source IS NULL, source LIMIT 1) * w, cap)) AS target
  FROM l),
p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, t)), doc_id, size, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS c
  FROM d),
u AS (
  SELECT doc_id, size, source_size, target, slope, c / target AS u,
         least(greatest(round(target)::BIGINT - c, 0), size) + least(greatest(round(target)::BIGINT - source_size - c, 0), size) AS taken
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
       CASE WHEN taken > 0 THEN CASE WHEN slope = 0 THEN least(u, 1) ELSE
         abs(((1 + slope) - sqrt(greatest((1 + slope) * (1 + slope) - 4 * slope * least(u, 1), 0))) / (2 * slope)) END END AS position
FROM u
"""
