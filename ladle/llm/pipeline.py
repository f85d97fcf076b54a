"""A corpus pipeline of five stages, each an operator of this package.

run() applies the stages to the documents table, each over what the one before wrote; the check tool and the driver may
do the same stage by stage. Every stage keeps the rows that it does not reject as they are (all but the last return the
columns of documents).

Defined results: rows of a null doc_id are treated as others. Null and empty texts pass the first three stages unless the
classifier rejects them (it scores all of them alike); the mixing stage, which counts in words, drops texts without words,
and of a source whose target is less than its size the documents beyond the target.
Rows that repeat doc_id and text count as copies: one stays. Columns beyond those of documents are dropped. An empty table
gives an empty table at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ladle.llm import op4_jaccard, op5_mixing, op6_quality, op8_decontaminate, op10_token_ids
from ladle.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier, fitted on labels.quality, scores below its threshold."""
    docs = docs.select(*COLUMNS)
    model = op6_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op6_quality.score(docs, model, COLUMNS).filter(F.col("score") >= op6_quality.THRESHOLD).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of links (5-word shingles, similarity 0.8 or more): of the smallest doc_id, null ids last.

    A row's key is the hash of its doc_id and text, so rows of one doc_id are judged by their own texts; of rows that have
    both in common one stays. Rows without words link with nothing and all stay.
    """
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text", F.col("text").isNull())
    groups = op4_jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text"), op4_jaccard.Measure(5, 80, 100))
    ids = docs.select(key.alias("_key"), F.col("doc_id").alias("_id")).distinct()
    groups = groups.withColumnRenamed("doc_id", "_key").join(ids.hint("merge"), "_key")
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_key"))["_key"]
    kept = materialize(groups.groupBy("component_id").agg(first.alias("_key"), (F.max("n_shingles") > 0).alias("_words")).select("_key", "_words"), "kept")
    # what is kept grows with the documents, so it is never broadcast, not even where it is little
    rows = docs.withColumn("_key", key).join(kept.hint("merge"), "_key")
    rows = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("_key").orderBy("lang", "source", "n_chars")))
    return rows.filter(~F.col("_words") | (F.col("_rn") == 1)).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    docs = docs.select(*COLUMNS)
    return op8_decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix uses it, whole or in part: 0 (without words, or beyond its source's target), 1 or 2 rows, range-sorted by position."""
    return op5_mixing.mixed_documents(docs.select(*COLUMNS))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the documents as token ids and describe each from the files."""
    return op10_token_ids.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources to target weights", mixing),
    ("token-ID / binary output", token_ids),
]

#: SQL cannot express the compression classifier or the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-" + name.split()[0])
    return docs
