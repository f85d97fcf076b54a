"""Quality rules: hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Words and word pairs (A-Z lower-cased) are hashed into `BUCKETS` buckets. The target is every document with a good label,
the raw corpus is every document; both are counted in full, the raw corpus in place and the target after a key filter has
left (almost) only labelled documents to be shuffled. A document's score is the mean over its n-grams of
log p(bucket | target) - log p(bucket | raw), so its length does not count; documents below `THRESHOLD` are dropped, the
same way on each run. `THRESHOLD` was set by good and bad labelled documents outside the target (sf0.1, half of the good
labels as target): -0.25 keeps 1694 of 1694 good and 35 of 301 bad ones, -0.5 keeps 44 % of the bad, and above -0.05 good
ones go. At most one row a bucket reaches the driver, and the table of ratios travels with the tasks.

Beside the method stand base rules: too few words, or too many words in repeated 8-word windows.

Defined results: null and empty texts have no words and fail the base rules; repeated rows and null doc_ids give a row
each (null ids are in the raw corpus only); an empty table gives an empty table; without a target every ratio is 0;
extra columns are ignored; texts are read whole, whatever their length. Equality of 8-word windows is that of 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import Emitter, WordHashes, bound_batches, key_filter, mix, only_keys, rows_of, shingle_hashes, spread

BUCKETS, THRESHOLD, SMOOTHING = 1 << 16, -0.25, 10.0
#: Fixed values of the query's contract.
WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"


def ngram_buckets(h: np.ndarray) -> np.ndarray:
    """Buckets of the words and word pairs of a text."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate([mix(h), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window which is found twice or more."""
    if len(h) <= window:
        return 0
    w = shingle_hashes(h, window)
    order = np.argsort(w, kind="stable")
    equal = w[order][1:] == w[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(len(w), dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(h) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def base_counts(text: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text.decode()) - (len(text) - len(text.translate(None, SPACES)))
    lines = [x for x in text.split(b"\n") if x.split()]
    return chars, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(h)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """n-grams of all texts by bucket; at most one row a bucket and task is shuffled, one a bucket reaches the driver."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = WordHashes(), np.zeros(BUCKETS, np.int64)
        for (text,) in rows_of(batches, "text"):
            if text:
                n += np.bincount(ngram_buckets(known.of(text.lower().split())), minlength=BUCKETS)
        full = np.flatnonzero(n)
        yield pa.record_batch({"bucket": pa.array(full, pa.int64()), "n": pa.array(n[full])})

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def documents_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids. Both grow, so the join is shuffled, but only what a key filter leaves of docs."""
    wanted = ids.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("doc_id").alias("_h"))
    near = only_keys(docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("_h")), key_filter(wanted.select("_h")), "_h")
    return near.join(wanted.select("doc_id").hint("merge"), "doc_id", "left_semi")


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    if target.sum() == 0:
        return np.zeros(BUCKETS)
    # both get the same prior in proportion to their sizes, so what is rare says little, in a small corpus as in a large one
    p, q = target + SMOOTHING * target.sum() / raw.sum(), raw + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def apply_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base counts, base_failed, ratio (the score), kept for each document. trusted: doc_id of the target's documents."""
    bound_batches(docs.sparkSession)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    good = trusted.select(F.col("doc_id").cast("long").alias("doc_id"))
    ratios = log_ratios(bucket_counts(docs), bucket_counts(documents_of(docs, good)))
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, kept boolean"
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in names.split(", ")])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact, lowered, out = WordHashes(), WordHashes(), Emitter(schema, 10_000)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            text = text or b""
            words = text.split()
            chars, symbols, dup_lines, repeats = base_counts(text, words, exact.of(words))
            failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * len(words)
            buckets = ngram_buckets(lowered.of(text.lower().split()))
            ratio = float(ratios[buckets].mean()) if len(buckets) else 0.0
            if out.add(doc_id, len(words), chars, symbols, dup_lines, repeats, failed, ratio, not failed and ratio >= threshold):
                yield out.take()
        yield out.take()

    return docs.mapInArrow(judge, names)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1"))
