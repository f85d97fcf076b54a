"""Quality classifier by compression: zstandard dictionaries of good and of bad labelled texts.

A text is cut into blocks, and each block is compressed with either dictionary. The difference of the two totals, by the
text's length, and the good total by length go into a logistic score fitted on labelled texts that neither dictionary
has seen, with its intercept moved from the sample's to the labels' own share of good texts. Features count up to `REACH`
deviations from the fitted mean. A text of fewer than `SHORT_BYTES` bytes says little: its logit is moved towards that of the
labels' share (all but the square of length / SHORT_BYTES), so an empty text gets that share.

The fit takes at most `PER_CLASS` labelled rows of each class, those whose ids hash lowest, of at most `FIT_BYTES` bytes
each: a bounded sample, so a bounded model (two dictionaries and four numbers) that travels with the tasks. Every
document is scored over its whole text.

Defined results: null and empty texts get the share of good labels; repeated rows and null doc_ids give a row each;
labels other than 0 and 1 are ignored, as are those of unknown ids; of contradicting labels of an id the larger counts;
an empty table gives an empty table; extra columns are ignored. Where the labels do not hold both classes, every score
is the share of good labels (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import Emitter, bound_batches, rows_of, spread

PER_CLASS, FIT_BYTES = 1500, 32_768
DICTIONARY_BYTES, BLOCK_BYTES, LEVEL = 32_768, 1024, 3
SHORT_BYTES, REACH = 100, 4.0
THRESHOLD = 0.3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)
    center: tuple[float, ...] = (0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0)
    prior: float = 0.0
    _ready: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": []}

    def features(self, text: bytes | None) -> tuple[float, float]:
        if not text or not self.good:
            return 0.0, 0.0
        if not self._ready:
            self._ready.extend(_compressor(d) for d in (self.good, self.bad))
        good, bad = self._ready
        blocks = [text[i : i + BLOCK_BYTES] for i in range(0, len(text), BLOCK_BYTES)]
        g, b = sum(len(good.compress(x)) for x in blocks), sum(len(bad.compress(x)) for x in blocks)
        return (b - g) / len(text), g / len(text)

    def score(self, text: bytes | None) -> float:
        x = np.clip((np.array(self.features(text)) - self.center) / self.scale, -REACH, REACH)
        told = min(len(text or b"") / SHORT_BYTES, 1.0) ** 2 if self.good else 0.0
        z = self.prior + told * (self.weights[0] + float(np.dot(self.weights[1:], x)) - self.prior)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 40) -> np.ndarray:
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
    return w


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on labelled rows that are not held out; see the module's docstring for the bounds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality").alias("s")).first().s
    share = 0.5 if share is None else min(max(share, 1e-4), 1 - 1e-4)
    none = Model(prior=float(np.log(share / (1 - share))))
    order = F.xxhash64("doc_id")
    picked = known.filter("quality = 0").orderBy(order, "doc_id").limit(per_class).unionAll(known.filter("quality = 1").orderBy(order, "doc_id").limit(per_class))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").filter(F.octet_length("text").between(1, FIT_BYTES)).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    texts = {q: [r.text.encode() for r in rows if r.quality == q] for q in (0, 1)}
    if min(map(len, texts.values())) < 16:
        return none
    try:
        model = Model(_dictionary(texts[1][::2]), _dictionary(texts[0][::2]))
    except zstandard.ZstdError:  # too little text for a dictionary
        return none
    x = np.array([model.features(t) for q in (0, 1) for t in texts[q][1::2]])
    y = np.array([q for q in (0, 1) for _ in texts[q][1::2]])
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - center) / scale, y)
    model.prior = none.prior
    w[0] += model.prior - np.log(y.mean() / (1 - y.mean()))
    model.weights, model.center, model.scale = tuple(map(float, w)), tuple(map(float, center)), tuple(map(float, scale))
    return model


def score(docs: DataFrame, model: Model, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The given columns of docs and the score of each text."""
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema if f.name in columns]
    picked = spread(docs.select(*columns, *(() if "text" in columns else ("text",))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(t) for (t,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(scores, pa.float64())], [*columns, "score"])

    fields = {f.name: f.dataType.simpleString() for f in kept}
    return picked.mapInArrow(run, ", ".join(f"`{c}` {fields[c]}" for c in columns) + ", score double")


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
