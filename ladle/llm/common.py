"""Shared pieces of the training-data operators: shared-folder tables, totals of hot keys, key filters, word hashing."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks over which the rows of one key are dealt.
SALTS = 32
#: The largest key filter: 8 bits or more a key, so 8 MB at most; more keys are not filtered.
MOST_FILTER_KEYS = 1 << 23

_made: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a local session that has none gets a test folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or "file:///tmp/ladle-shared").rstrip("/")


def _remove_made() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    try:
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _made:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session is ending; the folder's owner removes what is left
        return


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver ends."""
    if not _made:
        atexit.register(_remove_made)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Spark's setting that removes the shuffle files of a query when it ends; a table that is written needs them no longer.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.ladle_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing reads any more."""
    for table in tables:
        fs, path = file_system(table.ladle_path)
        fs.delete_dir(path)


def spread(docs: DataFrame) -> DataFrame:
    """docs, dealt anew where they come in fewer splits than there are cores (a single small file); large tables stay as they are."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < cores else docs


def with_total(rows: DataFrame, key: str, by: str, part: Column, total: Column, name: str) -> DataFrame:
    """rows with an aggregate over all rows of their key, which may hold a third of them.

    Rows are dealt over SALTS tasks a key by the hash of `by`: `part` (an aggregate, alias _part) is taken by key and salt,
    `total` over a key's parts, and totals go back to the parts and from there to the rows. All joins are shuffled.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(part.alias("_part"))
    back = parts.select(key, "_salt").join(parts.groupBy(key).agg(total.alias(name)).hint("merge"), key)
    return salted.join(back.hint("merge"), [key, "_salt"]).drop("_salt")


def key_filter(keys: DataFrame) -> np.ndarray | None:
    """A Bloom filter of a column of 64-bit hashes, sized by their number; null where there are more than MOST_FILTER_KEYS.

    One row for each 64-bit word of it at most reaches the driver.
    """
    key, n = F.col(keys.columns[0]), keys.count()
    if n > MOST_FILTER_KEYS:
        return None
    bits = 1 << max(16, (8 * n).bit_length())
    both = keys.select(F.explode(F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(bits - 1)))).alias("b"))
    rows = both.groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 AS int))")).alias("v")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[rows.column("w").to_numpy()] = rows.column("v").to_numpy()
    return words.view(np.uint64)


def probably_in(bloom: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    """Whether the filter may hold each key; true for all that it holds."""
    out, least = np.ones(len(keys), dtype=bool), keys.astype(np.uint64)
    if bloom is None:
        return out
    for shift in (0, 32):
        bits = (least >> np.uint64(shift)) & np.uint64(64 * len(bloom) - 1)
        out &= (bloom[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) > 0
    return out


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker, which waits for its next task, gives the memory that it holds but does not use back to the system."""

    def wrapped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
                trim(0)

    return wrapped


def only_keys(rows: DataFrame, bloom: np.ndarray | None, key: str) -> DataFrame:
    """The rows whose key (a 64-bit hash) the filter may hold, chosen in place, so that few others are shuffled."""
    if bloom is None:
        return rows
    at = rows.columns.index(key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(probably_in(bloom, batch.column(at).to_numpy())))

    return rows.mapInArrow(lean(run), rows.schema)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a URI or plain path, and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small, as one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


_C1, _C2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _STEP = np.uint64(33), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche 64-bit values (a bijection)."""
    x = x ^ (x >> _S33)
    x = x * _C1
    x ^= x >> _S33
    x *= _C2
    x ^= x >> _S33
    return x


class WordHashes(dict):
    """Remembers the 64-bit hash of each word; forgets everything at `limit` words, so memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """One hash for each window of n words; the whole sequence as one if it has fewer; none if it is empty."""
    if len(h) == 0:
        return h
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width * int(_STEP) & (1 << 64) - 1))
    with np.errstate(over="ignore"):
        for j in range(width):
            out = mix(out + h[j : len(h) - width + 1 + j]) + _STEP
    return out


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of the named columns; strings come as UTF-8 bytes."""
    for batch in batches:
        columns = []
        for name in names:
            c = batch.column(batch.schema.get_field_index(name))
            columns.append(utf8(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist())
        yield from zip(*columns, strict=True)


class Emitter:
    """Gathers rows into Arrow record batches of a schema."""

    def __init__(self, schema: pa.Schema, rows: int = 2000):
        self.schema, self.limit = schema, rows
        self.columns: list[list] = [[] for _ in schema]

    def add(self, *row) -> bool:
        for c, v in zip(self.columns, row, strict=True):
            c.append(v)
        return len(self.columns[0]) >= self.limit

    def take(self) -> pa.RecordBatch:
        out = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
        self.columns = [[] for _ in self.schema]
        return out
