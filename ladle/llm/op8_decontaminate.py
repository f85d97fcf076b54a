"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted verification.

Texts are read as runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item of L words is compared with
every window of L words of every document; a document of fewer words is one window. Windows that hold no 5-word shingle of any
item have similarity 0 and are not fingerprinted. The other windows get a 64-bit SimHash of their shingles; the fingerprints of items are filed by four
16-bit blocks, each with all values within `BLOCK_RADIUS` bits, so every item within `RADIUS` = 4 * BLOCK_RADIUS + 3 bits
of a window is fetched. Those are verified: weighted Jaccard similarity of the two bags of shingles of at least
`SIMILARITY`, where a shingle weighs log(1 + items / items that hold it).

The items travel with the tasks in blocks of about `ITEMS` items and `ITEM_BYTES` bytes (a pass over the documents for
each block; an index of `ITEMS` takes about 100 MB, and a worker builds it once), so neither their number nor that of
documents is limited, and nothing is shuffled. Passes are what many items cost: a benchmark of a million items takes 200.

Defined results: null and empty texts match nothing; an item without words matches nothing; an item of fewer than five
words matches where it stands whole; repeated items and documents give a row each; null ids are kept; empty tables give
an empty table; extra columns are ignored; texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import Emitter, WordHashes, bound_batches, mix, rows_of, shingle_hashes, spread

SHINGLE, SIMILARITY, BLOCK_RADIUS, ITEMS, ITEM_BYTES = 5, 0.8, 3, 5_000, 8 << 20
RADIUS = 4 * BLOCK_RADIUS + 3
_TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MASKS = np.array([sum(1 << i for i in c) for k in range(BLOCK_RADIUS + 1) for c in combinations(range(16), k)], dtype=np.uint16)


def plain_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def signs(s: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle's hash."""
    return np.unpackbits(mix(s).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """SimHashes from sums of signs: a bit is set where the sum is above 0."""
    return np.packbits(sums > 0, axis=1).reshape(-1, 8).view(np.uint64).ravel()


class Items:
    """Benchmark items with their fingerprint index, by length in words."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        known = WordHashes()
        self.items = []
        for item_id, text in rows:
            h = known.of(plain_words(text.encode() if text else b""))
            if len(h):
                self.items.append((item_id, len(h), shingle_hashes(h, SHINGLE)))
        df = Counter(int(x) for _, _, s in self.items for x in set(s.tolist()))
        self.weight = {x: float(np.log1p(len(self.items) / n)) for x, n in df.items()}
        self.unknown = float(np.log1p(len(self.items)))
        self.bags = [Counter(s.tolist()) for _, _, s in self.items]
        self.lengths = sorted({n for _, n, _ in self.items})
        self.shingles = {w: np.unique(np.concatenate([s for _, n, s in self.items if min(n, SHINGLE) == w])) for w in {min(n, SHINGLE) for n in self.lengths}}
        self.prints = np.concatenate([fingerprints(signs(s).sum(axis=0, keepdims=True)) for _, _, s in self.items]) if self.items else np.empty(0, np.uint64)
        self.index = {n: self._blocks(np.array([k for k, x in enumerate(self.items) if x[1] == n])) for n in self.lengths}

    def _blocks(self, ids: np.ndarray):
        """For each block: all values within reach of an item's block, sorted, and the item of each."""
        out = []
        for block in self.prints[ids].view(np.uint16).reshape(-1, 4).T:
            values, owners = (block[:, None] ^ _MASKS).ravel(), np.repeat(ids.astype(np.int32), len(_MASKS))
            order = np.argsort(values, kind="stable")
            out.append((values[order], owners[order]))
        return out

    def within(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """(window, item) for all items of that length whose fingerprints lie within RADIUS of a window's."""
        if len(prints) == 0:
            return
        found = []
        for (values, owners), block in zip(self.index[length], np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4).T, strict=True):
            left, right = np.searchsorted(values, block, "left"), np.searchsorted(values, block, "right")
            n = right - left
            window = np.repeat(np.arange(len(prints)), n)
            at = np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            found.append(np.stack([window, owners[at].astype(np.int64)], axis=1))
        pairs = np.unique(np.concatenate(found), axis=0)
        near = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= RADIUS
        yield from map(tuple, pairs[near].tolist())

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of bags."""
        a, b = Counter(window.tolist()), self.bags[item]
        weight = lambda x: self.weight.get(x, self.unknown)
        common = sum(weight(x) * min(n, b[x]) for x, n in a.items() if x in b)
        return common / (sum(weight(x) * n for x, n in a.items()) + sum(weight(x) * n for x, n in b.items()) - common)

    def matches(self, h: np.ndarray) -> dict[int, tuple[float, int]]:
        """Best similarity and its first window's first word, by item, of a text's word hashes."""
        best: dict[int, tuple[float, int]] = {}
        for width, known in self.shingles.items():
            if len(h) < width:
                continue
            s = shingle_hashes(h, width)
            at = np.minimum(np.searchsorted(known, s), len(known) - 1)
            hit = known[at] == s
            if not hit.any():
                continue
            hits = np.concatenate([[0], np.cumsum(hit)])
            longest = max(n for n in self.lengths if min(n, SHINGLE) == width)
            where = np.flatnonzero(hit)
            sums = None
            for n in self.lengths:
                if min(n, SHINGLE) != width:
                    continue
                m = min(n - width + 1, len(s))  # shingles in a window; a shorter text is one window
                starts = np.flatnonzero(hits[m:] - hits[:-m])
                if sums is None:
                    low, high = max(0, where[0] - longest), min(len(s), where[-1] + longest + 1)
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(s[low:high]), axis=0, dtype=np.int32)])
                for k in range(0, len(starts), 20_000):
                    part = starts[k : k + 20_000]
                    for window, item in self.within(fingerprints(sums[part - low + m] - sums[part - low]), n):
                        start = int(part[window])
                        got = self.similarity(s[start : start + m], item)
                        if got >= SIMILARITY and (item not in best or (got, -start) > (best[item][0], -best[item][1])):
                            best[item] = (got, start)
        return best


_built: dict[str, Items] = {}


def _items_of(rows: list[tuple[int | None, str | None]], digest: str) -> Items:
    """The index of a block of items, built once a worker; a worker holds one."""
    if digest not in _built:
        _built.clear()
        _built[digest] = Items(rows)
    return _built[digest]


def _digest(rows: list[tuple[int | None, str | None]]) -> str:
    return hashlib.sha256(repr(rows).encode()).hexdigest()


def _match(docs: DataFrame, rows: list[tuple[int | None, str | None]]) -> DataFrame:
    digest = _digest(rows)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, out = _items_of(rows, digest), WordHashes(), Emitter(schema)
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            h = known.of(plain_words(text))
            for k, (similarity, start) in items.matches(h).items():
                if out.add(doc_id, items.items[k][0], start, min(items.items[k][1], len(h)), similarity):
                    yield out.take()
        yield out.take()

    return docs.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")


def _blocks_of_items(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items, in blocks of ITEMS items and ITEM_BYTES bytes on average (by hash); the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-total.n // ITEMS), -(-total.bytes // ITEM_BYTES))
    for k in range(passes):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        yield sorted(((r.item_id, r.text) for r in block), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def benchmark_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each document and item that match."""
    bound_batches(docs.sparkSession)
    docs = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return reduce(DataFrame.unionAll, (_match(docs, rows) for rows in _blocks_of_items(benchmark)))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text matches no item, with all their columns."""
    bound_batches(docs.sparkSession)
    for rows in _blocks_of_items(benchmark):

        def run(batches: Iterable[pa.RecordBatch], rows=rows, digest=_digest(rows)) -> Iterator[pa.RecordBatch]:
            items, known = _items_of(rows, digest), WordHashes()
            for batch in batches:
                yield batch.filter(pa.array([not items.matches(known.of(plain_words(text))) for (text,) in rows_of([batch], "text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    return benchmark_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
