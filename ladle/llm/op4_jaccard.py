"""N-gram Jaccard join by vertical partitioning, and the groups that its links make.

A document is the set of its distinct n-word shingles (64-bit hashes). Two documents link when
den * |A and B| >= num * |A or B|. The result is the connected groups of all links; equal sets are one class from the
start, so exact copies never make pairs.

The global order of shingles puts frequent ones last and goes by hash within both parts. It is cut into fragments:

1. Candidates. Linked sets share at least l shingles among the first |A| - ceil(num * |A| / den) + l of either (prefix
   filter). Each class sends its prefix to buckets, one a shingle. A class stays only while enough of its shingles for a
   partner of the smallest size stand in buckets of two or more; this is counted per class, without pairs, and repeated
   as buckets shrink. Which shingles are called frequent (`heavy_shingles`) and the choice of l only change how many
   candidates there are, never the links.
2. Partial counts by fragment, in short. Of each of 512 fragments a class keeps whether it holds an odd number of
   shingles: fragments that differ in it have at least one shingle that only one of two sets has. If so many differ that
   the pair cannot link, it is dropped inside its bucket, before any row is made for it. Proposed pairs of sets too large
   for 512 bits are tested on 8,192 fragments in the same way.
3. Partial counts by fragment, in full. The sets of candidates are cut into 8 segments of the order; the common shingles
   of a pair are counted in each segment separately and summed per pair.

Texts are hashed once; the sets (8 bytes a shingle, one set a class and task) stand in the shared folder from there on.
What grows with the documents is joined by shuffle at every size, never broadcast.

A group of copies is not turned into all its pairs: in each round every class proposes its nearest and its smallest
partner in another group of its buckets, the proposals are verified in full, and the groups they link are joined. A last
round verifies every pair of different groups that step 2 leaves, so that no link between groups is lost. Buckets of over
`BLOCK` classes are compared block by block.

Defined results: null and empty texts (and texts of white space) have no shingles and link with nothing; texts with fewer
words than n are one shingle; repeated rows link by their equal sets; null doc_ids take part, but name no group
(component_id is null where all ids of a group are null); an empty table gives an empty table; extra columns are ignored;
texts are read whole. Sets are told apart by the 64-bit hash of their sorted shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.llm.common import SALTS, WordHashes, bound_batches, discard, key_filter, lean, materialize, mix, only_keys, probably_in, rows_of, shingle_hashes, spread, with_total

PARITY_BITS, WIDE_BITS, SEGMENTS, BLOCK = 512, 8192, 8, 1024
LEAST_HEAVY, MOST_HEAVY = 64, 200_000
BEST_ROUNDS, PEELS = 2, 2
#: Words whose hashes a task remembers: few, as their memory adds to that of an executor full from its shuffles.
WORDS = 100_000
#: Shingles that a task gathers before it hands rows on, and pairs.
BATCH_SHINGLES, BATCH_PAIRS = 1 << 19, 1 << 18


@dataclass(frozen=True)
class Measure:
    """Shingles of n words; sets link when den * common >= num * union."""

    n: int = 3
    num: int = 90
    den: int = 100

    def common(self, size: int) -> int:
        """l: shingles that a prefix has beyond those that may all be missing in the other set."""
        return max(1, size * (self.den - self.num) // (2 * self.den))

    def prefix(self, size: int) -> int:
        return min(size, size - -(-self.num * size // self.den) + self.common(size))

    def needed(self, size: Column) -> Column:
        """l of the smallest partner of a set."""
        partner = F.floor((size * self.num + self.den - 1) / F.lit(self.den))
        return F.greatest(F.lit(1), F.floor(partner * (self.den - self.num) / F.lit(2 * self.den)))

    def least_size(self) -> int:
        """Sets below it link only with equal ones."""
        size = 1
        while (self.den - self.num) * size < self.num:  # one shingle more: size / (size + 1) < num / den
            size += 1
        return size

    def shingles(self, text: bytes | None, known: WordHashes) -> np.ndarray:
        """The sorted set."""
        return np.unique(shingle_hashes(known.of((text or b"").lower().split()), self.n))


def set_key(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def parities(s: np.ndarray, bits: int) -> np.ndarray:
    """Whether each of `bits` fragments of the hash order holds an odd number of shingles, as 64-bit words."""
    at = (s >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).view(np.uint64).astype(np.int64)


class _Heavy:
    """Shingles met at least `least` times, among those counted so far, with bounded memory."""

    def __init__(self, least: int = 3, flush: int = 1 << 20):
        self.least, self.flush, self.parts, self.n = least, flush, [], 0
        self.h, self.c = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, s: np.ndarray) -> None:
        self.parts.append(s)
        self.n += len(s)
        if self.n >= self.flush:
            self.reduce()

    def reduce(self) -> None:
        if self.parts:
            h, c = np.unique(np.concatenate(self.parts), return_counts=True)
            h, c = h[c >= self.least], c[c >= self.least]
            every, where = np.unique(np.concatenate([self.h, h]), return_inverse=True)
            self.h, self.c = every, np.bincount(where, weights=np.concatenate([self.c, c]), minlength=len(every)).astype(np.int64)
        self.parts, self.n = [], 0


def document_sets(docs: DataFrame, m: Measure) -> DataFrame:
    """doc_id, n, key of each document, and s, its set, with the first document of a class in a task; and, with n = -1, counts
    (doc_id) of shingles (key) that are frequent within a task."""
    none = np.empty(0, np.int64)

    def table(ids: list, sizes: list, keys: list, sets: list) -> pa.RecordBatch:
        return pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(sizes, pa.int64()), "key": pa.array(keys, pa.int64()), "s": _lists(sets)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, heavy, seen = WordHashes(WORDS), _Heavy(), set()
        for batch in batches:
            columns, gathered = ([], [], [], []), 0
            for doc_id, text in rows_of([batch], "doc_id", "text"):
                s = m.shingles(text, known)
                key, held = set_key(s) if len(s) else None, none
                if len(s) and key not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(key)
                    heavy.add(s)
                    held = s.astype(np.int64)
                    gathered += len(s)
                for column, value in zip(columns, (doc_id, len(s), key, held), strict=True):
                    column.append(value)
                if gathered >= BATCH_SHINGLES:
                    yield table(*columns)
                    columns, gathered = ([], [], [], []), 0
            yield table(*columns)
        heavy.reduce()
        for k in range(0, len(heavy.h), 50_000):
            part = heavy.h[k : k + 50_000].astype(np.int64)
            yield table(heavy.c[k : k + 50_000], np.full(len(part), -1), part, [none] * len(part))

    return docs.mapInArrow(lean(run), "doc_id long, n long, key long, s array<long>")


def class_sets(made: DataFrame, m: Measure) -> DataFrame:
    """key, s of the classes that may link with another; once or, where several tasks met a class, more often."""
    return made.filter((F.col("n") >= m.least_size()) & (F.size("s") > 0)).select("key", "s")


def _rows_of_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a batch of (key, s), where each set starts (and the last ends), and the shingles of all."""
    lists = batch.column(1)
    at = lists.offsets.to_numpy().astype(np.int64)
    return batch.column(0).to_numpy(), at - at[0], lists.flatten().to_numpy().astype(np.uint64)


def heavy_shingles(made: DataFrame) -> np.ndarray:
    """The most frequent shingles, at most MOST_HEAVY of them, sorted: only a choice of the global order."""
    rows = made.filter("n = -1").groupBy("key").agg(F.sum("doc_id").alias("c")).filter(F.col("c") >= LEAST_HEAVY).orderBy(F.desc("c"), "key").limit(MOST_HEAVY).select("key").collect()
    return np.sort(np.array([r.key for r in rows], dtype=np.int64).astype(np.uint64))


def _contains(ordered: np.ndarray, s: np.ndarray) -> np.ndarray:
    if len(ordered) == 0:
        return np.zeros(len(s), dtype=bool)
    return ordered[np.minimum(np.searchsorted(ordered, s), len(ordered) - 1)] == s


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), pa.int64()))


def prefixes(sets: DataFrame, m: Measure, heavy: np.ndarray) -> DataFrame:
    """key, n, prefix, light, parity of each class that may link with another; the first `light` of its prefix are no frequent shingles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, flat = _rows_of_sets(batch)
            late_ones, prefix, light, parity = _contains(heavy, flat), [], [], []
            for a, b in zip(at, at[1:], strict=False):
                s, late = flat[a:b], late_ones[a:b]
                first = s[~late]
                prefix.append(np.concatenate([first, s[late]])[: m.prefix(len(s))].astype(np.int64))
                light.append(len(first))
                parity.append(parities(s, PARITY_BITS))
            yield pa.record_batch({"key": pa.array(keys), "n": pa.array(np.diff(at)), "prefix": _lists(prefix), "light": pa.array(light, pa.int64()), "parity": _lists(parity)})

    made = sets.mapInArrow(lean(run), "key long, n long, prefix array<long>, light long, parity array<long>")
    return made.groupBy("key").agg(*(F.first(c).alias(c) for c in ("n", "prefix", "light", "parity")))


def _sizes(rows: DataFrame) -> DataFrame:
    """sig, c, most: the buckets of two or more classes, their number, and the largest salt of their rows."""
    return rows.groupBy("sig").agg(F.count("*").alias("c"), F.max("salt").alias("most")).filter("c > 1")


def _shared(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (sig, key, salt, ...) of the given buckets, with the number of their classes (c).

    Buckets of frequent shingles, the only ones that may be large, are dealt by salts, and their size goes to each salt.
    """
    salts = F.when(F.col("most") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return rows.join(sizes.select("sig", "c", F.explode(salts).alias("salt")).hint("merge"), ["sig", "salt"])


def _prefix_rows(reps: DataFrame, bloom: np.ndarray | None) -> DataFrame:
    """sig, key, salt: a row for each prefix shingle that the filter of buckets may hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, flat = _rows_of_sets(batch)
            n = np.diff(at)
            owner, late = np.repeat(keys, n), np.arange(len(flat)) - np.repeat(at[:-1], n) >= np.repeat(batch.column(2).to_numpy(), n)
            salt = np.where(late, (mix(owner.astype(np.uint64)) % np.uint64(SALTS)).astype(np.int32), np.int32(-1))
            ok = probably_in(bloom, flat)
            yield pa.record_batch({"sig": pa.array(flat[ok].astype(np.int64)), "key": pa.array(owner[ok]), "salt": pa.array(salt[ok])})

    return reps.select("key", "prefix", "light").mapInArrow(lean(run), "sig long, key long, salt int")


def buckets(reps: DataFrame, m: Measure) -> DataFrame:
    """sig, key, n, c: the classes of each bucket (prefix shingle) of two or more that may have a partner, and their number.

    Most prefix shingles stand in one class only, so buckets are counted first, and rows of the others are not shuffled.
    """
    one = F.when(F.col("k") >= F.col("light"), 0).otherwise(-1)
    sizes = materialize(_sizes(reps.select(F.posexplode("prefix").alias("k", "sig"), "light").select("sig", one.alias("salt"))), "sizes")
    rows = _shared(_prefix_rows(reps, key_filter(sizes.select("sig"))), sizes).join(reps.select("key", "n").hint("merge"), "key")
    rows = materialize(rows.drop("c"), "shared")
    discard(sizes)
    whole = rows
    for _ in range(PEELS):
        # a class has no more rows than its prefix has shingles
        enough = F.count("*").over(Window.partitionBy("key")) >= m.needed(F.col("n"))
        rows = rows.withColumn("ok", enough).filter("ok").select("sig", "key", "n", "salt")
        rows = _shared(rows, _sizes(rows))
    out = materialize(rows.drop("salt"), "buckets")
    discard(whole)
    return out


def compared(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """grp, half, key, n, parity, root: the rows of buckets by groups of classes to be compared.

    A bucket of over BLOCK classes becomes a group for each pair of its blocks; half tells the two blocks apart.
    """
    blocks = F.ceil(F.col("c") / F.lit(BLOCK / 2)).cast("int")
    rows = rows.withColumn("nb", F.when(F.col("c") > BLOCK, blocks).otherwise(1)).withColumn("b", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    low, high = F.least("b", "o"), F.greatest("b", "o")
    grp = F.when(F.col("nb") == 1, F.col("sig")).otherwise(F.xxhash64("sig", low, high))
    half = F.when(low == high, F.lit(-1)).otherwise(F.when(F.col("b") == low, 0).otherwise(1))
    rows = rows.select(grp.alias("grp"), half.cast("int").alias("half"), "key", "n", "root")
    return rows.join(reps.select("key", "parity").hint("merge"), "key")


def _groups(batches: Iterable[pa.RecordBatch], enough: int = 60_000) -> Iterator[dict[str, np.ndarray]]:
    """Columns of whole groups (the rows come sorted by grp), some groups at a time."""
    held: list[pa.RecordBatch] = []
    n = 0

    def columns(t: pa.Table) -> dict[str, np.ndarray]:
        t = t.combine_chunks()
        out = {c: t.column(c).to_numpy() for c in t.column_names if c != "parity"}
        flat = t.column("parity").combine_chunks()
        out["parity"] = (flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy(zero_copy_only=False).astype(np.uint64).reshape(-1, PARITY_BITS // 64)
        return out

    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held)
        grp = table.column("grp").to_numpy()
        cut = int(np.flatnonzero(grp != grp[-1])[-1]) + 1 if grp[0] != grp[-1] else 0
        if cut:
            yield columns(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            n = table.num_rows - cut
    if held:
        yield columns(pa.Table.from_batches(held))


def _pairs(g: dict[str, np.ndarray], m: Measure) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of rows of a group that may link, and how many fragments differ."""
    grp, n, parity, half, root = g["grp"], g["n"], g["parity"], g["half"], g["root"]
    ends = np.append(np.flatnonzero(grp[1:] != grp[:-1]) + 1, len(grp))
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))
    at, k = np.arange(len(grp)), 1
    while True:
        at = at[at + k < end[at]]
        if len(at) == 0:
            return
        i, j = at, at + k
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        ok = (m.num * large <= m.den * small) & (root[i] != root[j]) & ((half[i] < 0) | (half[i] != half[j]))
        i, j = i[ok], j[ok]
        if len(i):
            differ = np.bitwise_count(parity[i] ^ parity[j]).sum(axis=1).astype(np.int64)
            ok = differ * (m.den + m.num) <= (n[i] + n[j]) * (m.den - m.num)
            yield i[ok], j[ok], differ[ok]
        k += 1


def proposals(rows: DataFrame, m: Measure) -> DataFrame:
    """key, near, differ, low: for each class of each bucket its nearest and its smallest possible partner of another group."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            key, size = g["key"], len(g["key"])
            top = np.iinfo(np.int64).max
            differ, near, low = np.full(size, top), np.full(size, top), np.full(size, top)
            for i, j, d in _pairs(g, m):
                for a, b in ((i, j), (j, i)):  # a row stands in one pair a step
                    better = (d < differ[a]) | ((d == differ[a]) & (key[b] < near[a]))
                    differ[a[better]], near[a[better]] = d[better], key[b[better]]
                    low[a] = np.minimum(low[a], key[b])
            # a partner that is the class itself, through another row of it, is none
            ok = differ < top
            yield pa.record_batch({"key": pa.array(key[ok]), "differ": pa.array(differ[ok]), "near": pa.array(near[ok]), "low": pa.array(low[ok])})

    made = rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(lean(run), "key long, differ long, near long, low long")
    return made.groupBy("key").agg(F.min(F.struct("differ", "near")).alias("best"), F.min("low").alias("low")).select("key", F.col("best.near").alias("near"), "low")


def all_pairs(rows: DataFrame, m: Measure) -> DataFrame:
    """a, b: every pair of classes of different groups that may link."""

    def table(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.record_batch({"a": pa.array(pairs[:, 0].copy()), "b": pa.array(pairs[:, 1].copy())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            key, found, n = g["key"], [], 0
            for i, j, _ in _pairs(g, m):
                found.append(np.stack([np.minimum(key[i], key[j]), np.maximum(key[i], key[j])], axis=1))
                n += len(i)
                if n >= BATCH_PAIRS:
                    yield table(found)
                    found, n = [], 0
            if found:
                yield table(found)

    return rows.repartition("grp").sortWithinPartitions("grp").mapInArrow(lean(run), "a long, b long").distinct()


def segments(sets: DataFrame, keys: DataFrame, m: Measure) -> DataFrame:
    """key, segment, s: the sets of the given classes, cut into segments of the order of hashes.

    Segment -1 holds the set's size and, of large sets, the parities of WIDE_BITS fragments.
    """
    bloom, least = key_filter(keys.select("key")), np.arange(1, SEGMENTS, dtype=np.uint64) << np.uint64(61)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(probably_in(bloom, batch.column(0).to_numpy())))
            keys, at, flat = _rows_of_sets(batch)
            out_keys, out_segments, out = [], [], []
            for key, a, b in zip(keys, at, at[1:], strict=False):
                s = flat[a:b]
                wide = parities(s, WIDE_BITS) if len(s) > 2 * PARITY_BITS else np.empty(0, np.int64)
                out_keys.append(key)
                out_segments.append(-1)
                out.append(np.concatenate([np.array([len(s)], np.int64), wide]))
                for k, part in enumerate(np.split(s, np.searchsorted(s, least))):
                    if len(part):
                        out_keys.append(key)
                        out_segments.append(k)
                        out.append(part.astype(np.int64))
            yield pa.record_batch({"key": pa.array(out_keys, pa.int64()), "segment": pa.array(out_segments, pa.int32()), "s": _lists(out)})

    made = sets.mapInArrow(lean(run), "key long, segment int, s array<long>")
    return made.join(keys.hint("merge"), "key", "left_semi").groupBy("key", "segment").agg(F.first("s").alias("s"))


def verify(pairs: DataFrame, sets: DataFrame, m: Measure) -> DataFrame:
    """a, b: the pairs that link. Common shingles are counted by segment and summed per pair."""
    both = F.explode(F.array("a", "b")).alias("key")
    sketches = only_keys(sets.filter("segment = -1"), key_filter(pairs.select(both).distinct()), "key").select("key", F.get("s", F.lit(0)).alias("n"), F.slice("s", 2, WIDE_BITS // 64).alias("w"))
    p = pairs.join(sketches.withColumnsRenamed({"key": "a", "n": "na", "w": "wa"}).hint("merge"), "a").join(sketches.withColumnsRenamed({"key": "b", "n": "nb", "w": "wb"}).hint("merge"), "b")
    differ = F.when((F.size("wa") > 0) & (F.size("wb") > 0), F.aggregate(F.zip_with("wa", "wb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)).otherwise(0)
    p = p.filter(differ * (m.den + m.num) <= (F.col("na") + F.col("nb")) * (m.den - m.num)).select("a", "b", "na", "nb")
    p = materialize(p, "pairs")
    sets = only_keys(sets.filter("segment >= 0"), key_filter(p.select(both).distinct()), "key")
    left = sets.select(F.col("key").alias("a"), "segment", F.col("s").alias("sa"))
    right = sets.select(F.col("key").alias("b"), "segment", F.col("s").alias("sb"))
    partial = p.join(left.hint("merge"), "a").join(right.hint("merge"), ["b", "segment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("c"))
    whole = partial.groupBy("a", "b", "na", "nb").agg(F.sum("c").alias("c"))
    links = materialize(whole.filter(F.col("c") * (m.den + m.num) >= (F.col("na") + F.col("nb")) * m.num).select("a", "b"), "links")
    discard(p)
    return links


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """key, root: each key that is linked, and the smallest key of its group (alternating large and small stars)."""
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "edges")
    for _ in range(most_rounds):
        # done when every u hangs on one v that hangs on nothing itself
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("key"), F.lit(1).alias("below")), F.struct(F.col("v").alias("key"), F.lit(0).alias("below")))).alias("e")).select("e.*")
        open_ends = ends.groupBy("key").agg(F.sum("below").alias("below"), F.min("below").alias("least")).filter("below > 1 OR below > least")
        if open_ends.isEmpty():
            break
        # large star: neighbours above u are hung on the smallest around u; a hub's edges are dealt over many tasks
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_total(both, "u", "v", F.min("v"), F.min("_part"), "m").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u != v").distinct()
        large = materialize(large, "edges")
        discard(edges)
        # small star: u and its smaller neighbours are hung on the smallest of them
        small = with_total(large, "u", "v", F.min("v"), F.min("_part"), "m")
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        edges = materialize(small, "edges")
        discard(large)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct())


def class_groups(made: DataFrame, m: Measure) -> DataFrame | None:
    """key, root of all classes that link with another, from document_sets; None if there are none.

    Tables go as soon as nothing reads them any more; `made`, which holds all sets, is one of them.
    """
    whole = class_sets(made, m)
    reps = materialize(prefixes(whole, m, heavy_shingles(made)), "classes")
    rows = buckets(reps, m)
    found = materialize(proposals(compared(rows.withColumn("root", F.col("key")), reps), m), "proposals")
    if found.isEmpty():
        discard(made, reps, rows, found)
        return None
    every, rows = rows, materialize(rows.join(found.select("key").hint("merge"), "key", "left_semi"), "buckets")
    sets = materialize(segments(whole, found.select("key"), m), "segments")
    discard(every, made)
    links: DataFrame | None = None
    groups: DataFrame | None = None
    for k in range(BEST_ROUNDS + 1):
        rooted = rows.withColumn("root", F.col("key")) if groups is None else rows.join(groups.hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        if k < BEST_ROUNDS:
            near = proposals(compared(rooted, reps), m) if k else found
            pairs = near.select(F.explode(F.array("near", "low")).alias("o"), "key").select(F.least("o", "key").alias("a"), F.greatest("o", "key").alias("b")).filter("a != b").distinct()
        else:
            pairs = all_pairs(compared(rooted, reps), m)
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            break
        new = verify(pairs, sets, m)
        discard(pairs)
        if new.isEmpty():
            continue
        # the stars of the groups so far stand for their links
        so_far = new if groups is None else new.unionAll(groups.filter("key != root").select(F.col("key").alias("a"), F.col("root").alias("b")))
        groups = materialize(components(so_far), "groups")
        discard(new)
    discard(reps, rows, sets, found)
    return groups


def near_duplicates(docs: DataFrame, m: Measure = Measure()) -> DataFrame:
    """doc_id, n_shingles, component_id for each document: the smallest doc_id that links reach."""
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(document_sets(spread(docs), m), "sets")
    rows = materialize(made.filter("n >= 0").drop("s"), "rows")
    groups = class_groups(made, m)
    firsts = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    if groups is not None:
        firsts = firsts.join(groups.hint("merge"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        # a table of its own, so that the join to a group of very many classes can be dealt over tasks
        roots = materialize(firsts.groupBy("root").agg(F.min("first").alias("first")), "roots")
        firsts = firsts.drop("first").join(roots.hint("merge"), "root").select("key", "first")
    firsts = materialize(firsts, "firsts")
    return rows.join(firsts.hint("merge"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("first")).alias("component_id"))


def linked_classes(docs: DataFrame, m: Measure = Measure()) -> tuple[DataFrame, DataFrame]:
    """All links, inside groups too: a, b (a < b) of each pair of classes that link; and doc_id, n_shingles, key of each document.

    A class is a set of shingles, and documents of one key have equal sets, so they link with each other and with all
    documents of the classes that link with theirs; key is null where there are no shingles. Every possible pair is verified,
    so the work grows with the square of the number of different near copies in a group.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialize(document_sets(spread(docs), m), "sets")
    whole = class_sets(made, m)
    reps = materialize(prefixes(whole, m, heavy_shingles(made)), "classes")
    rows = buckets(reps, m)
    # each class is a group of its own: no pair is left out
    pairs = materialize(all_pairs(compared(rows.withColumn("root", F.col("key")), reps), m), "pairs")
    sets = materialize(segments(whole, pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), m), "segments")
    links = verify(pairs, sets, m)
    discard(reps, rows, pairs, sets)
    return links, made.filter("n >= 0").select("doc_id", F.col("n").alias("n_shingles"), "key")


def op4_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
