"""Token-ID / binary output: documents as token ids in files of directly addressable codes (see dac.py).

Documents are dealt by ranges of doc_id (rows of one doc_id, or of none, further by the first `SPLIT_CHARS` characters of
their texts), sorted and encoded, one file a range, and as many ranges as the input has splits or a shuffle partitions; the manifest of the files that
successful tasks wrote (one row a file) gives each file its place in the whole. A repeated or lost task writes a file of
another name, and only the one in the manifest counts.

The tokenizer lower-cases and drops white space, so what stands between two ASCII white-space characters is encoded by
itself: each worker remembers the ids of such words, up to a bound.

Defined results: null and empty texts hold only the end id; null doc_ids come first; rows with the same doc_id stand
together, in order of their text; repeated rows give a row each; an empty table gives an empty table; extra columns are
ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import os
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm import dac
from ladle.llm.common import Emitter, bound_batches, file_system, shared_dir

END_ID, SPLIT_CHARS = 2, 64
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, through a bounded memory of the ids of words.

    A word is encoded in lower case, as the tokenizer does, and closing ASCII punctuation apart from the word. Words of letters
    only are one unit of the tokenizer each, so many are encoded as one text and told apart by their last tokens; those of
    ASCII letters need neither its normalizer nor its pattern. When `known` has half the words allowed, it becomes `older`
    and only words that are met again are taken over.
    """

    def __init__(self, path: str, limit: int = 400_000, longest: int = 64):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model, self.plain, self.limit, self.longest, self.known, self.older = Tokenizer.from_file(path), Tokenizer.from_file(path), limit, longest, {}, {}
        for model in (self.model, self.plain):
            model.no_truncation()
            model.no_padding()
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.marks = [b""] * 256
        for mark in string.punctuation:
            self.marks[ord(mark)] = np.array(self.model.encode(mark, add_special_tokens=False).ids, dtype="<u4").tobytes()

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that are in the form in which they are encoded."""
        out, ascii_letters, letters, others = {}, [], [], []
        for w in words:
            # bytes: only ASCII letters count
            (others if len(w) > self.longest else ascii_letters if w.isalpha() and w.islower() else letters if w.decode().isalpha() else others).append(w)
        for model, group in ((self.plain, ascii_letters), (self.model, letters)):
            for k in range(0, len(group), 512):
                part = group[k : k + 512]
                ids = np.array(model.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, dtype="<u4")
                ends = (np.flatnonzero(self.last[ids]) + 1) * 4
                if len(ends) == len(part):
                    data, ends = ids.tobytes(), ends.tolist()
                    out.update(zip(part, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
                else:  # the tokenizer's letters are not Python's
                    others += part
        for k in range(0, len(others), 5000):
            part = others[k : k + 5000]
            out.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(part, self.model.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True))
        return out

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words."""
        if len(self.known) > self.limit // 2:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        lacking = list(map(words.__getitem__, missing))
        again = list(map(self.older.get, lacking))
        learnt = self._learn([w for w, ids in zip(lacking, again, strict=True) if ids is None])
        for i, w, ids in zip(missing, lacking, again, strict=True):
            found[i] = ids = learnt[w] if ids is None else ids
            if len(w) <= self.longest:
                self.known[w] = ids
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column of strings one after another, and where those of each text begin (and the last ones end).

        Arrow splits words, lower-cases them, cuts closing punctuation off and tells them apart; only distinct ones are
        looked up. Punctuation is cut off after ASCII letters and digits and the letters from U+00C0 to U+00FF.
        """
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten()
        words = words.cast(pa.large_binary() if pa.types.is_large_string(words.type) else pa.binary())
        lower = pc.ascii_lower(lists.flatten()).cast(words.type)
        core = pc.ascii_rtrim(lower.cast(lists.type.value_type), characters=string.punctuation).cast(words.type)
        special = pc.match_substring(words, b"<|").to_numpy(zero_copy_only=False)  # may hold a special token, whose case counts
        cut, last = _lengths(lower) - _lengths(core), _last_bytes(core)
        apart = ~special & (_ALNUM[last] | (_LATIN[last] & (_last_bytes(core, 2) == 0xC3)))
        core = pc.if_else(pa.array(apart), core, pc.if_else(pa.array(special), words, lower))
        codes = core.dictionary_encode()
        ids = self._ids(codes.dictionary.to_pylist())
        pieces = np.empty(2 * len(words), np.int64)
        pieces[::2] = codes.indices.to_numpy()
        pieces[1::2] = len(ids) + np.where(apart & (cut == 1), _last_bytes(lower), 0).astype(np.int64)
        ids += self.marks
        several = np.flatnonzero(apart & (cut > 1))
        for n in np.unique(cut[several]).tolist():
            at = several[cut[several] == n]
            tails = pc.binary_slice(lower.take(pa.array(at)), -n).dictionary_encode()
            pieces[2 * at + 1] = len(ids) + tails.indices.to_numpy()
            ids += self._ids(tails.dictionary.to_pylist())
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool, starts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(lengths) - lengths
        n = lengths[pieces]
        ends = np.concatenate([[0], np.cumsum(n)])
        flat = pool[np.repeat(starts[pieces] - ends[:-1], n) + np.arange(ends[-1])]
        return flat, ends[2 * lists.offsets.to_numpy().astype(np.int64)]


_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
#: Last bytes of the letters from U+00C0 to U+00FF, whose first byte is C3.
_LATIN = np.array([0x80 <= b <= 0xBF and b not in (0x97, 0xB7) for b in range(256)])


def _buffers(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array."""
    kind = np.int64 if pa.types.is_large_string(strings.type) or pa.types.is_large_binary(strings.type) else np.int32
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, kind, len(strings) + 1, strings.offset * np.dtype(kind).itemsize) if len(strings) else np.zeros(1, kind)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)


def _lengths(strings: pa.Array) -> np.ndarray:
    return np.diff(_buffers(strings)[0])


def _last_bytes(strings: pa.Array, back: int = 1) -> np.ndarray:
    """The last byte of each string, or that so far back; 0 of a shorter one."""
    at, data = _buffers(strings)
    return np.where(np.diff(at) >= back, data[np.maximum(at[1:] - back, 0)], 0)


def _slices(texts: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a string column of about `most` bytes each (one text at least)."""
    sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, files: int | None = None) -> list[tuple[str, int, int]]:
    """Write the files and return the manifest: path, first id's place in the whole, number of ids, in order."""
    spark = docs.sparkSession
    bound_batches(spark)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64())])
    end = np.uint32(end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, writer, out = TaskContext.get().partitionId(), WordEncoder.of(tokenizer_path), None, Emitter(schema)
        path = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.dac"
        store, name = file_system(path)
        stream = None
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            if writer is None and doc_ids:
                stream = store.open_output_stream(name)
                writer = dac.Writer(stream)
            for start, stop in _slices(texts):
                flat, at = encoder.encode(texts[start:stop])
                for k in range(start, stop):
                    writer.add(doc_ids[k], np.append(flat[at[k - start] : at[k - start + 1]], end))
        if writer is not None:
            writer.close()
            stream.close()
            out.add(part, path, writer.n_ids)
        yield out.take()

    dealt = rows.repartitionByRange(files, F.col("doc_id").asc_nulls_first(), F.substring("text", 1, SPLIT_CHARS)).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest, at = [], 0
    for r in sorted(dealt.mapInArrow(write, "part int, path string, n_ids long").collect(), key=lambda r: r.part):
        manifest.append((r.path, at, r.n_ids))
        at += r.n_ids
    return manifest


def read_token_files(spark, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; one file a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Emitter(schema, 20_000)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, name = file_system(path)
                with fs.open_input_file(name) as f:
                    for doc_id, start, ids in dac.Reader(f.read_at, f.size()).documents():
                        if out.add(doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())):
                            yield out.take()
        yield out.take()

    files = spark.createDataFrame(manifest, "path string, base long, n_ids long")
    if len(manifest) > 1:
        files = files.repartition(len(manifest))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Write docs as token files in the shared folder and describe each document as read back from them."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, tokenizer_path, shared_dir(spark, "token-ids"), end_id))


def op10_token_ids(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
