"""Token counts with a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, bytes, tokens). A text's content is its UTF-8 bytes
(null: empty); the tokenizer digest covers the vocabulary file and the library's version. Texts whose digest is not in
the cache are encoded once each, whatever the number of copies, and appended to the cache; counts are then joined back
to all documents. Copies within a task are dropped before the shuffle, so a text with a third of all rows crosses it
once a task at most. Rows with many copies of one text are dealt by salts.

Where the tokenizer must cut a text, whatever stands around, its pieces are encoded by themselves: each worker remembers
the number of tokens of pieces, up to a bound (see PieceCounter). Other tokenizers encode whole texts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows and null doc_ids give a row each; an
empty table gives an empty table; extra columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from importlib.metadata import version

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.common import SALTS, Emitter, bound_batches, materialize, rows_of, shared_dir, spread

CACHE = "digest binary, tokenizer string, n_bytes long, n_tokens long"
LIMIT = 512
#: Bytes of text that are counted at once, besides a last text of any length.
FLUSH_BYTES = 4 << 20
_loaded: dict[str, object] = {}


_SPACES, _MARKS, _SURE, _UNSURE, _MARK = b" \t\n\x0b\x0c\r", b".,;:!?", 1, 2, 4
#: What a byte allows if it stands after a cut, and if it stands before one: a space after printable ASCII and, with a second look, after
#: other characters; a mark after an ASCII letter or digit.
_AFTER = bytes(_SURE | _UNSURE if b in _SPACES else _MARK if b in _MARKS else 0 for b in range(256))
_BEFORE = bytes(_UNSURE if b >= 0x80 else _SURE | (_MARK if chr(b).isalnum() else 0) if 0x21 <= b <= 0x7E else 0 for b in range(256))
#: The bytes before the last one of all white space beyond ASCII; what ends like that may be white space.
_BEFORE_LAST = np.isin(np.arange(256), [0xC2, 0x9A, 0x80, 0x81, 0xA0])


def _begins(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin that stand one after another in data and begin at starts."""
    kinds = np.frombuffer(data.translate(_AFTER), np.uint8)[1:] & np.frombuffer(data.translate(_BEFORE), np.uint8)[:-1]
    cut = np.concatenate([[False], kinds & (_SURE | _MARK) > 0])
    at = np.flatnonzero(kinds == _UNSURE) + 1
    cut[at[~_BEFORE_LAST[np.frombuffer(data, np.uint8)[at - 2]]]] = True
    cut[starts[starts < len(data)]] = True
    return np.flatnonzero(cut)


class PieceCounter:
    """Numbers of tokens of texts, for byte-level tokenizers that cut by GPT-2's pattern.

    No match of that pattern goes from a character that is not white space to white space, or from a letter or digit to
    one of the marks, and none looks back: there the text can be cut. Many new pieces are encoded as one text and told apart
    by the number of bytes of its tokens.
    """

    def __init__(self, model, limit: int = 400_000, longest: int = 64):
        self.model, self.limit, self.longest, self.known = model, limit, longest, {}
        added = {i: len(t.content.encode()) for i, t in model.get_added_tokens_decoder().items()}
        vocabulary = model.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = added.get(i, len(token))

    @staticmethod
    def fits(path: str) -> bool:
        """Whether the tokenizer of a .json file cuts texts like that, and no added token goes over a cut."""
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        cutter, model = told.get("pre_tokenizer") or {}, told["model"]
        if told.get("normalizer") or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space", True) or not cutter.get("use_regex", True):
            return False
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return False
        whole = [t for t in told.get("added_tokens") or [] if not (t["single_word"] or t["lstrip"] or t["rstrip"]) and t["content"].isascii() and not set(t["content"].encode()) & set(_SPACES + _MARKS)]
        return len(whole) == len(told.get("added_tokens") or [])

    def _count(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[bytes]) -> list[int]:
        out, inner, others = [0] * len(pieces), [], []
        for i, p in enumerate(pieces):
            (inner if p[0] in _SPACES and 0x21 <= p[-1] <= 0x7E else others).append(i)
        for k in range(0, len(inner), 500):
            part = inner[k : k + 500]
            ends = np.cumsum([len(pieces[i]) for i in part])
            reach = np.cumsum(self.bytes[self._count([b"".join([pieces[i] for i in part]).decode()])[0]])
            n = np.searchsorted(reach, ends, "right")  # tokens that end no later than each piece
            if len(n) and reach[-1] == ends[-1] and (reach[n - 1] == ends).all():
                for i, x in zip(part, np.diff(n, prepend=0).tolist(), strict=True):
                    out[i] = x
            else:  # a byte without a token
                others += part
        for k in range(0, len(others), 5000):
            part = others[k : k + 5000]
            for i, ids in zip(part, self._count([pieces[i].decode() for i in part]), strict=True):
                out[i] = len(ids)
        return out

    def __call__(self, texts: list[bytes]) -> list[int]:
        data = b"".join(texts)
        if not data:
            return [0] * len(texts)
        bounds = np.cumsum([0, *map(len, texts)])
        begins = _begins(data, bounds[:-1])
        offsets = np.append(begins, len(data))
        codes = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        pieces = codes.dictionary.to_pylist()
        if len(self.known) > self.limit:
            self.known.clear()
        found = list(map(self.known.get, pieces))
        missing = [i for i, n in enumerate(found) if n is None]
        for i, n in zip(missing, self._learn([pieces[i] for i in missing]), strict=True):
            found[i] = n
            if len(pieces[i]) <= self.longest:
                self.known[pieces[i]] = n
        total = np.append(0, np.cumsum(np.array(found)[codes.indices.to_numpy()]))
        return np.diff(total[np.searchsorted(begins, bounds)]).tolist()


def tokenizer(path: str):
    """The tokenizer of a .json or .model file, loaded once a process; counts(texts) gives the number of tokens of each (texts in UTF-8)."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode([t.decode() for t in texts], num_threads=1)]
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = PieceCounter(model) if PieceCounter.fits(path) else lambda texts: [len(x) for x in model.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
    return _loaded[path]


def tokenizer_digest(path: str) -> str:
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"\0{library} {version(library)}".encode()).hexdigest()


def _distinct_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[bytes] = set()
    out = Emitter(pa.schema([("digest", pa.binary()), ("text", pa.string())]), 500)
    for (text,) in rows_of(batches, "text"):
        digest = hashlib.sha256(text).digest()
        if digest in seen:
            continue
        if len(seen) >= 500_000:
            seen.clear()
        seen.add(digest)
        if out.add(digest, text.decode()):
            yield out.take()
    yield out.take()


def count_tokens(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each document; new digests are appended to the cache folder."""
    spark, version_digest = docs.sparkSession, tokenizer_digest(path)
    bound_batches(spark)
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    # the table exists from here on, though it may be empty
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    known = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version_digest)
    misses = texts.select("text").mapInArrow(_distinct_texts, "digest binary, text string").join(known.select("digest"), "digest", "left_anti").repartition("digest")
    schema = pa.schema([("digest", pa.binary()), ("tokenizer", pa.string()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, pending, held, out = tokenizer(path), set(), [], 0, Emitter(schema, 20_000)

        def flush() -> None:
            for (digest, text), n in zip(pending, counts([t for _, t in pending]), strict=True):
                out.add(digest, version_digest, len(text), n)
            pending.clear()

        for digest, text in rows_of(batches, "digest", "text"):
            if digest in seen:
                continue
            seen.add(digest)
            pending.append((digest, text))
            held += len(text)
            if len(pending) >= 2_000 or held >= FLUSH_BYTES:
                flush()
                held = 0
                if len(out.columns[0]) >= out.limit:
                    yield out.take()
        flush()
        yield out.take()

    misses.mapInArrow(encode, CACHE).write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).filter(F.col("tokenizer") == version_digest)
    stored = materialize(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    # counts go to the salts of a digest before rows do, so a text with a third of all rows is joined in many tasks
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    keyed = materialize(texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), salt.alias("salt")), "token-keys")
    dealt = keyed.select("digest", "salt").distinct().join(stored.hint("merge"), "digest")
    return keyed.join(dealt.hint("merge"), ["digest", "salt"], "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # a cache of its own for each run, so that nothing of an earlier run is reused
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), shared_dir(spark, "token-cache"))
