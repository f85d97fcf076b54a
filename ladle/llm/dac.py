"""A file of token ids in directly addressable codes.

An id is cut into chunks of `BITS` bits. Level l holds the l-th chunk of every id that has one, in order; a bitmap says
for each of them whether the id goes on, and a rank directory holds the number of ones before each block of the bitmap.
Token i is found by reading chunk i, and, while the bit is set, going on at the bit's rank in the next level: no block
is decoded. A file is a row of segments (each with its levels), a directory of segments and documents, and a footer.

Layout, little endian: "DAC1", segments, directory, u64 length of the directory, "DAC1".
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, BITS, BLOCK = b"DAC1", 8, 512


def encode_segment(ids: np.ndarray) -> bytes:
    """Levels of one segment: u32 number of levels, then for each u64 count, chunks, and (but for the last) bitmap and directory."""
    rest, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        goes_on = rest >> BITS
        chunks = (rest & ((1 << BITS) - 1)).astype(np.uint8)
        more = goes_on > 0
        if not more.any():
            levels.append((chunks, None))
            break
        levels.append((chunks, more))
        rest = goes_on[more]
    out = [struct.pack("<I", len(levels))]
    for chunks, more in levels:
        out += [struct.pack("<QB", len(chunks), more is not None), chunks.tobytes()]
        if more is not None:
            padded = np.zeros(-(-len(more) // BLOCK) * BLOCK, dtype=bool)
            padded[: len(more)] = more
            before = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(axis=1))])[:-1]
            out += [np.packbits(padded, bitorder="little").tobytes(), before.astype("<u4").tobytes()]
    return b"".join(out)


class Segment:
    """Random access to the ids of one encoded segment."""

    def __init__(self, data: bytes | memoryview):
        self.levels, at = [], 4
        for _ in range(struct.unpack_from("<I", data, 0)[0]):
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = before = None
            if more:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                at += blocks * BLOCK // 8
                before = np.frombuffer(data, "<u4", blocks, at)
                at += blocks * 4
            self.levels.append((chunks, bits, before))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def slice(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        """The ids from start to stop; of each level only their own chunks, and bits from their block's start, are read."""
        chunks, bits, before = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        if bits is None or start >= stop:
            return out
        first = start // BLOCK
        read = np.unpackbits(bits[first * BLOCK // 8 : -(-stop // 8)], bitorder="little")
        more = read[start - first * BLOCK : stop - first * BLOCK].astype(bool)
        n = int(more.sum())
        if n:
            rank = int(before[first]) + int(read[: start - first * BLOCK].sum())
            out[more] |= self.slice(rank, rank + n, level + 1) << BITS
        return out

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])


class Writer:
    """Writes documents one after another to an open binary stream."""

    def __init__(self, stream, segment_ids: int = 1 << 21):
        self.stream, self.limit, self.at = stream, segment_ids, 0
        self.pending: list[np.ndarray] = []
        self.n_pending = self.n_ids = 0
        self.segments: list[tuple[int, int, int]] = []
        self.doc_ids: list[int] = []
        self.null: list[bool] = []
        self.starts: list[int] = []
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.null.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.pending.append(ids)
        self.n_pending += len(ids)
        self.n_ids += len(ids)
        if self.n_pending >= self.limit:
            self._flush()

    def _flush(self) -> None:
        if self.n_pending:
            data = encode_segment(np.concatenate(self.pending))
            self.segments.append((self.n_ids - self.n_pending, self.at, len(data)))
            self._write(data)
        self.pending, self.n_pending = [], 0

    def close(self) -> None:
        self._flush()
        directory = b"".join(
            [
                struct.pack("<QQQ", len(self.segments), len(self.doc_ids), self.n_ids),
                np.array(self.segments, dtype="<u8").tobytes(),
                np.array(self.doc_ids, dtype="<i8").tobytes(),
                np.array(self.null, dtype=np.uint8).tobytes(),
                np.array(self.starts, dtype="<u8").tobytes(),
            ]
        )
        self._write(directory + struct.pack("<Q", len(directory)) + MAGIC)


class Reader:
    """Reads a file through read_at(length, offset), a segment at a time."""

    def __init__(self, read_at, size: int):
        self.read_at = read_at
        tail = read_at(12, size - 12)
        if tail[8:] != MAGIC:
            raise ValueError("not a file of token ids")
        length = struct.unpack("<Q", tail[:8])[0]
        d = read_at(length, size - 12 - length)
        n_segments, n_docs, self.n_ids = struct.unpack_from("<QQQ", d, 0)
        at = 24
        self.segments = np.frombuffer(d, "<u8", 3 * n_segments, at).reshape(-1, 3)
        at += 24 * n_segments
        self.doc_ids = np.frombuffer(d, "<i8", n_docs, at)
        at += 8 * n_docs
        self.null = np.frombuffer(d, np.uint8, n_docs, at).astype(bool)
        self.starts = np.append(np.frombuffer(d, "<u8", n_docs, at + n_docs), np.uint64(self.n_ids)).astype(np.int64)
        self._held: tuple[int, Segment | None] = (-1, None)

    def _segment(self, k: int) -> Segment:
        if self._held[0] != k:
            self._held = (k, Segment(self.read_at(int(self.segments[k][2]), int(self.segments[k][1]))))
        return self._held[1]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to stop of the whole file."""
        parts = []
        while start < stop:
            k = int(np.searchsorted(self.segments[:, 0], start, side="right")) - 1
            first, segment = int(self.segments[k][0]), self._segment(k)
            end = min(stop, first + len(segment))
            parts.append(segment.slice(start - first, end - first))
            start = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def __getitem__(self, i: int) -> int:
        return int(self.ids(i, i + 1)[0])

    def documents(self):
        """doc_id (or None), start and ids of each document, in the file's order."""
        for k in range(len(self.doc_ids)):
            start, stop = int(self.starts[k]), int(self.starts[k + 1])
            yield None if self.null[k] else int(self.doc_ids[k]), start, self.ids(start, stop)
