"""WARC: a PySpark Python data source that writes and reads WARC/1.1 archives.

Writing: each task writes archives under names of their own; committing writes one manifest that lists those of successful
tasks, so nothing is renamed, and what a lost or repeated task left behind is not read. Reading: the driver lists the
archives (where there are manifests, those they list; else, in a folder of foreign archives, all) and packs them into
partitions by size, an archive being the least unit; predicates on record type and header fields are pushed into the reader, which parses headers first
and steps over the payloads of records that it drops (or of all, with payload=false) without reading or decoding them.

Options: path; payload (true); partition_bytes for reading; compress (true: one gzip member a record, with its length in
the member's extra field, so that it can be stepped over), archive_bytes and date for writing.

`dedupe_payloads` turns pages into response and revisit records. Of rows with equal payloads of at least `least` bytes,
those with the smallest page_id are responses, others revisit it. Defined results: a null html is an empty payload; rows
with null page_id revisit a page that has one, and are all responses where none has; repeated rows of the smallest
page_id are all responses; null URLs write no target header; an empty table writes no archive; extra columns are
ignored; payloads are written whole, whatever their length.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from ladle.llm.common import file_system, shared_dir

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
#: Fixed header names of the format, by column.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
WRITTEN = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary"
LEAST_BYTES, SALTS = 100, 32
#: How names of manifests begin; a manifest has the name of an archive a line.
MANIFEST = "_manifest-"
_ARROW = pa.schema(
    [("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())]
)


@dataclass
class Archives(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class _Plain:
    """Random access through a window, so that payloads can be stepped over."""

    def __init__(self, file: pa.NativeFile, window: int = 1 << 18):
        self.file, self.size, self.window, self.at = file, file.size(), window, 0
        self.start, self.data = 0, b""

    def _fill(self, n: int) -> bytes:
        end = min(self.size, self.at + n)
        if not (self.start <= self.at and end <= self.start + len(self.data)):
            self.start, self.data = self.at, self.file.read_at(min(max(n, self.window), self.size - self.at), self.at)
        return self.data[self.at - self.start : end - self.start]

    def head(self) -> bytes | None:
        """The bytes up to the next empty line, which is passed over; None at the end."""
        n = 4096
        while self.at < self.size:
            got = self._fill(n)
            k = got.find(b"\r\n\r\n")
            if k >= 0:
                self.at += k + 4
                return got[:k]
            if len(got) < n:
                raise ValueError("a WARC record's header has no end")
            n *= 4
        return None

    def read(self, n: int) -> bytes:
        got = self._fill(n)
        self.at += n
        return got

    def skip(self, n: int) -> None:
        self.at += n


class _Gzip:
    """The same for archives of one gzip member a record.

    Members whose extra field tells their length are stepped over without inflating more than the record's header; the
    payloads of others must be inflated to find the next member.
    """

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.start, self.next = file, file.size(), 0, 0
        self.window = _Plain(file)

    def _open(self) -> None:
        self.window.at = self.start = self.next
        head = self.window.read(min(24, self.size - self.start))
        self.next = None
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            self.next = self.start + struct.unpack("<I", head[16:20])[0] or None
        self.at, self.inflate, self.out = self.start, zlib.decompressobj(31), b""

    def _more(self, n: int) -> bool:
        """Inflate some more; False at the member's end."""
        if self.inflate.eof or self.at >= self.size:
            return False
        self.window.at = self.at
        data = self.window.read(min(n, (self.next or self.size) - self.at))
        self.at += len(data)
        self.out += self.inflate.decompress(data)
        if self.inflate.eof and self.next is None:
            self.next = self.at - len(self.inflate.unused_data)
        return True

    def head(self) -> bytes | None:
        if self.next is None:
            while self._more(1 << 16):
                self.out = b""
            self.next = self.next or self.size
        if self.next >= self.size:
            return None
        self._open()
        while (k := self.out.find(b"\r\n\r\n")) < 0:
            if not self._more(2048):
                raise ValueError("a WARC record's header has no end")
        got, self.out = self.out[:k], self.out[k + 4 :]
        return got

    def read(self, n: int) -> bytes:
        while len(self.out) < n and self._more(1 << 18):
            pass
        got, self.out = self.out[:n], self.out[n:]
        return got

    def skip(self, n: int) -> None:
        """Nothing to do: head() goes on at the next member."""


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length and that of its content in the extra field "sl"; 0 where they are too large."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 24 + len(body) + 8
    lengths = (size, len(data)) if max(size, len(data)) < 1 << 32 else (0, 0)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + struct.pack("<II", *lengths) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def _headers(block: bytes) -> dict[str, str]:
    """Field values by name; a line that starts with a space continues the one before; of repeated fields the first counts."""
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip()
        out.setdefault(last, value.strip())
    return out


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.payload, self.target = options["path"], options.get("payload", "true").lower() == "true", int(options.get("partition_bytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes =, IN and startswith on header columns; the others are left to Spark."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, EqualTo):
                self.tests.append((FIELDS[column], "in", (f.value,)))
            elif column in FIELDS and isinstance(f, In):
                self.tests.append((FIELDS[column], "in", tuple(f.value)))
            elif column in FIELDS and isinstance(f, StringStartsWith):
                self.tests.append((FIELDS[column], "prefix", f.value))
            else:
                yield f

    def partitions(self) -> list[Archives]:
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        scheme = self.path[: self.path.index(root)] if root in self.path else ""
        if info.type == pafs.FileType.Directory:
            files = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File]
            found = [i for i in files if i.path.endswith((".warc", ".warc.gz"))]
            manifests = [i.path for i in files if i.base_name.startswith(MANIFEST)]
            if manifests:
                listed = {name for path in manifests for name in _lines_of(fs, path)}
                found = [i for i in found if i.base_name in listed]
        else:
            found = [info] if info.type == pafs.FileType.File else []
        out, paths, size = [], [], 0
        for i in sorted(found, key=lambda i: i.path):
            if paths and size + i.size > self.target:
                out.append(Archives(paths))
                paths, size = [], 0
            paths.append(scheme + i.path)
            size += i.size
        return [*out, Archives(paths)]

    def _wanted(self, h: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            got = h.get(name)
            if got is not None and name in ("WARC-Record-ID", "WARC-Refers-To"):
                got = got.strip("<>")
            if got is None or (got not in value if kind == "in" else not got.startswith(value)):
                return False
        return True

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            fs, name = file_system(path)
            with fs.open_input_file(name) as file:
                source = _Gzip(file) if name.endswith(".gz") else _Plain(file)
                while (block := source.head()) is not None:
                    h = _headers(block)
                    length = int(h.get("Content-Length", 0))
                    if not self._wanted(h):
                        source.skip(length + 4)
                        continue
                    payload, n = None, length
                    if h.get("Content-Type", "").startswith("application/http") and (self.payload or "X-Payload-Length" not in h):
                        body = source.read(length)
                        head, _, rest = body.partition(b"\r\n\r\n")
                        n = int(_headers(head).get("Content-Length", len(rest)))
                        payload = rest if self.payload and h.get("WARC-Type") != "revisit" else None
                        source.skip(4)
                    elif self.payload and not h.get("Content-Type", "").startswith("application/http"):
                        payload = source.read(length)
                        source.skip(4)
                    else:
                        n = int(h.get("X-Payload-Length", length))
                        source.skip(length + 4)
                    ids = [h[f].strip("<>") if f in h else None for f in ("WARC-Record-ID", "WARC-Refers-To")]
                    rows.append((h.get("WARC-Type"), ids[0], h.get("WARC-Target-URI"), h.get("WARC-Date"), ids[1], h.get("WARC-Payload-Digest"), n, list(h.items()), payload))
                    size += len(payload or b"") + 500
                    if size > 8 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _lines_of(fs: pafs.FileSystem, path: str) -> list[str]:
    with fs.open_input_stream(path) as f:
        return f.read().decode().splitlines()


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict, date: str) -> bytes:
    """One record. A response holds the payload behind an HTTP header; a revisit only that header."""
    kind, length = row["record_type"], row["payload_length"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    block = http if kind == "revisit" else http + (row["payload"] or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", date)]
    if row["target_uri"] is not None:
        fields.append(("WARC-Target-URI", _clean(row["target_uri"])))
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{row['refers_to']}>")]
    fields += [("WARC-Payload-Digest", row["payload_digest"]), ("X-Payload-Length", str(length)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.archive, self.date = options["path"].rstrip("/"), int(options.get("archive_bytes", 256 << 20)), options.get("date", "1970-01-01T00:00:00Z")
        self.compress = options.get("compress", "true").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        paths, stream, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if stream is None or size >= self.archive:
                    if stream is not None:
                        stream.close()
                    paths.append(f"{root}/part-{TaskContext.get().partitionId():06d}-{len(paths):04d}-{uuid.uuid4().hex}.warc{'.gz' * self.compress}")
                    stream, size = fs.open_output_stream(paths[-1], compression=None, buffer_size=1 << 20), 0
                data = record_bytes(row, self.date)
                data = gzip_member(data) if self.compress else data
                stream.write(data)
                size += len(data)
        if stream is not None:
            stream.close()
        return Written(paths)

    def commit(self, messages) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}{uuid.uuid4().hex}") as f:
            f.write("".join(p.rpartition("/")[2] + "\n" for m in messages if m for p in m.paths).encode())

    def abort(self, messages) -> None:
        fs, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m else ():
                fs.delete_file(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_warc(records: DataFrame, path: str, compress: bool = True) -> None:
    """Write records that have the columns WRITTEN."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSource)
    records.select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in WRITTEN.split(", "))).write.format("warc").option("compress", str(compress).lower()).mode("append").save(path)


def dedupe_payloads(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Records (the columns WRITTEN) of pages(page_id, url, html).

    A payload that many pages share is dealt by salts over many tasks; only groups of two or more are replicated.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    shared = rows.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1 AND first IS NOT NULL")
    shared = shared.select(F.col("digest").alias("s_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s_salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    found = salted.join(shared, (F.col("digest") == F.col("s_digest")) & (F.col("salt") == F.col("s_salt")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return found.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("n").alias("payload_length"),
        F.when(~revisit, F.col("html").cast("binary")).alias("payload"),
    )


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_warc(dedupe_payloads(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("null")).cast("long")
    back = read_warc(spark, path)
    whole = F.col("record_type") == "response"
    return back.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(whole, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(whole, F.sha2(F.col("payload"), 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""
