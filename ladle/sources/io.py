"""Sources and sinks: JSON-array collections, JSON lines, images, OCR readings, versioned overwrites."""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.functions import text as t
from ladle.operators.lines import slice_line
from ladle.schemas import TOLD
from ladle.sources import tail

MAX_IMAGE_BYTES = 10 * 1024 * 1024


def read_collection(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A collection stored as one JSON array a file; unreadable files raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def empty_collection(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


class Conflict(Exception):
    """Another writer has committed since the version that a change was made from."""


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, the path in it, and a maker of paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make(path), make


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions, from 0."""
    fs, folder, _ = _files(spark, f"{root}/_pointers")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n) for n in names if n.isdigit())


def _version(spark: SparkSession, root: str, number: int) -> str:
    """What the pointer of a number says."""
    fs, path, _ = _files(spark, f"{root}/_pointers/{number:012d}")
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _point(spark: SparkSession, root: str, number: int, version: str) -> bool:
    """Make the pointer of a number, whole, unless another writer has made it: local files are linked, others are renamed,
    and neither replaces what is there."""
    fs, own, make = _files(spark, f"{root}/_pointers/_{uuid.uuid4().hex}")
    pointer = make(f"{root}/_pointers/{number:012d}")
    fs.mkdirs(own.getParent())
    if fs.getScheme() != "file":
        out = fs.create(own, False)
        out.write(bytearray(version.encode()))
        out.close()
        made = not fs.exists(pointer) and fs.rename(own, pointer)
        if not made:
            fs.delete(own, False)
        return made
    name = own.toUri().getPath()
    with open(name, "x") as f:
        f.write(version)
    try:
        os.link(name, pointer.toUri().getPath())
    except FileExistsError:
        return False
    finally:
        os.unlink(name)
    return True


def current_number(spark: SparkSession, root: str) -> int:
    """The number of the last version; -1 before there is one."""
    return max(_numbers(spark, root), default=-1)


def write_collection(df: DataFrame, root: str, expected: int | None = None) -> str:
    """Write a new version below root and then a pointer to it; pointers are never changed, so readers see the old rows or the
    new ones at any moment.

    Of writers at once each gets a number of its own, and the highest is current. With expected (the number that df was made
    from), Conflict is raised if there is a newer version; nothing has changed then.
    """
    spark, version = df.sparkSession, f"v{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    while True:
        now = current_number(spark, root)
        if expected is not None and now != expected:
            fs, path, _ = _files(spark, f"{root}/{version}")
            fs.delete(path, True)
            raise Conflict(f"version {now} came after {expected}")
        if _point(spark, root, now + 1, version):
            return version


def update_collection(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], most_tries: int = 20) -> str:
    """Commit change(current rows); when another writer was faster, the change is made again from what that one wrote."""
    for _ in range(most_tries):
        number = current_number(spark, root)
        try:
            return write_collection(change(read_version(spark, root, number)), root, number)
        except Conflict:
            continue
    raise Conflict(f"other writers were faster {most_tries} times")


def read_version(spark: SparkSession, root: str, number: int) -> DataFrame:
    if number < 0:
        raise FileNotFoundError(f"nothing was written to {root} yet")
    return spark.read.parquet(f"{root}/{_version(spark, root, number)}")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The version of the last pointer."""
    return read_version(spark, root, current_number(spark, root))


def remove_old(spark: SparkSession, root: str, keep: int = 2, orphan_s: float = 86_400) -> list[str]:
    """Delete the versions before the last `keep`, and what failed writes left behind: folders that no pointer names and that
    are older than orphan_s (a younger one may be about to be pointed to)."""
    fs, folder, _ = _files(spark, root)
    pointed = [_version(spark, root, n) for n in _numbers(spark, root)]
    old, kept, gone = pointed[:-keep], set(pointed[-keep:]), []
    for status in fs.listStatus(folder) if fs.exists(folder) else []:
        name = status.getPath().getName()
        orphan = name not in pointed and time.time() - status.getModificationTime() / 1000 >= orphan_s
        if name.startswith("v") and name not in kept and (name in old or orphan):
            fs.delete(status.getPath(), True)
            gone.append(name)
    return gone


def append_log(df: DataFrame, path: str) -> None:
    """JSON lines, appended."""
    df.write.mode("append").json(path)


def tail_log(spark: SparkSession, path: str, schema: str, n: int = 100) -> DataFrame:
    """The entries of the last n lines of a log, in their order, of the last written ones if it has several files (by name); lines
    that are not JSON are left out. Only the ends of files are read."""
    spark.dataSource.register(tail.LogTail)
    lines = spark.read.format("log_tail").option("lines", n).load(path)
    last = lines.orderBy(F.desc("file"), F.desc("at")).limit(n)
    entry = F.from_json("line", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    return last.select("file", "at", entry.alias("e")).filter("e._bad IS NULL").orderBy("file", "at").select("e.*").drop("_bad")


def follow_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The entries of a log as a stream, as its files grow; lines that are not JSON are left out."""
    spark.dataSource.register(tail.LogTail)
    entry = F.from_json("line", f"{schema}, _bad STRING", {"columnNameOfCorruptRecord": "_bad"})
    return spark.readStream.format("log_tail").load(path).select(entry.alias("e")).filter("e._bad IS NULL").select("e.*").drop("_bad")


def ring_buffer(df: DataFrame, order: str, kept: int = 1000, returned: int = 100) -> DataFrame:
    """What a buffer of the latest `kept` rows returns: its latest `returned`, newest first."""
    return df.orderBy(F.desc(order)).limit(min(kept, returned))


def read_images(spark: SparkSession, path: str, most: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Image files of at most `most` bytes."""
    return spark.read.format("binaryFile").load(path).filter((F.col("length") > 0) & (F.col("length") <= most))


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """OCR readings that other programs stored, one JSON object a line, as `value` of type VARIANT; lines that are not JSON are left out."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("value"))
    return lines.filter(F.col("value").isNotNull() & F.schema_of_variant("value").startswith("OBJECT"))


def seen_schema(readings: DataFrame) -> str:
    """The type that all readings together have."""
    return readings.agg(F.schema_of_variant_agg("value")).first()[0]


def candidates(readings: DataFrame, *columns: str) -> DataFrame:
    """columns, text, words, lines, items, avg_confidence, word_count and alpha_words of readings of either shape.

    `{items, raw_text, words, avg_confidence}`: words have their own boxes. `{raw_text, lines}`: lines have a box and a
    confidence from 0 to 1, and words are cut from them by their share of the line. Readings without items, words and lines are left out.
    """
    get = lambda path, kind: F.try_variant_get("value", f"$.{path}", kind)
    own = F.filter(get("words", "array<struct<word:string,x:double,y:double,w:double,h:double,conf:double>>"), lambda w: t.strip(w["word"]) != "")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    box = lambda x, y, w, h: F.struct(x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"))
    boxed = F.transform(own, lambda w: F.struct(w["word"].alias("text"), box(zero(w["x"]), zero(w["y"]), zero(w["w"]), zero(w["h"])).alias("bbox"), F.round(zero(w["conf"])).alias("confidence")))
    lines = get("lines", "array<struct<text:string,conf:double,box:array<double>>>")
    edge = lambda x, k: zero(F.get(x["box"], F.lit(k)))
    cut = F.flatten(
        F.transform(
            lines,
            lambda x: F.transform(
                slice_line(F.coalesce(x["text"], F.lit("")), edge(x, 0), edge(x, 2) - edge(x, 0)),
                lambda w: F.struct(w["text"].alias("text"), box(w["x"], edge(x, 1), w["w"], edge(x, 3) - edge(x, 1)).alias("bbox"), F.round(zero(x["conf"]) * 100).alias("confidence")),
            ),
        )
    )
    none = F.array().cast(TOLD)
    items = get("items", "array<struct<name:string,description:string,price:double,category:string,confidence:double>>")
    rows = readings.select(
        *columns, F.coalesce(get("raw_text", "string"), F.lit("")).alias("text"), F.coalesce(boxed.cast(TOLD), cut.cast(TOLD), none).alias("words"), lines.alias("lines"),
        F.coalesce(items, F.array().cast("array<struct<name:string,description:string,price:double,category:string,confidence:double>>")).alias("items"), zero(get("avg_confidence", "double")).alias("avg_confidence"),
    )
    long = F.filter(F.split("text", r"(?U)\s+"), lambda w: F.length(w) > 2)
    counts = rows.withColumns({"word_count": F.size(long), "alpha_words": F.size(F.filter(long, lambda w: w.rlike(r"\p{L}{3,}")))})
    return counts.filter((F.size("items") > 0) | (F.size("words") > 0))


def image_size_ok(length: str = "length", most: int = MAX_IMAGE_BYTES):
    return F.col(length).between(1, most)
