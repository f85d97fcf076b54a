"""Sessions with the settings that the engine expects."""

from __future__ import annotations

import atexit
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "ladle", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; settings are Spark's, with _ for dots."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local session without that setting (tests) takes a folder of its own; any other raises."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (root or "file:///tmp/ladle-shared").rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, with its partitions as they are: cuts the lineage and survives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def written(name: str, *frames: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The rows of all frames (of one schema), written one after another to the shared folder as Parquet, in a folder for each
    value of `by`, and read back. The table goes when the driver ends."""
    df = frames[0]
    path = f"{shared_root(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    for frame in frames:
        frame.write.mode("append").partitionBy(*by).parquet(path)
    fs, place = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    atexit.register(lambda: fs.get_file_info(place).type == pafs.FileType.Directory and fs.delete_dir(place))
    return df.sparkSession.read.schema(df.schema).parquet(path)
