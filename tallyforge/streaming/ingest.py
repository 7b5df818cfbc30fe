"""Streams of records with exactly-once results: the checkpoint knows the files, the key knows the records."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed_later, shared_dir


def source(spark: SparkSession, path: str, pattern: str = "*", max_files: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder (or of one file)."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    folder, _, name = path.rpartition("/")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(hadoop).isDirectory():
        return reader.option("pathGlobFilter", pattern).parquet(path)
    return reader.option("pathGlobFilter", name).parquet(folder)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which stateful processors need; afterwards the session has its own setting again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> None:
    """Run a stream over what is there now and append it to a Parquet table; a second run adds only what is new."""
    if prepare is None:
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
        return

    def batch(df: DataFrame, number: int) -> None:
        prepare(df, number).write.mode("overwrite").parquet(f"{target}/batch={number}")  # a batch that is run again replaces itself

    stream.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def fresh(spark: SparkSession) -> str:
    """A new folder in the shared one, which goes when the application ends."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    removed_later(spark, base)
    return base


def result(spark: SparkSession, stream: DataFrame, mode: str = "append", prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """What a stream gives over what is there now, as a table in the shared folder."""
    base = fresh(spark)
    drain(stream, f"{base}/out", f"{base}/checkpoint", mode, prepare)
    return spark.read.parquet(f"{base}/out")


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first record of each key; the state holds the keys."""
    return stream.dropDuplicates(keys)


def resumed(known: DataFrame, keys: list[str]) -> Callable[[DataFrame, int], DataFrame]:
    """A batch's records without those that are known already."""

    def prepare(df: DataFrame, number: int) -> DataFrame:
        return df.join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)

    return prepare


def windowed(stream: DataFrame, ts: str, late: str, length: str, *keys: str) -> DataFrame:
    """Counts by event-time window; what is later than ``late`` is dropped. An extension: the batch operators need no event time."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length), *keys).agg(F.count("*").alias("n"))
