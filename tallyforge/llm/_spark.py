"""Small Spark helpers that all corpus operators share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder (any path that Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs locally."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for the plans that are run inside (dots as double underscores); afterwards the session has its own again."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    own = spark.conf.getAll
    before = {k: own.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again: lost executors do not undo it.

    The job's shuffle files go when it has ended, since nothing reads them any more. The table goes when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        df.write.parquet(path)
    _later_removed(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _later_removed(spark: SparkSession, path: str) -> None:
    """Let the file system that holds ``path`` remove it when the driver's JVM ends."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def dealt_anew(df: DataFrame, key: str) -> DataFrame:
    """``df`` with a long key in a form that hides how its rows lie.

    A join with an aggregate on its key would take the aggregate's partitions as they are, and then the skew join
    cannot split the other side's hot keys; so the aggregate, which is small, gets an exchange of its own.
    """
    return df.withColumn(key, F.col(key).bitwiseXOR(F.lit(0).cast("long")))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: names with dots, and names that differ in case only, then harm nothing."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def place(df: DataFrame, name: str) -> int:
    """Where a table has the column of this name; one in another case counts only if none is exact."""
    names = df.columns
    return names.index(name) if name in names else [x.lower() for x in names].index(name.lower())


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns of a table, whatever else it has; a name in another case counts as extra."""
    return numbered(df).select(*[F.col(f"c{place(df, c)}").alias(c) for c in columns])


def typed(df: DataFrame, column: str, more: str) -> T.StructType:
    """A schema of one column with the type that ``df`` gives it, and more columns."""
    return T.StructType([T.StructField(column, df.schema[place(df, column)].dataType), *T.StructType.fromDDL(more).fields])


def ordinal(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with a long column that sorts as ``column`` does; null where that is null.

    Whole numbers are taken as they are. Other values are ranked: each range of the distinct values by itself, then shifted by the ranges before.
    """
    if isinstance(df.schema[place(df, column)].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return df.withColumn(name, F.col(column).cast("long"))
    ids = df.select(F.col(column).alias("id")).where("id is not null").distinct()
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = cut(ids.repartitionByRange(ranges, "id").withColumn("part", F.spark_partition_id()))
    sizes = ids.groupBy("part").agg(F.count("*").alias("many"))
    before = sizes.select("part", (F.sum("many").over(Window.orderBy("part")) - F.col("many")).alias("before"))  # a row for each range
    at = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    ranks = ids.withColumn("at", at).join(before, "part").select("id", (F.col("before") + F.col("at")).alias(name))
    return df.join(ranks, df[column] == ranks["id"], "left").drop("id")


def map_arrow(df: DataFrame, schema: "str | T.StructType", f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``mapInArrow`` with a function of one batch; any column names."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from f(batch.rename_columns(names))
                pa.default_memory_pool().release_unused()

    return numbered(df).mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A string column without nulls (null: empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


def slabs(sizes: list[int] | "pa.Array", limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to ``limit`` at most; a larger row stands alone."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def hashed(name: str, parts: int) -> "F.Column":
    """A column's value as a number below ``parts``."""
    return F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
