"""Session settings and table views."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: How queries of the SQL surface are read: quoted identifiers, NULL for a division by zero and for a bad cast.
SQL_CONF = {
    "spark.sql.ansi.enabled": "false",
    "spark.sql.ansi.doubleQuotedIdentifiers": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "10000",
    "spark.scheduler.mode": "FAIR",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the named tables."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings of the SQL surface."""
    builder = SparkSession.builder.master(f"local[{cores}]")
    for k, v in {**SQL_CONF, "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for what is run inside; afterwards the session has its own again."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs locally."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    where = tempfile.mkdtemp(prefix="tallyforge-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{where}")
    return f"file://{where}"


def removed_later(spark: SparkSession, path: str) -> None:
    """Let the file system that holds ``path`` remove it when the driver's JVM ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a written table, whose rows and partitions stay as they are."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    removed_later(spark, path)
    return spark.read.schema(df.schema).parquet(path)
