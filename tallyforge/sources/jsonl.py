"""JSON-lines records and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON-lines file; blank lines are left out, a line that is no object of the schema fails the read.

    A missing path gives no records. Unknown keys are refused, which the reader alone would not do.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    lines = spark.read.text(path).where(F.trim("value") != "")
    bad = lines.where(F.json_object_keys("value").isNull() | (F.size(schemas.extra_keys(F.col("value"), schema)) > 0)).limit(1).collect()
    if bad:
        raise ValueError(f"not a record of this schema: {bad[0].value[:200]}")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return lines.select(parsed.alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records as JSON lines with sorted keys; nulls are kept."""
    df.select(*sorted(df.columns)).write.mode(mode).option("ignoreNullFields", "false").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) where files and manifest (path, sha256) do not agree: missing, unlisted or changed."""
    m = manifest.select(F.col("path"), F.col("sha256").alias("expected"))
    both = files.select("path", "sha256").join(m, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("expected").isNull(), "unlisted").when(F.col("sha256") != F.col("expected"), "changed")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def aligned(records: DataFrame, lines: DataFrame, key: Column | str = "position") -> DataFrame:
    """Records and line-aligned answers joined by position, with whether their SQL and database agree.

    ``records`` has position, db_id, sql; ``lines`` has position, line (SQL, a tab, the database).
    """
    gold = lines.select("position", F.substring_index("line", "\t", -1).alias("gold_db"), F.expr("substring(line, 1, length(line) - length(substring_index(line, '\t', -1)) - 1)").alias("gold_sql"))
    out = records.join(gold, "position", "left")
    return out.withColumn("source_match", F.coalesce((F.trim("sql") == F.trim("gold_sql")) & (F.col("db_id") == F.trim("gold_db")), F.lit(False)))
