"""Audit of SQL workloads: each query runs twice, and its record says whether it can be trained on."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans import execute
from ..schemas import AUDIT

VERSION = "1"


def fingerprints(examples: DataFrame, version: str = VERSION) -> DataFrame:
    """Examples (task_id, sql, db_sha256) with sql_sha256 and a fingerprint of all that an audit depends on."""
    e = examples.withColumn("sql_sha256", F.sha2("sql", 256)).withColumn("auditor_version", F.lit(version))
    return e.withColumn("fingerprint", X.fingerprint("sql_sha256", "db_sha256", "auditor_version"))


def run(spark: SparkSession, examples: list[dict], workers: int = 4, **caps) -> DataFrame:
    """Audit records of examples (task_id, source_index, db_id, sql), which a pool of driver threads submits.

    The number of statements is that of a workload, not of its rows; their results stay on the cluster up to the caps.
    """

    def one(e: dict) -> tuple:
        first = execute.run_sql(spark, e["sql"], **caps)
        again = execute.run_sql(spark, e["sql"], **caps) if first.status == "passed" else first
        same = first.digest == again.digest and again.status == first.status
        ok = first.status == "passed"
        status = first.status if not ok else "nondeterministic" if not same else "passed"
        good = ok and same and not first.result_too_large
        return (
            e["task_id"], e.get("source_index"), e.get("db_id"), status, ok, good and not first.empty_result, first.empty_result, first.result_too_large, same if ok else None,
            first.row_count if ok else None, first.unique_row_count if ok else None, first.result_bytes if ok else None, first.digest, [first.elapsed_ms, again.elapsed_ms] if ok else [first.elapsed_ms],
            first.error, e["sql"], e.get("db_sha256"),
        )

    with ThreadPoolExecutor(workers) as pool:
        rows = list(pool.map(one, examples))
    head = ", ".join(AUDIT.split(", ")[:15])
    df = spark.createDataFrame(rows, head + ", sql string, db_sha256 string")
    return fingerprints(df).drop("sql").select(*[c.split()[0] for c in AUDIT.split(", ")])


def outputs(records: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Actors' view and hidden answers of the clean examples."""
    clean = records.where("rl_clean").select("task_id", "status")
    joined = examples.join(clean, "task_id")
    tasks = joined.select(F.lit(1).alias("schema_version"), "task_id", F.lit("train_pool").alias("split"), "db_id", "question", "evidence", F.col("db_id").alias("db_ref"))
    return tasks, joined.select(F.lit(1).alias("schema_version"), "task_id", F.col("sql").alias("gold_sql"), F.col("status").alias("audit_status"))


def summary(records: DataFrame) -> DataFrame:
    """(status, tasks, empty, too_large, clean)."""
    return records.groupBy("status").agg(F.count("*").alias("tasks"), F.count_if("empty_result").alias("empty"), F.count_if("result_too_large").alias("too_large"), F.count_if("rl_clean").alias("clean"))


def final_filter(records: DataFrame) -> DataFrame:
    """Records kept for evaluation: empty results may stay."""
    return records.where("executable and deterministic and not result_too_large")


def inventory(tables: DataFrame) -> DataFrame:
    """(name, n, bytes) of an inventory's groups, from (name, size)."""
    return tables.groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def unchanged(before: DataFrame, after: DataFrame, key: str = "db_id") -> DataFrame:
    """One row: whether all databases still have their hash."""
    b, a = before.select(key, F.col("sha256").alias("b")), after.select(key, F.col("sha256").alias("a"))
    return b.join(a, key, "full").agg(F.coalesce(F.bool_and(F.col("a").eqNullSafe(F.col("b"))), F.lit(True)).alias("unchanged"))
