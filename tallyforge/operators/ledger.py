"""Ledgers: campaign totals, running budgets with reservations, resumption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last record of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def totals(attempts: DataFrame) -> DataFrame:
    """One row: attempts, cost and tokens of distinct episodes that were not migrated; billed tokens before reported ones."""
    a = attempts.where("migrated_from is null").dropDuplicates(["episode_id"])
    used = F.col("input_tokens") + F.coalesce("billed_output_tokens", "output_tokens", F.lit(0))
    return a.agg(F.count("*").alias("attempts"), F.coalesce(F.sum("cost_micro_usd"), F.lit(0)).alias("spent_micro_usd"), F.coalesce(F.sum(used), F.lit(0)).alias("used_tokens"))


def running(df: DataFrame, account: str, order: list[str], spent: str, reserve: Column, limit: int) -> DataFrame:
    """Requests of an account in order, with spent_before and whether the reservation still fits under the limit."""
    w = Window.partitionBy(account).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("spent_before", F.coalesce(F.sum(spent).over(w), F.lit(0)))
    return d.withColumn("allowed", F.col("spent_before") + reserve <= limit)


def pending(tasks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Tasks that are not done."""
    return tasks.join(done.select(*keys), keys, "left_anti")


def cached(examples: DataFrame, records: DataFrame, version: Column) -> DataFrame:
    """Examples with hit: whether the last record of the task has the same fingerprint."""
    last = latest(records, ["task_id"], F.desc(version)).select("task_id", F.col("fingerprint").alias("seen"))
    return examples.join(last, "task_id", "left").withColumn("hit", F.coalesce(F.col("seen") == F.col("fingerprint"), F.lit(False))).drop("seen")
