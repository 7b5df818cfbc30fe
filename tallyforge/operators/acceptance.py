"""Which trajectories are kept, and why others are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ACTION_TOKENS, MAX_CONTEXT_TOKENS = 512, 16_384


def reason(action_limit: int = MAX_ACTION_TOKENS, context_limit: int = MAX_CONTEXT_TOKENS) -> Column:
    """First reason against an episode, null if there is none. Needs the columns of ``evidence`` and of the episode."""
    r = F.when(~F.col("valid"), F.coalesce("infrastructure_code", F.lit("invalid_infrastructure")))
    r = r.when(F.col("terminal_reason") != "submitted", F.col("terminal_reason"))
    r = r.when(F.coalesce(F.col("reward") != 1.0, F.lit(True)), "execution_not_correct")
    r = r.when(F.col("has_protocol"), "protocol_error")
    r = r.when(F.col("first_error").isNotNull(), F.concat(F.lit("tool_error:"), F.col("first_error")))
    r = r.when(F.size("described") == 0, "missing_schema_description")
    r = r.when(F.col("last_execute").isNull(), "missing_successful_execute")
    r = r.when(F.col("last_tool") != "submit_sql", "missing_submit")
    r = r.when(F.col("last_execute") != F.col("submitted"), "submission_sql_mismatch")
    r = r.when(F.size(F.array_except("used_tables", "described")) > 0, "undescribed_table")
    r = r.when(F.col("max_action_tokens") > action_limit, "action_too_long")
    return r.when(F.col("context_tokens") > context_limit, "context_overflow")


def evidence(events: DataFrame) -> DataFrame:
    """What acceptance looks at, of events with episode_id, step, tool, ok, error_code, argument, tokens."""
    good = F.col("ok") & F.col("error_code").isNull()
    bad = F.when(~good, F.struct("step", F.coalesce("error_code", F.lit("observation_not_ok")).alias("code")))
    return events.groupBy("episode_id").agg(
        F.bool_or(F.col("tool") == "protocol").alias("has_protocol"),
        F.min(bad)["code"].alias("first_error"),
        F.array_sort(F.collect_set(F.when(F.col("tool") == "describe_schema", F.lower("argument")))).alias("described"),
        F.max(F.when(F.col("tool") == "execute_sql", F.struct("step", "argument")))["argument"].alias("last_execute"),
        F.max_by("tool", "step").alias("last_tool"),
        F.max(F.when(F.col("tool") == "submit_sql", F.struct("step", "argument")))["argument"].alias("submitted"),
        F.max("tokens").alias("max_action_tokens"),
        F.sum("tokens").alias("context_tokens"),
    )


def gate(events: DataFrame) -> DataFrame:
    """Verdict on each submission: submission_not_executed, submission_sql_mismatch, undescribed_table, or ok.

    It sees the last successful execution before it and the tables described before it.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("episode_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("executed", F.last(F.when((F.col("tool") == "execute_sql") & F.col("ok"), F.col("argument")), True).over(before))
    e = e.withColumn("described", F.collect_set(F.when((F.col("tool") == "describe_schema") & F.col("ok"), F.col("argument_table"))).over(before))
    verdict = F.when(F.col("executed").isNull(), "submission_not_executed").when(F.col("executed") != F.col("argument"), "submission_sql_mismatch")
    verdict = verdict.when(~F.array_contains("described", F.col("argument_table")), "undescribed_table").otherwise("ok")
    return e.where(F.col("tool") == "submit_sql").select("episode_id", "step", verdict.alias("verdict"))


def violations(attempts: DataFrame) -> DataFrame:
    """Attempts that were accepted though a reason stands against them: a second look at the same evidence."""
    return attempts.withColumn("reason", reason()).where(F.col("accepted") & F.col("reason").isNotNull()).select("episode_id", "reason")
