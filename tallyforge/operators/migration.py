"""Accepted attempts taken over into a campaign of other settings: what may be kept, and why the rest may not."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Why an attempt is not taken over; the last goes before the reason that the new settings give.
MISSING, MESSAGES, PROTOCOL, REPLAY, REFUSED = "missing_task_or_answer", "initial_actor_messages_changed", "visible_prompt_or_tools_changed", "event_replay_mismatch", "new_acceptance:"


def outcomes(attempts: DataFrame, done: DataFrame, tasks: DataFrame, answers: DataFrame, replays: DataFrame, protocol: str) -> DataFrame:
    """(task_id, episode_id, reason) of accepted attempts of tasks that are not ``done``; reason is null for those that are taken over.

    ``attempts``: task_id, episode_id, accepted, actor_hash, protocol_hash. ``tasks``: task_id, actor_hash. ``replays``: episode_id, exact, still_accepted,
    refusal. A task needs one attempt: what comes after the first that is taken over, in the order of episode_id, is passed over.
    """
    a = attempts.where("accepted").join(done.select("task_id").distinct(), "task_id", "left_anti")
    a = a.join(tasks.select("task_id", F.col("actor_hash").alias("actor_now")), "task_id", "left").join(answers.select("task_id", F.lit(True).alias("answered")), "task_id", "left")
    a = a.join(replays.select("episode_id", "exact", "still_accepted", "refusal"), "episode_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(F.col("actor_now").isNull() | ~yes("answered"), MISSING)
        .when(F.col("actor_hash") != F.col("actor_now"), MESSAGES)
        .when(F.col("protocol_hash") != protocol, PROTOCOL)
        .when(~yes("exact"), REPLAY)
        .when(~yes("still_accepted"), F.concat(F.lit(REFUSED), F.coalesce("refusal", F.lit("unknown"))))
    )
    a = a.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNull(), F.col("episode_id"))).over(Window.partitionBy("task_id"))
    return a.withColumn("first", first).where("first is null or episode_id <= first").select("task_id", "episode_id", "reason")


def report(attempts: DataFrame, found: DataFrame) -> DataFrame:
    """(name, n): accepted attempts, those taken over, and the others by reason."""
    eligible = attempts.agg(F.count_if("accepted").alias("n")).select(F.lit("eligible_accepted").alias("name"), "n")
    return eligible.unionByName(found.groupBy(F.coalesce("reason", F.lit("migrated")).alias("name")).agg(F.count("*").alias("n")))
