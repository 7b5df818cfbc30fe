"""Behaviour of episodes: what loops over events carry along becomes a window over (episode, step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def by_step():
    """An episode's events in order."""
    return Window.partitionBy("episode_id").orderBy("step")


def runs(events: DataFrame, key: str = "event_type") -> DataFrame:
    """Events with run (number of the stretch of equal keys) and at (place in it)."""
    new = F.coalesce((F.col(key) != F.lag(key).over(by_step())).cast("int"), F.lit(1))
    e = events.withColumn("run", F.sum(new).over(by_step().rowsBetween(Window.unboundedPreceding, 0)))
    return e.withColumn("at", F.row_number().over(Window.partitionBy("episode_id", "run").orderBy("step")))


def loops(events: DataFrame, key: str = "event_type", times: int = 3) -> DataFrame:
    """(episode_id, step) where a key comes for the ``times``-th time in a row first; the episode ends there."""
    hit = runs(events, key).where(F.col("at") >= times)
    return hit.groupBy("episode_id").agg(F.min("step").alias("step"))


def repeated_calls(events: DataFrame, key: str = "event_type", action: Column | None = None) -> DataFrame:
    """Per episode the calls that equal the call before; events that are no call are passed over."""
    e = events.where(action) if action is not None else events
    same = F.coalesce((F.col(key) == F.lag(key).over(by_step())).cast("long"), F.lit(0))
    return e.withColumn("same", same).groupBy("episode_id").agg(F.sum("same").alias("repeated"))


def utilisation(events: DataFrame, key: str = "event_type", action: Column | None = None) -> DataFrame:
    """Over all events: successes followed by a call, and those followed by another call than their own."""
    action = F.col("tool") != "protocol" if action is None else action
    e = events.withColumn("is_action", action).withColumn("next_action", F.lead("is_action").over(by_step())).withColumn("next_key", F.lead(key).over(by_step()))
    e = e.where(F.col("ok") & F.col("next_action"))
    changed = F.count_if(~F.col("is_action") | (F.col(key) != F.col("next_key")))
    return e.agg(F.count("*").alias("followed"), changed.alias("distinct_followed")).withColumn("rate", F.round(X.ratio(F.col("distinct_followed"), F.col("followed")), 6))


def corrected(events: DataFrame) -> DataFrame:
    """Per episode whether it had an error, and a success after one."""
    before = F.coalesce(F.max((~F.col("ok")).cast("int")).over(by_step().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    e = events.withColumn("before", before)
    return e.groupBy("episode_id").agg(F.bool_or(~F.col("ok")).alias("had_error"), F.bool_or(F.col("ok") & (F.col("before") == 1)).alias("later_success"))


def first_error(events: DataFrame) -> DataFrame:
    """Per episode the code of its first error."""
    return events.where("error_code is not null").groupBy("episode_id").agg(F.min_by("error_code", "step").alias("error_code"))


def last_call(events: DataFrame, tool: str = "execute_sql") -> DataFrame:
    """Events with last_step: the last successful call of a tool before each."""
    hit = F.when((F.col("tool") == tool) & F.col("ok"), F.col("step"))
    return events.withColumn("last_step", F.last(hit, True).over(by_step().rowsBetween(Window.unboundedPreceding, -1)))


def context(events: DataFrame, prompt: int = 0) -> DataFrame:
    """Per episode the largest context before a request: the prompt and all tokens before it."""
    before = F.coalesce(F.sum("tokens").over(by_step().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return events.withColumn("context", before + prompt).groupBy("episode_id").agg(F.max("context").cast("long").alias("max_context"))


def behavior(events: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row of behaviour metrics of all episodes."""
    fixed = corrected(events)
    per = events.groupBy("episode_id").agg(
        F.count("*").alias("steps"),
        F.max_by("ok", "step").alias("last_ok"),
        F.count_if(F.col("tool").isin("execute_sql", "submit_sql")).alias("sql"),
        F.count_if(F.col("tool").isin("execute_sql", "submit_sql") & ~F.col("ok")).alias("sql_bad"),
        F.sum("elapsed_ms").alias("elapsed"),
        F.sum("tokens").alias("used"),
    )
    e = episodes.select("episode_id", "terminal_reason").join(per, "episode_id").join(fixed, "episode_id")
    done = F.col("terminal_reason") == "submitted"
    n = F.count("*")
    return e.agg(
        n.alias("episode_count"),
        F.round(X.ratio(F.count_if(done & F.col("last_ok")), n), 6).alias("successful_submission_rate"),
        F.round(X.ratio(F.sum("steps"), n), 6).alias("average_steps"),
        F.round(X.ratio(F.sum("sql_bad"), F.sum("sql")), 6).alias("execution_error_rate"),
        F.round(X.ratio(F.count_if(F.col("terminal_reason") == "loop"), n), 6).alias("loop_rate"),
        F.round(X.ratio(F.count_if(F.col("had_error") & F.col("later_success") & done), F.count_if("had_error")), 6).alias("correction_success_rate"),
        F.sum("used").alias("token_total"),
        F.round(X.ratio(F.sum("elapsed"), F.sum("steps")), 4).alias("average_tool_latency_ms"),
    )


def tool_histogram(events: DataFrame) -> DataFrame:
    """Calls of each tool."""
    return events.groupBy("tool").agg(F.count("*").alias("calls"))


def replay(recorded: DataFrame, again: DataFrame, compared: list[str]) -> DataFrame:
    """Steps where a replay differs from the record, or where one has no step: (episode_id, step)."""
    a = recorded.select("episode_id", "step", F.struct(*compared).alias("was"))
    b = again.select("episode_id", "step", F.struct(*compared).alias("now"))
    both = a.join(b, ["episode_id", "step"], "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select("episode_id", "step")


def numbered(events: DataFrame) -> DataFrame:
    """Events with their ids: episode, a colon, the step in two digits."""
    return events.withColumn("event_name", F.format_string("%s:%02d", "episode_id", "step"))
