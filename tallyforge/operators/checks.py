"""Checks of keys, packages and runs; each returns the rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that come more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that only one side has."""
    x = a.select(key).distinct().withColumn("a", F.lit(True))
    y = b.select(key).distinct().withColumn("b", F.lit(True))
    return x.join(y, key, "full").where("a is null or b is null").select(key, F.when(F.col("b").isNull(), "left").otherwise("right").alias("side"))


def field_differences(a: DataFrame, b: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fields): which fields differ between two packages; a missing row differs in all."""
    x = a.select(key, F.struct(*fields).alias("x"))
    y = b.select(key, F.struct(*fields).alias("y"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in fields]))
    return x.join(y, key, "full").select(key, names.alias("fields")).where(F.size("fields") > 0)


def comparable(runs: DataFrame, labels: tuple[str, ...] = ("base", "sft", "grpo")) -> DataFrame:
    """(problem) that forbids a comparison of runs (label, task_id, ex, condition_hash)."""
    one = lambda df, cond, name: df.agg(F.bool_or(cond).alias("bad")).where("bad").select(F.lit(name).alias("problem"))
    per = runs.groupBy("task_id").agg(F.count_distinct("label").alias("labels"), F.count("*").alias("n"))
    hashes = runs.agg(F.count_distinct("condition_hash").alias("hashes"), F.min(F.length("condition_hash")).alias("length"), F.count_distinct("label").alias("labels"))
    out = [
        one(runs, ~F.col("label").isin(*labels), "unknown label"),
        one(hashes, F.col("labels") != len(labels), "a run is missing"),
        one(per, F.col("labels") != len(labels), "different tasks"),
        one(per, F.col("n") > F.col("labels"), "a task comes twice"),
        one(runs, F.col("ex").isNull(), "a task has no score"),
        one(hashes, (F.col("hashes") != 1) | (F.col("length") != 64), "different conditions"),
    ]
    return reduce(DataFrame.unionByName, out)


def cited(scores: DataFrame, events: DataFrame) -> DataFrame:
    """Scores that cite events which their episode does not have; ``scores`` has episode_id and event_citations."""
    known = events.groupBy("episode_id").agg(F.collect_set("event_name").alias("known"))
    s = scores.join(known, "episode_id", "left").withColumn("unknown", F.array_except("event_citations", F.coalesce("known", F.array().cast("array<string>"))))
    return s.where((F.size("unknown") > 0) | (F.size("event_citations") == 0)).select("episode_id", "unknown")


def blind(episode_columns: list[str]) -> Column:
    """JSON for a judge: only columns that tell nothing of gold answers, rewards, scores or models."""
    hidden = {"gold_sql", "reward", "ex", "soft_f1", "r_ves", "model_label"}
    return F.to_json(F.struct(*[F.col(c) for c in sorted(set(episode_columns) - hidden)]), {"ignoreNullFields": "false"})


def action(raw: Column, tools: tuple[str, ...]) -> Column:
    """(name, error) of an action's JSON: an object of action and arguments, and no other key."""
    keys = F.json_object_keys(raw)
    name = F.get_json_object(raw, "$.action")
    error = F.when(keys.isNull(), "not an object").when(F.size(F.array_except(keys, F.array(F.lit("action"), F.lit("arguments")))) > 0, "unknown key")
    error = error.when(name.isNull(), "no action").when(~name.isin(*tools), "unknown action")
    return F.struct(F.when(error.isNull(), name).alias("name"), error.alias("error"))


def tool_call(response: Column) -> Column:
    """(call, error) of a response's JSON: exactly one native call, or else its text."""
    n = F.coalesce(F.json_array_length(F.get_json_object(response, "$.tool_calls")), F.lit(0))
    text = F.get_json_object(response, "$.content")
    call = F.when(n == 1, F.get_json_object(response, "$.tool_calls[0]")).when((n == 0) & (F.coalesce(F.trim(text), F.lit("")) != ""), text)
    error = F.when(n > 1, "several calls").when(call.isNull(), "no call")
    return F.struct(F.when(error.isNull(), call).alias("call"), error.alias("error"))


def arguments(tables: Column, limit: Column, sql: Column) -> Column:
    """First thing wrong with a tool's arguments, or null: one to five different tables, a limit from 1 to 20, SQL that is not empty."""
    e = F.when((F.size(tables) < 1) | (F.size(tables) > 5), "tables").when(F.size(F.array_distinct(tables)) != F.size(tables), "tables repeat")
    return e.when(~limit.between(1, 20), "limit").when(F.trim(sql) == "", "sql")
