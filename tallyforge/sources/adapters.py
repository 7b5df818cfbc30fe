"""The driver's tables in the shape of the engine's records: tasks, events, episodes, attempts, rollouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table

#: Which tool an event type stands for, and which reward.
TOOL = {"view": "describe_schema", "click": "search_values", "signup": "execute_sql", "purchase": "submit_sql"}
REWARD = {"purchase": 1.0, "view": 0.0, "click": -0.2, "signup": -0.4, "error": -1.0}
CODES = ("timeout", "invalid_arguments", "syntax_error", "undescribed_table")


def case(column, values: dict, other=None):
    """A CASE over literal values."""
    out = F
    for k, v in values.items():
        out = out.when(F.col(column) == k, F.lit(v))
    return out.otherwise(F.lit(other))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training tasks: task_id, db_id, question, n_chars."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("task_id"), F.col("source").alias("db_id"), F.col("text").alias("question"), "n_chars", "lang")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of episodes (one user's day), in steps."""
    e = table(spark, sf_dir, "events")
    day = F.col("ts").cast("date")
    w = Window.partitionBy("user_id", day).orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    bad = F.col("event_type") == "error"
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format(day, "yyyy-MM-dd")).alias("episode_id"),
        "user_id",
        "event_id",
        (F.row_number().over(w) - 1).cast("long").alias("step"),
        "event_type",
        case("event_type", TOOL, "protocol").alias("tool"),
        (~bad).alias("ok"),
        F.when(bad, F.get(F.array(*[F.lit(c) for c in CODES]), F.pmod(k, F.lit(4)).cast("int"))).alias("error_code"),
        F.col("value").alias("elapsed_ms"),
        k.alias("tokens"),
    )


def episodes(ev: DataFrame) -> DataFrame:
    """One row an episode: its end, reward and usage."""
    g = ev.groupBy("episode_id", "user_id").agg(
        F.count("*").alias("n_events"),
        F.max_by("event_type", "step").alias("last_type"),
        F.max(F.col("tool") == "protocol").alias("has_protocol"),
        F.sum("tokens").alias("tokens"),
    )
    end = F.when(F.col("last_type") == "purchase", "submitted").when(F.col("last_type") == "error", "infrastructure_error").when(F.col("n_events") >= 4, "max_actions").otherwise("loop")
    return g.select(
        "episode_id",
        "user_id",
        F.concat(F.lit("db_"), F.pmod("user_id", F.lit(7)).cast("string")).alias("db_id"),
        F.get(F.array(F.lit("simple"), F.lit("moderate"), F.lit("challenging")), F.pmod("user_id", F.lit(3)).cast("int")).alias("complexity"),
        F.when(F.pmod("user_id", F.lit(10)) == 0, "validation").otherwise("train").alias("split"),
        (F.col("user_id") * 1024 * 1024).alias("database_size_bytes"),
        "n_events",
        end.alias("terminal_reason"),
        "has_protocol",
        "tokens",
    )


def observed(ev: DataFrame) -> DataFrame:
    """Events with what diagnostics look at, made from their numbers."""
    k = F.col("tokens")
    reply = F.when(F.col("tool") == "protocol", F.when(k % 3 == 0, "several_calls").when(k % 3 == 1, "bad_json"))
    return ev.withColumns(
        {
            "action": F.concat("tool", F.lit(":"), (k % 2).cast("string")), "truncated": k % 11 == 0, "payload_bytes": 100 + 10 * (k % 50), "has_columns": k % 13 != 0,
            "omitted": k % 17 == 0, "returned_rows": k % 4, "reply": reply,
        }
    )


def judged(ep: DataFrame) -> DataFrame:
    """Attempts with outcome and usage, made from their numbers."""
    u, n = F.col("user_id"), F.col("n_events")
    usage = {
        "input_tokens": F.col("tokens"), "billed_output_tokens": 7 * n, "reasoning_present": u % 2, "reasoning_tokens_reported": F.when(u % 5 == 0, 0).otherwise(1), "latency_ms": 10 * n + u % 3, "cost_micro_usd": u % 97,
        "response_count": n, "native_tool_call": n - 1, "text_json": u % 2, "normalization_failed": u % 3, "finish_reason_stop": F.lit(1), "finish_reason_length": u % 2,
    }
    failed = F.col("terminal_reason") == "infrastructure_error"
    accepted = (u + n) % 3 == 0
    return ep.withColumns(
        {
            "accepted": accepted, "reward": F.when(u % 4 == 0, 1.0).when(u % 4 == 1, 0.0), "rejection_reason": F.when(~accepted & (u % 2 == 0), F.col("terminal_reason")),
            "infrastructure_code": F.when(failed, F.when(u % 2 == 0, "api_transport_error").otherwise("context_overflow")), "infrastructure_detail": F.when(failed & (u % 7 == 0), F.lit('{"retry":3}')),
            "provider_code": F.when(u % 29 == 0, "data_inspection_failed"), "replay_exact": u % 31 != 0, "same_database": u % 37 != 0, "violation": accepted & (u % 41 == 0),
            "usage": F.create_map(*[x for c, v in usage.items() for x in (F.lit(c), v.cast("long"))]),
        }
    )


def rewards(spark: SparkSession, sf_dir: str, size: int = 4) -> DataFrame:
    """Rollouts in groups: idx, uid, reward (null for a tenth of them)."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.pmod("event_id", F.lit(10)) == 9, F.lit(None)).otherwise(case("event_type", REWARD))
    return e.select(F.col("event_id").alias("idx"), F.floor(F.col("event_id") / size).alias("uid"), value.cast("double").alias("reward"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: conv_id, turn, role, text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
