"""Diagnostics of attempts: counters, group metrics by grouping sets, pause rules, and windows by count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import stored
from .episodes import by_step

#: Attempts from which rates count, and names of error codes.
READY = 20
FATAL = ("authentication_error", "api_empty_response", "api_invalid_response", "cost_limit_exceeded", "token_limit_exceeded")
SYSTEMIC = ("model_or_request_error", "api_client_error", "api_transport_error", "api_retry_exhausted", "provider_data_inspection_failed")
UNVERIFIED = ("submission_not_executed", "submission_sql_mismatch", "undescribed_table")


#: Columns that events and attempts may lack, and what they then are.
EVENT_DEFAULTS = {"action": "event_type", "truncated": "false", "payload_bytes": "0L", "has_columns": "true", "omitted": "false", "returned_rows": "1L", "reply": "CAST(NULL AS STRING)"}
ATTEMPT_DEFAULTS = {
    "rejection_reason": "CAST(NULL AS STRING)", "reward": "CAST(NULL AS DOUBLE)", "infrastructure_code": "CAST(NULL AS STRING)", "infrastructure_detail": "CAST(NULL AS STRING)",
    "provider_code": "CAST(NULL AS STRING)", "replay_exact": "true", "same_database": "true", "violation": "false", "usage": "map('', 0L)",
}
#: Counters of usage that are summarised, and of finish reasons.
USAGE = ("input_tokens", "billed_output_tokens", "reasoning_tokens", "reasoning_tokens_reported", "reasoning_present", "action_tokens", "latency_ms", "cost_micro_usd")
FINISH = ("stop", "tool_calls", "length", "other")
SQL_ERRORS = ("sqlite_error", "syntax_error", "missing_table_or_column", "unsupported_function")


def _filled(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    return df.select("*", *[F.expr(x).alias(c) for c, x in defaults.items() if c not in df.columns])


def per_attempt(events: DataFrame) -> DataFrame:
    """Counters of each episode's events (tool, ok, error_code, action, and what ``EVENT_DEFAULTS`` names); ``protocol`` is a reply that is no action."""
    tool = lambda t: F.col("tool") == t
    is_call = ~tool("protocol")
    w = by_step()
    e = _filled(events, EVENT_DEFAULTS)
    last = F.last(F.when(is_call, F.col("action")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = e.select("*", F.coalesce(is_call & (F.col("action") == last), F.lit(False)).alias("again"), F.lead(is_call).over(w).alias("next_call"), F.lead("action").over(w).alias("next_action"))
    followed = F.col("ok") & F.coalesce("next_call", F.lit(False))
    shown = F.col("ok") | F.coalesce(F.col("error_code") == "schema_too_large", F.lit(False))
    return e.groupBy("episode_id").agg(
        F.count("*").alias("actions"),
        F.bool_or(tool("protocol")).alias("protocol"),
        F.coalesce(F.bool_or(F.col("error_code") == "invalid_arguments"), F.lit(False)).alias("invalid_arguments"),
        F.bool_or(~F.col("ok") | F.col("error_code").isNotNull()).alias("tool_error"),
        F.bool_or(F.col("error_code").isNotNull()).alias("coded_error"),
        F.count_if(tool("execute_sql")).alias("execute_calls"),
        F.count_if(tool("execute_sql") & (F.col("error_code") == "timeout")).alias("execute_timeouts"),
        F.count_if(tool("execute_sql") & F.col("error_code").isin(*SQL_ERRORS)).alias("execute_errors"),
        F.count_if(tool("describe_schema")).alias("schema_calls"),
        F.count_if(tool("describe_schema") & shown & ~F.col("has_columns")).alias("schema_without_columns"),
        F.count_if(tool("describe_schema") & F.col("truncated")).alias("schema_truncated"),
        F.count_if(tool("describe_schema") & F.col("omitted")).alias("schema_omitted"),
        F.count_if(tool("search_values") & (~F.col("ok") | (F.col("returned_rows") == 0))).alias("ineffective_searches"),
        F.count_if(tool("protocol") & (F.col("reply") == "several_calls")).alias("several_calls"),
        F.count_if(tool("protocol") & (F.col("reply") == "bad_json")).alias("bad_json"),
        F.count_if(F.col("error_code").isin(*UNVERIFIED)).alias("unverified"),
        F.count_if("again").alias("repeated_calls"),
        F.count_if(followed).alias("followed"),
        F.count_if(followed & (~is_call | (F.col("action") != F.col("next_action")))).alias("followed_by_other"),
        F.sum("tokens").alias("context_tokens"),
    )


#: Columns whose mean, median and 95th percentile each group has.
SUMMARISED = ("actions", "context_tokens", "latency_ms", "cost_micro_usd")


def metrics() -> list:
    """Aggregates of one group of attempts."""
    n = F.count("*")
    return [
        n.alias("attempts"),
        F.count_if("accepted").alias("accepted"),
        F.round(F.count_if("accepted") / n, 6).alias("acceptance_rate"),
        F.sum("execute_calls").alias("execute_calls"),
        F.round(X.ratio(F.sum("execute_timeouts"), F.sum("execute_calls")), 6).alias("execute_timeout_rate"),
        F.round(F.count_if("protocol") / n, 6).alias("protocol_attempt_rate"),
        F.round(F.count_if("invalid_arguments") / n, 6).alias("invalid_argument_attempt_rate"),
        F.round(F.count_if("tool_error") / n, 6).alias("tool_error_attempt_rate"),
        F.sum("schema_calls").alias("schema_calls"),
        F.round(X.ratio(F.sum("schema_truncated"), F.sum("schema_calls")), 6).alias("schema_truncation_rate"),
        F.sum("unverified").alias("unverified_submissions"),
        F.round(F.count_if(F.col("terminal_reason").isin("loop", "max_actions")) / n, 6).alias("loop_or_max_actions_rate"),
        *[F.round(F.avg(c), 6).alias(f"{c}_mean") for c in SUMMARISED],
    ]


def by_groups(attempts: DataFrame) -> DataFrame:
    """The same metrics by database, complexity, sampling cell and size class. The attempts are read once, and stored with their groups.

    Summarised columns and reasons are rows (group, name, value) of one more aggregation, so a further column adds rows and no pass.
    rejection_reasons maps the reasons of attempts that were not accepted to their number.
    """
    a = _filled(attempts, ATTEMPT_DEFAULTS).withColumn("size_class", X.size_class(F.col("database_size_bytes")))
    of_usage = lambda c: F.coalesce(F.try_element_at("usage", F.lit(c)), F.lit(0).cast("long"))
    a = a.withColumns({c: of_usage(c) for c in ("latency_ms", "cost_micro_usd")}).withColumn("refusal", F.when(~F.col("accepted"), F.coalesce("rejection_reason", F.lit("accepted"))))
    names = {"database": ("split", "db_id"), "complexity": ("split", "complexity"), "sampling_cell": ("split", "db_id", "complexity"), "database_size": ("size_class",)}
    own = ["grouping_name", "group_value"]
    groups = F.array(*[F.struct(F.lit(name).alias("grouping_name"), F.concat_ws(":", *keys).alias("group_value")) for name, keys in names.items()])
    used = ["accepted", "protocol", "invalid_arguments", "tool_error", "execute_calls", "execute_timeouts", "schema_calls", "schema_truncated", "unverified", "terminal_reason", *SUMMARISED, "refusal"]
    a = stored(a.select(groups.alias("g"), *used))
    each = a.select(F.explode("g").alias("g"), *used).select("g.*", *used)
    out = each.groupBy(*own).agg(*metrics())
    numbers = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("refusal")) for c in SUMMARISED])
    said = F.array(F.struct(F.lit("refusal").alias("name"), F.lit(None).cast("double").alias("value"), F.col("refusal").alias("refusal")))
    long = each.select(*own, F.explode(F.concat(numbers, said)).alias("x")).select(*own, "x.*").where("value is not null or refusal is not null")
    counted = stored(long.groupBy(*own, "name", "value", "refusal").agg(F.count("*").alias("n")))
    ranks = X.ranked(counted.where("value is not null"), "value", [*own, "name"], F.col("n"), p50=0.5, p95=0.95)
    at = lambda c, p: F.max(F.when(F.col("name") == c, F.col(p))).alias(f"{c}_{p}")
    out = out.join(ranks.groupBy(*own).agg(*[at(c, p) for c in SUMMARISED for p in ("p50", "p95")]), own, "left")
    reasons = counted.where("refusal is not null")
    reasons = reasons.groupBy(*own).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("refusal", "n")))).alias("rejection_reasons"))  # as many as there are reasons
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return out.join(reasons, own, "left").withColumn("rejection_reasons", F.coalesce("rejection_reasons", none))


def counters(events: DataFrame, attempts: DataFrame) -> DataFrame:
    """(section, name, value): all counters of a batch of attempts (joined with ``per_attempt``) and its events."""
    a = stored(_filled(attempts, ATTEMPT_DEFAULTS))
    of_usage = lambda c: F.coalesce(F.try_element_at("usage", F.lit(c)), F.lit(0).cast("long"))
    total = lambda c: F.sum(of_usage(c))
    n, replays = F.count("*"), F.col("accepted")
    finish = sum((of_usage(f"finish_reason_{x}") for x in FINISH), F.lit(0))
    flat = {
        ("", "attempts"): n,
        ("", "accepted"): F.count_if("accepted"),
        ("", "acceptance_rate"): F.count_if("accepted") / n,
        ("", "protocol_attempts"): F.count_if("protocol"),
        ("", "invalid_argument_attempts"): F.count_if("invalid_arguments"),
        ("", "protocol_or_argument_attempts"): F.count_if(F.col("protocol") | F.col("invalid_arguments")),
        ("", "multiple_native_tool_call_responses"): F.sum("several_calls"),
        ("", "invalid_text_action_responses"): F.sum("bad_json"),
        ("", "normalization_failures"): total("normalization_failed"),
        ("", "native_tool_calls"): total("native_tool_call"),
        ("", "text_json_calls"): total("text_json"),
        ("", "response_calls"): total("response_count"),
        ("", "normalization_failure_rate"): X.ratio(total("normalization_failed"), total("response_count")),
        ("", "native_tool_call_rate"): X.ratio(total("native_tool_call"), total("response_count")),
        ("", "missing_reasoning_breakdown"): F.count_if(_no_breakdown()),
        ("", "systemic_api_error_attempts"): F.count_if(F.col("infrastructure_code").isin(*SYSTEMIC)),
        ("", "provider_data_inspection_failures"): F.count_if(F.col("infrastructure_code").eqNullSafe("provider_data_inspection_failed") | F.col("provider_code").eqNullSafe("data_inspection_failed")),
        ("", "accepted_invariant_violations"): F.count_if("violation"),
        ("schema", "calls"): F.sum("schema_calls"),
        ("schema", "without_columns"): F.sum("schema_without_columns"),
        ("schema", "truncated"): F.sum("schema_truncated"),
        ("schema", "with_omitted_tables"): F.sum("schema_omitted"),
        ("execute_sql", "calls"): F.sum("execute_calls"),
        ("execute_sql", "timeouts"): F.sum("execute_timeouts"),
        ("execute_sql", "sqlite_errors"): F.sum("execute_errors"),
        ("submissions", "unverified"): F.sum("unverified"),
        ("actions", "repeated_calls"): F.sum("repeated_calls"),
        ("actions", "ineffective_searches"): F.sum("ineffective_searches"),
        ("actions", "attempts_with_tool_error"): F.count_if("coded_error"),
        ("actions", "corrected_final_results"): F.count_if(F.col("coded_error") & (F.col("reward") == 1)),
        ("actions", "correction_success_rate"): X.ratio(F.count_if(F.col("coded_error") & (F.col("reward") == 1)), F.count_if("coded_error")),
        ("actions", "loop_or_max_actions"): F.count_if(F.col("terminal_reason").isin("loop", "max_actions")),
        ("actions", "observations_followed_by_action"): F.sum("followed"),
        ("actions", "observations_followed_by_distinct_action"): F.sum("followed_by_other"),
        ("actions", "observation_utilization_rate"): X.ratio(F.sum("followed_by_other"), F.sum("followed")),
        ("replay", "checked"): F.count_if(replays),
        ("replay", "mismatches"): F.count_if(replays & ~F.col("replay_exact")),
        ("replay", "database_sha_mismatches"): F.count_if(replays & ~F.col("same_database")),
        ("finish_reasons", "missing_or_legacy"): F.sum(F.greatest(of_usage("response_count") - finish, F.lit(0))),
        **{("finish_reasons", x): total(f"finish_reason_{x}") for x in FINISH},
    }
    one = a.agg(*[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"v{i}") for i, v in enumerate(flat.values())])
    parts = [one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(x).alias("name"), F.col(f"v{i}").alias("value")) for i, (s, x) in enumerate(flat)])))]
    named = lambda **cs: F.explode(F.array(*[F.struct(F.lit(k).alias("section"), v.alias("name")) for k, v in cs.items()])).alias("x")
    kinds = a.select(named(
        rejection_reasons=F.when(~F.col("accepted"), F.coalesce("rejection_reason", F.lit("unknown"))), infrastructure_codes=F.col("infrastructure_code"), infrastructure_details=F.col("infrastructure_detail"),
    ))
    events = stored(_filled(events, EVENT_DEFAULTS).select("tool", "error_code", "payload_bytes"))
    kinds = kinds.unionByName(events.select(named(tool_distribution=F.when(F.col("tool") != "protocol", F.col("tool")), gate_errors=F.when(F.col("error_code").isin(*UNVERIFIED), F.col("error_code")))))
    parts.append(kinds.select("x.*").where("name is not null").groupBy("section", "name").agg(F.count("*").cast("double").alias("value")))
    values = a.select(F.explode(F.create_map(*[x for c in USAGE for x in (F.lit(f"usage.{c}"), of_usage(c))], F.lit("usage.context_tokens"), F.coalesce("context_tokens", F.lit(0)), F.lit("actions.count"), F.col("actions"))).alias("section", "x"))
    sizes = events.where("tool = 'describe_schema'").select(F.lit("schema.bytes").alias("section"), F.col("payload_bytes").cast("long").alias("x"))
    u = usage(values.unionByName(sizes), "x", "section")
    parts.append(u.select("section", F.explode(F.create_map(*[x for c in ("mean", "p50", "p95") for x in (F.lit(c), F.col(c))])).alias("name", "value")))
    return reduce(DataFrame.unionByName, parts)


def _no_breakdown() -> Column:
    of_usage = lambda c: F.coalesce(F.try_element_at("usage", F.lit(c)), F.lit(0).cast("long"))
    return (of_usage("reasoning_present") > 0) & (of_usage("reasoning_tokens_reported") == 0)


def usage(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mean, median and 95th percentile by nearest rank."""
    mean = df.groupBy(*keys).agg(F.round(F.avg(column), 4).alias("mean"))
    out = mean.join(X.ranked(df, column, list(keys), p50=0.5, p95=0.95), list(keys), "left")
    return out.select(*keys, "mean", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95")])


#: Sums over attempts that the pause rules look at; they add up over any parts of the attempts.
TALLIES = (
    "n accepted accepted_first bad_form execute_calls execute_timeouts schema_calls schema_truncated schema_without_columns loops overflows fatal systemic "
    "not_replayed violations no_breakdown"
).split() + [f"code_{i}" for i in range(len(SYSTEMIC))]


def tallies(attempts: DataFrame, *keys: str) -> DataFrame:
    """``TALLIES`` by ``keys``; attempts have ``seq`` from 1 and the counters of ``per_attempt``."""
    a = _filled(attempts, ATTEMPT_DEFAULTS)
    return a.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(F.col("accepted") & (F.col("seq") <= READY)).alias("accepted_first"),
        F.count_if(F.col("protocol") | F.col("invalid_arguments")).alias("bad_form"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("execute_calls", "execute_timeouts", "schema_calls", "schema_truncated", "schema_without_columns")],
        F.count_if(F.col("terminal_reason").isin("loop", "max_actions")).alias("loops"),
        F.count_if(F.col("rejection_reason").eqNullSafe("context_overflow") | F.col("infrastructure_code").eqNullSafe("context_overflow")).alias("overflows"),
        F.count_if(F.col("infrastructure_code").isin(*FATAL)).alias("fatal"),
        F.count_if(F.col("infrastructure_code").isin(*SYSTEMIC)).alias("systemic"),
        F.count_if(F.col("accepted") & ~(F.col("replay_exact") & F.col("same_database"))).alias("not_replayed"),
        F.count_if("violation").alias("violations"),
        F.count_if(_no_breakdown()).alias("no_breakdown"),
        *[F.count_if(F.col("infrastructure_code") == c).alias(f"code_{i}") for i, c in enumerate(SYSTEMIC)],
    )


def cell_tallies(attempts: DataFrame, *keys: str) -> DataFrame:
    """Calls and timeouts of each sampling cell, by ``keys``."""
    return attempts.groupBy(*keys, "split", "db_id", "complexity").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("execute_calls", "execute_timeouts")])


def concluded(sums: DataFrame, cells: DataFrame, *keys: str, cost_limit: float | None = None, spent: float | None = None, token_limit: int | None = None, used: int | None = None) -> DataFrame:
    """What the pause rules look at, by ``keys``, from sums over attempts and over cells."""
    over = lambda x, limit, slack: F.lit(x is not None and limit is not None and x > limit + slack)
    worst = cells.groupBy(*keys).agg(F.max(X.ratio(F.col("execute_timeouts"), F.col("execute_calls"))).alias("worst_cell"))
    one = sums.join(worst, list(keys), "left") if keys else sums.join(worst, how="left")  # one row each
    one = one.withColumn("worst_cell", F.coalesce("worst_cell", F.lit(0.0))).withColumn("most_systemic", F.greatest(*[F.col(f"code_{i}") for i in range(len(SYSTEMIC))]))
    return one.drop(*[f"code_{i}" for i in range(len(SYSTEMIC))]).withColumn("over_cost", over(spent, cost_limit, 1e-12)).withColumn("over_tokens", over(used, token_limit, 0))


def totals(attempts: DataFrame, **spending) -> DataFrame:
    """One row of what the pause rules look at (``spending`` as in ``concluded``)."""
    return concluded(tallies(attempts), cell_tallies(attempts), **spending)


def rules(target: float = 0.75) -> dict[str, Column]:
    """The names of the pause rules, with their conditions on the one row of ``totals``."""
    ready = F.col("n") >= READY
    return {
        "first_20_without_accepted": ready & (F.col("accepted_first") == 0),
        "protocol_or_argument_error_rate_gt_5pct": ready & (F.col("bad_form") / F.col("n") > 0.05),
        "pilot_acceptance_upper_bound_lt_75pct": ready & (X.wilson_upper(F.col("accepted"), F.col("n")) < target),
        "schema_without_columns": F.col("schema_without_columns") > 0,
        "schema_truncation_rate_gt_5pct": ready & (X.ratio(F.col("schema_truncated"), F.col("schema_calls")) > 0.05),
        "execute_timeout_rate_gt_2pct": ready & (X.ratio(F.col("execute_timeouts"), F.col("execute_calls")) > 0.02),
        "stratum_execute_timeout_rate_gt_5pct": ready & (F.col("worst_cell") > 0.05),
        "context_overflow_rate_gt_1pct": (F.col("n") > 0) & (F.col("overflows") / F.col("n") > 0.01),
        "loop_or_max_actions_rate_gt_5pct": ready & (F.col("loops") / F.col("n") > 0.05),
        "replay_or_database_sha_mismatch": F.col("not_replayed") > 0,
        "accepted_trajectory_invariant_violation": F.col("violations") > 0,
        "systemic_api_or_budget_error": (F.col("fatal") > 0) | (F.col("most_systemic") >= 2) | (ready & (F.col("systemic") / F.col("n") > 0.05)),
        "reasoning_token_breakdown_missing": F.col("no_breakdown") > 0,
        "campaign_cost_limit_exceeded": F.col("over_cost"),
        "campaign_token_limit_exceeded": F.col("over_tokens"),
    }


def pause_reasons_by(sums: DataFrame, cells: DataFrame, key: str, target: float = 0.75, **spending) -> DataFrame:
    """(key, attempts, reason) of the rules that hold in each part of the attempts, from its sums."""
    t = concluded(sums, cells, key, **spending)
    every = F.array(*[F.when(rule, F.lit(name)) for name, rule in rules(target).items()])
    return t.select(key, F.col("n").alias("attempts"), F.explode(F.array_compact(every)).alias("reason"))


def pause_rules(t: DataFrame, target: float = 0.75) -> DataFrame:
    """(reason, holds) of every rule, of the one row of ``totals``."""
    every = [F.struct(F.lit(name).alias("reason"), F.coalesce(rule, F.lit(False)).alias("holds")) for name, rule in rules(target).items()]
    return t.select(F.inline(F.array(*every)))


def pause_reasons(t: DataFrame, target: float = 0.75) -> DataFrame:
    """(reason) that holds of the one row of ``totals``."""
    return pause_rules(t, target).where("holds").select("reason")


def windows(attempts: DataFrame, size: int = 100, order: str = "seq") -> DataFrame:
    """Acceptance in windows of ``size`` attempts in order, the last one maybe short; ``seq`` counts from 1."""
    w = F.floor((F.col(order) - 1) / size).alias("window")
    return attempts.groupBy(w).agg(F.count("*").alias("attempts"), F.count_if("accepted").alias("accepted"), (F.count("*") < size).alias("partial"))


def sequence(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with seq, its rank in an order over all rows: ranges are ranked by themselves, then shifted by the ranges before.

    No task sees all rows, which a window without partitions would need. The session's shuffle partitions say how many ranges there are, as they do for any other
    exchange over the data.
    """
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(df.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("size"))
    shift = counts.withColumn("before", F.sum("size").over(Window.orderBy("part")) - F.col("size")).select("part", "before")  # a row for each range
    local = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return local.join(F.broadcast(shift), "part").withColumn("seq", F.col("before") + F.col("at")).drop("part", "at", "before")
