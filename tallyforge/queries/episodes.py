"""Trajectories: behaviour, acceptance, diagnostics, windows over steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import acceptance, checks, diagnostics, episodes, migration
from ..sources import adapters, catalog
from . import EP, EV, query

W = f"WITH {EV}"
WE = f"WITH {EV}, {EP}"
RANK = "coalesce(list_sort(list({x}))[round_even((count(*) - 1) * {p}::DOUBLE, 0)::INT + 1], 0)::DOUBLE"
WILSON = "CASE WHEN {n} <= 0 THEN 1.0 ELSE least(1.0, ({s}::DOUBLE / {n} + 3.841458820694124 / (2 * {n}) + 1.959963984540054 * sqrt({s}::DOUBLE / {n} * (1 - {s}::DOUBLE / {n}) / {n} + 3.841458820694124 / (4.0 * {n} * {n}))) / (1 + 3.841458820694124 / {n})) END"


def _ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events(spark, sf_dir)


FIXED = f"""{EV}, {EP}, fx AS (SELECT episode_id, bool_or(NOT ok) AS had_error, bool_or(ok AND before) AS later_success FROM
  (SELECT *, coalesce(bool_or(NOT ok) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM ev) GROUP BY episode_id)"""


@query(
    "e4_e5_behavior_metrics",
    f"""WITH {FIXED}, per AS (SELECT episode_id, count(*) AS steps, arg_max(ok, step) AS last_ok, count(*) FILTER (tool IN ('execute_sql', 'submit_sql')) AS sql,
  count(*) FILTER (tool IN ('execute_sql', 'submit_sql') AND NOT ok) AS sql_bad, sum(elapsed_ms) AS elapsed, sum(tokens) AS used FROM ev GROUP BY episode_id)
SELECT count(*) AS episode_count, round(count(*) FILTER (terminal_reason = 'submitted' AND last_ok) / count(*), 6) AS successful_submission_rate, round(sum(steps)::DOUBLE / count(*), 6) AS average_steps,
  round(sum(sql_bad)::DOUBLE / sum(sql), 6) AS execution_error_rate, round(count(*) FILTER (terminal_reason = 'loop') / count(*), 6) AS loop_rate,
  round(count(*) FILTER (had_error AND later_success AND terminal_reason = 'submitted') / count(*) FILTER (had_error), 6) AS correction_success_rate,
  sum(used)::BIGINT AS token_total, round(sum(elapsed) / sum(steps)::DOUBLE, 4) AS average_tool_latency_ms
FROM ep JOIN per USING (episode_id) JOIN fx USING (episode_id)""",
)
def behavior_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E4, E5."""
    ev = _ev(spark, sf_dir)
    return episodes.behavior(ev, adapters.episodes(ev))


@query("e4_tool_histogram", f"{W} SELECT tool, count(*) AS calls FROM ev GROUP BY tool")
def tool_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each tool."""
    return episodes.tool_histogram(_ev(spark, sf_dir))


@query(
    "f1_loop_detection",
    f"""{W}, c AS (SELECT *, coalesce((event_type <> lag(event_type) OVER (PARTITION BY episode_id ORDER BY step))::INT, 1) AS new FROM ev),
r AS (SELECT *, sum(new) OVER (PARTITION BY episode_id ORDER BY step) AS run FROM c), a AS (SELECT *, row_number() OVER (PARTITION BY episode_id, run ORDER BY step) AS nth FROM r)
SELECT episode_id, min(step) AS step FROM a WHERE nth >= 3 GROUP BY episode_id""",
)
def loop_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1."""
    return episodes.loops(_ev(spark, sf_dir))


@query(
    "f2_repeated_calls",
    f"""{W}, c AS (SELECT episode_id, coalesce((event_type = lag(event_type) OVER (PARTITION BY episode_id ORDER BY step))::INT, 0) AS same FROM ev WHERE tool <> 'protocol')
SELECT episode_id, sum(same)::BIGINT AS repeated FROM c GROUP BY episode_id""",
)
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2."""
    return episodes.repeated_calls(_ev(spark, sf_dir), action=F.col("tool") != "protocol")


@query(
    "f3_observation_utilisation",
    f"""{W}, c AS (SELECT *, lead(tool <> 'protocol') OVER (PARTITION BY episode_id ORDER BY step) AS na, lead(event_type) OVER (PARTITION BY episode_id ORDER BY step) AS nk FROM ev)
SELECT count(*) AS followed, count(*) FILTER (tool = 'protocol' OR event_type <> nk) AS distinct_followed, round(count(*) FILTER (tool = 'protocol' OR event_type <> nk) / count(*), 6) AS rate FROM c WHERE ok AND na""",
)
def observation_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3."""
    return episodes.utilisation(_ev(spark, sf_dir))


@query("f4_corrected_after_error", f"WITH {FIXED} SELECT * FROM fx")
def corrected_after_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F4."""
    return episodes.corrected(_ev(spark, sf_dir))


@query("f5_last_successful_call", f"{W} SELECT episode_id, step, last_value(CASE WHEN tool = 'execute_sql' AND ok THEN step END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_step FROM ev")
def last_successful_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F5."""
    return episodes.last_call(_ev(spark, sf_dir)).select("episode_id", "step", "last_step")


@query("f6_first_error_code", f"{W} SELECT episode_id, arg_min(error_code, step) AS error_code FROM ev WHERE error_code IS NOT NULL GROUP BY episode_id")
def first_error_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6."""
    return episodes.first_error(_ev(spark, sf_dir))


@query("f7_context_running_max", f"{W} SELECT episode_id, max(coalesce(c, 0) + 100)::BIGINT AS max_context FROM (SELECT episode_id, sum(tokens) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM ev) GROUP BY episode_id")
def context_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F7."""
    return episodes.context(_ev(spark, sf_dir), prompt=100)


@query("f12_step_numbering", f"{W} SELECT event_id, episode_id || ':' || lpad(step::VARCHAR, 2, '0') AS event_name FROM ev")
def step_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    return episodes.numbered(_ev(spark, sf_dir)).select("event_id", "event_name")


_OBS = """ob AS (SELECT *, tool <> 'protocol' AS is_call, tool || ':' || tokens % 2 AS action FROM ev),
oc AS (SELECT *, coalesce(is_call AND action = last_value(CASE WHEN is_call THEN action END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS again,
  ok AND coalesce(lead(is_call) OVER (PARTITION BY episode_id ORDER BY step), false) AS followed, lead(action) OVER (PARTITION BY episode_id ORDER BY step) AS next_action FROM ob)"""
_ATT = f"""{_OBS}, pa AS (SELECT episode_id AS k, count(*) AS actions, bool_or(tool = 'protocol') AS protocol,
  coalesce(bool_or(error_code = 'invalid_arguments'), false) AS invalid_arguments, bool_or(NOT ok OR error_code IS NOT NULL) AS tool_error, bool_or(error_code IS NOT NULL) AS coded_error, count(*) FILTER (tool = 'execute_sql') AS execute_calls,
  count(*) FILTER (tool = 'execute_sql' AND error_code = 'timeout') AS execute_timeouts, count(*) FILTER (tool = 'execute_sql' AND error_code = 'syntax_error') AS execute_errors, count(*) FILTER (tool = 'describe_schema') AS schema_calls,
  count(*) FILTER (tool = 'describe_schema' AND ok AND tokens % 13 = 0) AS schema_without_columns, count(*) FILTER (tool = 'describe_schema' AND tokens % 11 = 0) AS schema_truncated,
  count(*) FILTER (tool = 'describe_schema' AND tokens % 17 = 0) AS schema_omitted, count(*) FILTER (tool = 'search_values' AND (NOT ok OR tokens % 4 = 0)) AS ineffective_searches,
  count(*) FILTER (tool = 'protocol' AND tokens % 3 = 0) AS several_calls, count(*) FILTER (tool = 'protocol' AND tokens % 3 = 1) AS bad_json,
  count(*) FILTER (error_code IN ('submission_not_executed', 'submission_sql_mismatch', 'undescribed_table')) AS unverified, count(*) FILTER (again) AS repeated_calls, count(*) FILTER (followed) AS followed,
  count(*) FILTER (followed AND (NOT is_call OR action <> next_action)) AS followed_by_other, sum(tokens)::BIGINT AS context_tokens FROM oc GROUP BY episode_id),
att AS (SELECT ep.*, pa.* EXCLUDE (k), (user_id + n_events) % 3 = 0 AS accepted, CASE user_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 END AS reward,
  CASE WHEN (user_id + n_events) % 3 <> 0 AND user_id % 2 = 0 THEN terminal_reason END AS rejection_reason, 10 * n_events + user_id % 3 AS latency_ms, user_id % 97 AS cost_micro_usd,
  CASE WHEN terminal_reason = 'infrastructure_error' THEN CASE WHEN user_id % 2 = 0 THEN 'api_transport_error' ELSE 'context_overflow' END END AS infrastructure_code,
  user_id % 2 AS reasoning_present, CASE WHEN user_id % 5 = 0 THEN 0 ELSE 1 END AS reasoning_tokens_reported FROM ep JOIN pa ON pa.k = ep.episode_id)"""


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = _ev(spark, sf_dir)
    return adapters.judged(adapters.episodes(ev)).join(diagnostics.per_attempt(adapters.observed(ev)), "episode_id")


_GROUPS = f"""count(*) AS attempts, count(*) FILTER (accepted) AS accepted, round(count(*) FILTER (accepted) / count(*), 6) AS acceptance_rate, sum(execute_calls)::BIGINT AS execute_calls,
  round(CASE WHEN sum(execute_calls) = 0 THEN 0.0 ELSE sum(execute_timeouts)::DOUBLE / sum(execute_calls) END, 6) AS execute_timeout_rate, round(count(*) FILTER (protocol) / count(*), 6) AS protocol_attempt_rate,
  round(count(*) FILTER (invalid_arguments) / count(*), 6) AS invalid_argument_attempt_rate, round(count(*) FILTER (tool_error) / count(*), 6) AS tool_error_attempt_rate, sum(schema_calls)::BIGINT AS schema_calls,
  round(CASE WHEN sum(schema_calls) = 0 THEN 0.0 ELSE sum(schema_truncated)::DOUBLE / sum(schema_calls) END, 6) AS schema_truncation_rate, sum(unverified)::BIGINT AS unverified_submissions, round(count(*) FILTER (terminal_reason IN ('loop', 'max_actions')) / count(*), 6) AS loop_or_max_actions_rate, {", ".join(f"round(avg({c}), 6) AS {c}_mean, {RANK.format(x=c, p='0.5')} AS {c}_p50, {RANK.format(x=c, p='0.95')} AS {c}_p95" for c in ("actions", "context_tokens", "latency_ms", "cost_micro_usd"))},
  list_sort(list_distinct(list(coalesce(rejection_reason, 'accepted')) FILTER (NOT accepted))) AS reasons, count(*) FILTER (NOT accepted) AS refused"""
_SIZE = "CASE WHEN database_size_bytes < 10485760 THEN 'small_lt_10_mib' WHEN database_size_bytes < 104857600 THEN 'medium_lt_100_mib' ELSE 'large_ge_100_mib' END"


@query(
    "e7_diagnostics_grouping_sets",
    f"""{WE}, {_ATT}
SELECT 'database' AS grouping_name, split || ':' || db_id AS group_value, {_GROUPS} FROM att GROUP BY split, db_id
UNION ALL SELECT 'complexity', split || ':' || complexity, {_GROUPS} FROM att GROUP BY split, complexity
UNION ALL SELECT 'sampling_cell', split || ':' || db_id || ':' || complexity, {_GROUPS} FROM att GROUP BY split, db_id, complexity
UNION ALL SELECT 'database_size', {_SIZE}, {_GROUPS} FROM att GROUP BY {_SIZE}""",
)
def diagnostics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E7."""
    g = diagnostics.by_groups(_attempts(spark, sf_dir))
    many = F.aggregate(F.map_values("rejection_reasons"), F.lit(0).cast("long"), lambda a, b: a + b)
    return g.select("*", F.array_sort(F.map_keys("rejection_reasons")).alias("reasons"), many.alias("refused")).drop("rejection_reasons")


_SEQ = "sq AS (SELECT *, row_number() OVER (ORDER BY episode_id) AS seq FROM att)"


def _sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.sequence(_attempts(spark, sf_dir), "episode_id")


_RULES = {
    "first_20_without_accepted": "n >= 20 AND first = 0",
    "protocol_or_argument_error_rate_gt_5pct": "n >= 20 AND form / n > 0.05",
    "pilot_acceptance_upper_bound_lt_75pct": f"n >= 20 AND {WILSON.format(s='acc', n='n')} < 0.75",
    "schema_without_columns": "nocol > 0",
    "schema_truncation_rate_gt_5pct": "n >= 20 AND sc > 0 AND trunc::DOUBLE / sc > 0.05",
    "execute_timeout_rate_gt_2pct": "n >= 20 AND ec > 0 AND et::DOUBLE / ec > 0.02",
    "stratum_execute_timeout_rate_gt_5pct": "n >= 20 AND worst > 0.05",
    "context_overflow_rate_gt_1pct": "n > 0 AND ov / n > 0.01",
    "loop_or_max_actions_rate_gt_5pct": "n >= 20 AND loops / n > 0.05",
    "replay_or_database_sha_mismatch": "replay > 0",
    "accepted_trajectory_invariant_violation": "viol > 0",
    "systemic_api_or_budget_error": "sys >= 2 OR (n >= 20 AND sys / n > 0.05)",
    "reasoning_token_breakdown_missing": "nobreak > 0",
    "campaign_cost_limit_exceeded": "true",
    "campaign_token_limit_exceeded": "false",
}


@query(
    "e6_pause_rules",
    f"""{WE}, {_ATT}, {_SEQ}, t AS (SELECT count(*) AS n, count(*) FILTER (accepted) AS acc, count(*) FILTER (accepted AND seq <= 20) AS first, count(*) FILTER (protocol OR invalid_arguments) AS form,
  sum(execute_calls) AS ec, sum(execute_timeouts) AS et, sum(schema_calls) AS sc, sum(schema_truncated) AS trunc, sum(schema_without_columns) AS nocol, count(*) FILTER (terminal_reason IN ('loop', 'max_actions')) AS loops,
  count(*) FILTER (infrastructure_code = 'context_overflow') AS ov, count(*) FILTER (infrastructure_code = 'api_transport_error') AS sys, count(*) FILTER (accepted AND (user_id % 31 = 0 OR user_id % 37 = 0)) AS replay,
  count(*) FILTER (accepted AND user_id % 41 = 0) AS viol, count(*) FILTER (reasoning_present > 0 AND reasoning_tokens_reported = 0) AS nobreak FROM sq),
c AS (SELECT max(CASE WHEN ec = 0 THEN 0.0 ELSE et::DOUBLE / ec END) AS worst FROM (SELECT sum(execute_calls) AS ec, sum(execute_timeouts) AS et FROM sq GROUP BY split, db_id, complexity))
{" UNION ALL ".join(f"SELECT '{name}' AS reason, ({rule}) AS holds FROM t, c" for name, rule in _RULES.items())}""",
)
def pause_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule, and whether it would pause a collection that has spent 5.2 of 5 dollars and 10 of 10 tokens."""
    return diagnostics.pause_rules(diagnostics.totals(_sequenced(spark, sf_dir), cost_limit=5.0, spent=5.2, token_limit=10, used=10))


def _counters() -> str:
    zero = lambda x: f"coalesce({x}, 0)"
    share = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE {a}::DOUBLE / {b} END"
    count = lambda x: f"count(*) FILTER ({x})"
    fixed = count("coded_error AND reward = 1")
    flat = [
        ("", "attempts", "count(*)"), ("", "accepted", count("accepted")), ("", "acceptance_rate", f"{count('accepted')} / count(*)"), ("", "protocol_attempts", count("protocol")), ("", "invalid_argument_attempts", count("invalid_arguments")),
        ("", "protocol_or_argument_attempts", count("protocol OR invalid_arguments")), ("", "multiple_native_tool_call_responses", "sum(several_calls)"), ("", "invalid_text_action_responses", "sum(bad_json)"),
        ("", "normalization_failures", "sum(user_id % 3)"), ("", "native_tool_calls", "sum(n_events - 1)"), ("", "text_json_calls", "sum(user_id % 2)"), ("", "response_calls", "sum(n_events)"),
        ("", "normalization_failure_rate", share("sum(user_id % 3)", "sum(n_events)")), ("", "native_tool_call_rate", share("sum(n_events - 1)", "sum(n_events)")),
        ("", "missing_reasoning_breakdown", count("reasoning_present > 0 AND reasoning_tokens_reported = 0")), ("", "systemic_api_error_attempts", count("infrastructure_code = 'api_transport_error'")),
        ("", "provider_data_inspection_failures", count("user_id % 29 = 0")), ("", "accepted_invariant_violations", count("accepted AND user_id % 41 = 0")),
        ("schema", "calls", "sum(schema_calls)"), ("schema", "without_columns", "sum(schema_without_columns)"), ("schema", "truncated", "sum(schema_truncated)"), ("schema", "with_omitted_tables", "sum(schema_omitted)"),
        ("execute_sql", "calls", "sum(execute_calls)"), ("execute_sql", "timeouts", "sum(execute_timeouts)"), ("execute_sql", "sqlite_errors", "sum(execute_errors)"), ("submissions", "unverified", "sum(unverified)"),
        ("actions", "repeated_calls", "sum(repeated_calls)"), ("actions", "ineffective_searches", "sum(ineffective_searches)"), ("actions", "attempts_with_tool_error", count("coded_error")), ("actions", "corrected_final_results", fixed),
        ("actions", "correction_success_rate", share(fixed, count("coded_error"))), ("actions", "loop_or_max_actions", count("terminal_reason IN ('loop', 'max_actions')")), ("actions", "observations_followed_by_action", "sum(followed)"),
        ("actions", "observations_followed_by_distinct_action", "sum(followed_by_other)"), ("actions", "observation_utilization_rate", share("sum(followed_by_other)", "sum(followed)")),
        ("replay", "checked", count("accepted")), ("replay", "mismatches", count("accepted AND user_id % 31 = 0")), ("replay", "database_sha_mismatches", count("accepted AND user_id % 37 = 0")),
        ("finish_reasons", "missing_or_legacy", "sum(greatest(n_events - 1 - user_id % 2, 0))"), ("finish_reasons", "stop", "count(*)"), ("finish_reasons", "tool_calls", "sum(0)"), ("finish_reasons", "length", "sum(user_id % 2)"), ("finish_reasons", "other", "sum(0)"),
    ]
    parts = [f"SELECT '{s}' AS section, '{x}' AS name, {zero(v)}::DOUBLE AS value FROM att" for s, x, v in flat]
    maps = [("rejection_reasons", "coalesce(rejection_reason, 'unknown')", "att WHERE NOT accepted"), ("infrastructure_codes", "infrastructure_code", "att WHERE infrastructure_code IS NOT NULL"),
        ("infrastructure_details", "'{\"retry\":3}'", "att WHERE terminal_reason = 'infrastructure_error' AND user_id % 7 = 0"), ("tool_distribution", "tool", "ev WHERE tool <> 'protocol'"),
        ("gate_errors", "error_code", "ev WHERE error_code IN ('submission_not_executed', 'submission_sql_mismatch', 'undescribed_table')")]
    parts += [f"SELECT '{s}', {x}, count(*)::DOUBLE FROM {source} GROUP BY 2" for s, x, source in maps]
    summed = {
        "usage.input_tokens": "tokens", "usage.billed_output_tokens": "7 * n_events", "usage.reasoning_tokens": "0", "usage.reasoning_tokens_reported": "reasoning_tokens_reported", "usage.reasoning_present": "reasoning_present",
        "usage.action_tokens": "0", "usage.latency_ms": "latency_ms", "usage.cost_micro_usd": "cost_micro_usd", "usage.context_tokens": "context_tokens", "actions.count": "actions",
    }
    for s, x in summed.items():
        parts.append(f"SELECT '{s}', unnest(['mean', 'p50', 'p95']), unnest([round(avg({x}), 4), {RANK.format(x=x, p='0.5')}, {RANK.format(x=x, p='0.95')}]) FROM att")
    x = "(100 + 10 * (tokens % 50))"
    parts.append(f"SELECT 'schema.bytes', unnest(['mean', 'p50', 'p95']), unnest([round(avg({x}), 4), {RANK.format(x=x, p='0.5')}, {RANK.format(x=x, p='0.95')}]) FROM ev WHERE tool = 'describe_schema'")
    return f"{WE}, {_ATT}, r AS ({' UNION ALL '.join(parts)}) SELECT section, name, round(value, 6) AS value FROM r"


@query("e6_counters", _counters())
def attempt_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a batch of attempts."""
    ev = adapters.observed(_ev(spark, sf_dir))
    return diagnostics.counters(ev, _attempts(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "e25_migration_report",
    f"""{WE}, {_ATT}, x AS (SELECT *, CASE WHEN user_id % 13 = 0 OR user_id % 19 = 0 THEN 'missing_task_or_answer' WHEN user_id % 11 = 5 THEN 'initial_actor_messages_changed' WHEN n_events % 7 = 3 THEN 'visible_prompt_or_tools_changed'
  WHEN tokens % 5 = 0 THEN 'event_replay_mismatch' WHEN tokens % 7 = 0 THEN 'new_acceptance:' || CASE WHEN tokens % 2 = 0 THEN 'loop' ELSE 'unknown' END END AS reason FROM att WHERE accepted AND user_id % 17 <> 0),
f AS (SELECT *, min(CASE WHEN reason IS NULL THEN episode_id END) OVER (PARTITION BY user_id) AS first FROM x)
SELECT 'eligible_accepted' AS name, count(*) FILTER (accepted) AS n FROM att UNION ALL SELECT coalesce(reason, 'migrated'), count(*) FROM f WHERE first IS NULL OR episode_id <= first GROUP BY 1""",
)
def migration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted attempts taken over into new settings; users stand for tasks."""
    a = _attempts(spark, sf_dir)
    u, k = F.col("user_id"), F.col("tokens")
    attempts = a.select(u.alias("task_id"), "episode_id", "accepted", (u % 11).cast("string").alias("actor_hash"), F.when(F.col("n_events") % 7 == 3, "old").otherwise("now").alias("protocol_hash"))
    users = a.select(u.alias("task_id")).distinct()
    tasks = users.where("task_id % 13 <> 0").select("task_id", F.when(F.col("task_id") % 11 == 5, "other").otherwise((F.col("task_id") % 11).cast("string")).alias("actor_hash"))
    replays = a.select("episode_id", (k % 5 != 0).alias("exact"), (k % 7 != 0).alias("still_accepted"), F.when(k % 2 == 0, "loop").alias("refusal"))
    found = migration.outcomes(attempts, users.where("task_id % 17 = 0"), tasks, users.where("task_id % 19 <> 0"), replays, "now")
    return migration.report(attempts, found)


@query("f11_h8_count_windows", f"{WE}, {_ATT}, {_SEQ} SELECT ((seq - 1) // 100)::BIGINT AS \"window\", count(*) AS attempts, count(*) FILTER (accepted) AS accepted, count(*) < 100 AS partial FROM sq GROUP BY 1")
def count_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 attempts."""
    return diagnostics.windows(_sequenced(spark, sf_dir))


@query("e8_usage_summary", f"SELECT user_id, round(avg(value), 4) AS mean, {RANK.format(x='value', p='0.5')} AS p50, {RANK.format(x='value', p='0.95')} AS p95 FROM events GROUP BY user_id")
def usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    return diagnostics.usage(_ev(spark, sf_dir), "elapsed_ms", "user_id")


@query("e9_wilson_upper", f"{WE}, {_ATT} SELECT db_id, round({WILSON.format(s='s', n='n')}, 9) AS upper FROM (SELECT db_id, count(*) FILTER (accepted) AS s, count(*) AS n FROM att GROUP BY db_id)")
def wilson_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E9."""
    g = _attempts(spark, sf_dir).groupBy("db_id").agg(F.count_if("accepted").alias("s"), F.count("*").alias("n"))
    return g.select("db_id", F.round(X.wilson_upper(F.col("s"), F.col("n")), 9).alias("upper"))


@query(
    "e10_pilot_projection",
    f"{WE}, {_ATT} SELECT n AS attempts, round(1000 / greatest(s::DOUBLE / n, 1e-12), 4) AS projected_attempts, round(tokens::DOUBLE / n * 1000 / greatest(s::DOUBLE / n, 1e-12), 2) AS projected_tokens FROM (SELECT count(*) AS n, count(*) FILTER (accepted) AS s, sum(tokens) AS tokens FROM att)",
)
def pilot_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and tokens for 1,000 accepted ones at the rate so far."""
    a = _attempts(spark, sf_dir).agg(F.count("*").alias("attempts"), F.count_if("accepted").alias("s"), F.sum("tokens").alias("tokens"))
    rate = F.greatest(F.col("s") / F.col("attempts"), F.lit(1e-12))
    return a.select("attempts", F.round(1000 / rate, 4).alias("projected_attempts"), F.round(F.col("tokens") / F.col("attempts") * 1000 / rate, 2).alias("projected_tokens"))


@query("e21_accepted_by_groups", f"{WE}, {_ATT} SELECT split, complexity, db_id, count(*) FILTER (accepted) AS accepted FROM att GROUP BY GROUPING SETS ((split), (complexity), (db_id))")
def accepted_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E21."""
    a = _attempts(spark, sf_dir)
    cols = [F.col("split"), F.col("complexity"), F.col("db_id")]
    return a.groupingSets([[c] for c in cols], *cols).agg(F.count_if("accepted").alias("accepted"))


@query("e1_status_counts", f"{WE} SELECT terminal_reason, count(*) AS n FROM ep GROUP BY terminal_reason")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by reason."""
    return adapters.episodes(_ev(spark, sf_dir)).groupBy("terminal_reason").agg(F.count("*").alias("n"))


_ARG = "concat('q', tokens % 5)"
_EVA = f"eva AS (SELECT *, CASE WHEN tool = 'describe_schema' THEN concat('T', tokens % 3) ELSE {_ARG} END AS argument, concat('T', tokens % 3) AS argument_table FROM ev)"


def _with_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ev(spark, sf_dir)
    t = F.concat(F.lit("T"), (F.col("tokens") % 3).cast("string"))
    return e.withColumn("argument", F.when(F.col("tool") == "describe_schema", t).otherwise(F.concat(F.lit("q"), (F.col("tokens") % 5).cast("string")))).withColumn("argument_table", t)


@query(
    "c5_acceptance_reason",
    f"""WITH {EV}, {EP}, {_EVA}, x AS (SELECT episode_id, bool_or(tool = 'protocol') AS hp, arg_min(coalesce(error_code, 'observation_not_ok'), step) FILTER (NOT ok OR error_code IS NOT NULL) AS fe,
  coalesce(list_sort(list(DISTINCT lower(argument)) FILTER (tool = 'describe_schema')), []) AS described, arg_max(argument, step) FILTER (tool = 'execute_sql') AS le, arg_max(tool, step) AS lt,
  arg_max(argument, step) FILTER (tool = 'submit_sql') AS su, max(tokens) AS ma, sum(tokens) AS ct FROM eva GROUP BY episode_id)
SELECT episode_id, CASE WHEN terminal_reason = 'infrastructure_error' THEN 'invalid_infrastructure' WHEN terminal_reason <> 'submitted' THEN terminal_reason
  WHEN user_id % 4 = 3 THEN 'execution_not_correct' WHEN hp THEN 'protocol_error' WHEN fe IS NOT NULL THEN 'tool_error:' || fe WHEN len(described) = 0 THEN 'missing_schema_description'
  WHEN le IS NULL THEN 'missing_successful_execute' WHEN lt <> 'submit_sql' THEN 'missing_submit' WHEN le <> su THEN 'submission_sql_mismatch' WHEN NOT list_contains(described, 't1') THEN 'undescribed_table'
  WHEN ma > 90 THEN 'action_too_long' WHEN ct > 150 THEN 'context_overflow' END AS reason FROM ep JOIN x USING (episode_id)""",
)
def acceptance_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against each episode."""
    e = _with_arguments(spark, sf_dir)
    ep = adapters.episodes(_ev(spark, sf_dir)).drop("has_protocol").join(acceptance.evidence(e), "episode_id")
    ep = ep.withColumn("valid", F.col("terminal_reason") != "infrastructure_error").withColumn("infrastructure_code", F.lit(None).cast("string"))
    ep = ep.withColumn("reward", F.when(F.col("user_id") % 4 == 3, 0.0).otherwise(1.0)).withColumn("used_tables", F.array(F.lit("t1")))
    return ep.select("episode_id", acceptance.reason(90, 150).alias("reason"))


@query(
    "c11_submission_gate",
    f"""WITH {EV}, {_EVA}, w AS (SELECT *, last_value(CASE WHEN tool = 'execute_sql' AND ok THEN argument END IGNORE NULLS) OVER b AS executed,
  list(CASE WHEN tool = 'describe_schema' AND ok THEN argument_table END) OVER b AS described FROM eva WINDOW b AS (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT episode_id, step, CASE WHEN executed IS NULL THEN 'submission_not_executed' WHEN executed <> argument THEN 'submission_sql_mismatch' WHEN NOT coalesce(list_contains(described, argument_table), false) THEN 'undescribed_table' ELSE 'ok' END AS verdict
FROM w WHERE tool = 'submit_sql'""",
)
def submission_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11."""
    return acceptance.gate(_with_arguments(spark, sf_dir))


@query("d14_replay_compare", f"{W} SELECT episode_id, step FROM ev WHERE event_id % 17 = 0 OR event_id % 23 = 0")
def replay_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps where a replay differs or lacks a step."""
    ev = _ev(spark, sf_dir)
    again = ev.where("event_id % 23 <> 0").withColumn("ok", F.when(F.col("event_id") % 17 == 0, ~F.col("ok")).otherwise(F.col("ok")))
    return episodes.replay(ev, again, ["tool", "ok", "error_code"])


@query("c15_judge_citations", f"{W} SELECT episode_id, list_sort(['x:99']) [1] AS unknown FROM (SELECT DISTINCT episode_id FROM ev WHERE user_id % 5 = 0)")
def judge_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that cite an event which is not there."""
    ev = episodes.numbered(_ev(spark, sf_dir))
    known = ev.groupBy("episode_id", "user_id").agg(F.array_agg("event_name").alias("event_citations"))
    scores = known.withColumn("event_citations", F.when(F.col("user_id") % 5 == 0, F.concat("event_citations", F.array(F.lit("x:99")))).otherwise(F.col("event_citations")))
    return checks.cited(scores.select("episode_id", "event_citations"), ev).select("episode_id", F.array_join("unknown", ",").alias("unknown"))


@query(
    "g6_payload_truncation",
    f"""{W}, u AS (SELECT *, sum(tokens) OVER (PARTITION BY episode_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used, sum(tokens) OVER (PARTITION BY episode_id) AS total FROM ev)
SELECT event_id, used::BIGINT AS used, total > 120 AS truncated FROM u WHERE used <= 120""",
)
def payload_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix that fits a budget."""
    return catalog.bounded(_ev(spark, sf_dir), "tokens", 120, "episode_id", "step").select("event_id", "used", "truncated")


@query("g6_payload_summary", "SELECT doc_id, CASE WHEN octet_length(encode(text)) <= 2000 THEN text ELSE '{\"original_bytes\":' || octet_length(encode(text)) || ',\"sha256\":\"' || sha256(text) || '\"}' END AS payload FROM documents")
def payload_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not fit is replaced by its size and hash."""
    from ..session import table

    return table(spark, sf_dir, "documents").select("doc_id", catalog.observation(F.col("text"), 2000).alias("payload"))


_REWARD_CASES = """v AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'infrastructure_error' WHEN 1 THEN 'unsafe_sql' WHEN 2 THEN 'loop' WHEN 3 THEN 'max_actions' ELSE 'submitted' END AS t,
  CASE WHEN event_id % 11 = 0 THEN 'timeout' ELSE 'passed' END AS gs, CASE WHEN event_id % 11 = 0 THEN NULL ELSE 'd' || (event_id % 2) END AS gd,
  CASE WHEN event_id % 13 = 0 THEN 'syntax_error' WHEN event_id % 13 = 1 THEN 'unsafe_sql' WHEN event_id % 13 = 2 THEN 'infrastructure_error' ELSE 'passed' END AS ps,
  CASE WHEN event_id % 13 < 3 THEN NULL ELSE 'd' || (event_id % 3) END AS pd FROM events)"""


@query(
    "fn_terminal_reward",
    f"""WITH {_REWARD_CASES} SELECT event_id, CASE WHEN t = 'infrastructure_error' THEN NULL WHEN t = 'unsafe_sql' THEN -1.0 WHEN t IN ('loop', 'max_actions') THEN -0.4 WHEN gs <> 'passed' OR gd IS NULL THEN NULL
  WHEN ps = 'infrastructure_error' THEN NULL WHEN ps = 'unsafe_sql' THEN -1.0 WHEN ps <> 'passed' OR pd IS NULL THEN -0.2 WHEN pd = gd THEN 1.0 ELSE 0.0 END::DOUBLE AS reward,
  CASE WHEN t = 'infrastructure_error' THEN t WHEN t = 'unsafe_sql' THEN t WHEN t IN ('loop', 'max_actions') THEN t WHEN gs <> 'passed' OR gd IS NULL THEN 'invalid_gold'
  WHEN ps = 'infrastructure_error' THEN 'prediction_infrastructure_error' WHEN ps = 'unsafe_sql' THEN 'unsafe_sql' WHEN ps <> 'passed' OR pd IS NULL THEN 'submission_execution_error'
  WHEN pd = gd THEN 'execution_match' ELSE 'execution_mismatch' END AS reason FROM v""",
)
def terminal_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward of an episode's end."""
    from ..session import table

    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id")
    t = F.when(i % 6 == 0, "infrastructure_error").when(i % 6 == 1, "unsafe_sql").when(i % 6 == 2, "loop").when(i % 6 == 3, "max_actions").otherwise("submitted")
    gs = F.when(i % 11 == 0, "timeout").otherwise("passed")
    gd = F.when(i % 11 != 0, F.concat(F.lit("d"), (i % 2).cast("string")))
    ps = F.when(i % 13 == 0, "syntax_error").when(i % 13 == 1, "unsafe_sql").when(i % 13 == 2, "infrastructure_error").otherwise("passed")
    pd = F.when(i % 13 >= 3, F.concat(F.lit("d"), (i % 3).cast("string")))
    return e.select("event_id", X.terminal_reward(t, gs, gd, ps, pd).alias("r")).select("event_id", "r.reward", "r.reason")




@query(
    "c6_accepted_violations",
    f"""WITH {EV}, {EP}, {_EVA}, x AS (SELECT episode_id, bool_or(tool = 'protocol') AS hp, arg_min(coalesce(error_code, 'observation_not_ok'), step) FILTER (NOT ok OR error_code IS NOT NULL) AS fe,
  coalesce(list_sort(list(DISTINCT lower(argument)) FILTER (tool = 'describe_schema')), []) AS described, arg_max(argument, step) FILTER (tool = 'execute_sql') AS le, arg_max(tool, step) AS lt,
  arg_max(argument, step) FILTER (tool = 'submit_sql') AS su FROM eva GROUP BY episode_id)
SELECT episode_id, CASE WHEN terminal_reason = 'infrastructure_error' THEN 'invalid_infrastructure' WHEN terminal_reason <> 'submitted' THEN terminal_reason WHEN hp THEN 'protocol_error'
  WHEN fe IS NOT NULL THEN 'tool_error:' || fe WHEN len(described) = 0 THEN 'missing_schema_description' WHEN le IS NULL THEN 'missing_successful_execute' WHEN lt <> 'submit_sql' THEN 'missing_submit'
  WHEN le <> su THEN 'submission_sql_mismatch' ELSE 'undescribed_table' END AS reason FROM ep JOIN x USING (episode_id)
WHERE user_id % 2 = 0 AND NOT (terminal_reason = 'submitted' AND NOT hp AND fe IS NULL AND len(described) > 0 AND coalesce(le = su, false) AND list_contains(described, 't1'))""",
)
def accepted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted episodes that break a rule."""
    e = _with_arguments(spark, sf_dir)
    ep = adapters.episodes(_ev(spark, sf_dir)).drop("has_protocol").join(acceptance.evidence(e), "episode_id")
    ep = ep.withColumn("valid", F.col("terminal_reason") != "infrastructure_error").withColumn("infrastructure_code", F.lit(None).cast("string"))
    ep = ep.withColumn("reward", F.lit(1.0)).withColumn("used_tables", F.array(F.lit("t1"))).withColumn("accepted", F.col("user_id") % 2 == 0)
    return acceptance.violations(ep)


@query(
    "fn_episode_messages",
    f"""{W}, m AS (SELECT *, max(step) OVER (PARTITION BY episode_id) AS last FROM ev)
SELECT episode_id AS conv_id, string_agg('assistant=' || event_type || CASE WHEN step < last THEN ';tool=' || tool ELSE '' END, ';' ORDER BY step) AS shape FROM m GROUP BY episode_id""",
)
def episode_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training messages of episodes, without the last observation."""
    from ..operators import training

    e = _ev(spark, sf_dir).withColumn("action", F.col("event_type")).withColumn("observation", F.col("tool"))
    m = training.episode_messages(e)
    return m.select("conv_id", F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit("="), x["content"])), ";").alias("shape"))
