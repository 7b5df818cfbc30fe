"""All queries of the engine with their SQL; a query's name starts with its place in the operator inventory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Events in steps of episodes, and episodes, as DuckDB reads them.
EV = """ev AS (SELECT concat(user_id, ':', strftime(ts, '%Y-%m-%d')) AS episode_id, user_id, event_id,
  (row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1)::BIGINT AS step, event_type,
  CASE event_type WHEN 'view' THEN 'describe_schema' WHEN 'click' THEN 'search_values' WHEN 'signup' THEN 'execute_sql' WHEN 'purchase' THEN 'submit_sql' ELSE 'protocol' END AS tool,
  event_type <> 'error' AS ok, value AS elapsed_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
  CASE WHEN event_type = 'error' THEN ['timeout', 'invalid_arguments', 'syntax_error', 'undescribed_table'][CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + 1] END AS error_code
  FROM events)"""
EP = """ep AS (SELECT episode_id, user_id, concat('db_', user_id % 7) AS db_id, ['simple', 'moderate', 'challenging'][user_id % 3 + 1] AS complexity,
  CASE WHEN user_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, user_id * 1024 * 1024 AS database_size_bytes, n_events, tokens, has_protocol,
  CASE WHEN last_type = 'purchase' THEN 'submitted' WHEN last_type = 'error' THEN 'infrastructure_error' WHEN n_events >= 4 THEN 'max_actions' ELSE 'loop' END AS terminal_reason
  FROM (SELECT episode_id, user_id, count(*) AS n_events, arg_max(event_type, step) AS last_type, bool_or(tool = 'protocol') AS has_protocol, sum(tokens)::BIGINT AS tokens
  FROM ev GROUP BY episode_id, user_id))"""


def query(name: str, sql: str | None = None):
    """Register a query under a name, with DuckDB SQL for its rows where SQL can give them."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


from . import datasets, episodes, functions, splits, sql_surface, streams, training  # noqa: E402, F401
