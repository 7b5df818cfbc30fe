"""Record schemas, their allowed values, and strict checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AUDIT_STATUS = ("passed", "syntax_error", "missing_table_or_column", "unsupported_function", "timeout", "unsafe_sql", "engine_error", "missing_database", "nondeterministic", "infrastructure_error", "result_too_large")
TERMINAL = ("submitted", "loop", "max_actions", "unsafe_sql", "infrastructure_error")
COMPLEXITY = ("simple", "moderate", "challenging")
TOOLS = ("list_tables", "describe_schema", "search_values", "execute_sql", "submit_sql")

ACTION = "struct<action:string,arguments:map<string,string>>"
OBSERVATION = "struct<event_id:string,tool:string,ok:boolean,payload:string,error_code:string,elapsed_ms:double,truncated:boolean>"
EVENT = f"struct<event_id:string,step:int,action:{ACTION},observation:{OBSERVATION}>"

TASK = "schema_version int, task_id string, split string, db_id string, question string, evidence string, db_ref string"
ANSWER = "schema_version int, task_id string, gold_sql string, audit_status string, result_cache_ref string"
EPISODE = (
    f"episode_id string, task_id string, terminal_reason string, events array<{EVENT}>, submitted_sql string, reward double, "
    "valid_for_training boolean, usage map<string,bigint>, database_sha256 string, infrastructure_error_code string, "
    "infrastructure_error_detail map<string,string>, infrastructure_request_sent boolean, config_hash string"
)
EVALUATION = (
    "task_id string, db_id string, prediction_sql string, ex double, soft_f1 double, r_ves double, prediction_status string, "
    "gold_status string, error_type string, infrastructure_status string, details map<string,string>"
)
AUDIT = (
    "task_id string, source_index bigint, db_id string, status string, executable boolean, rl_clean boolean, empty_result boolean, "
    "result_too_large boolean, deterministic boolean, row_count bigint, unique_row_count bigint, result_bytes bigint, result_digest string, "
    "elapsed_ms array<double>, error string, sql_sha256 string, db_sha256 string, fingerprint string, auditor_version string"
)
PREDICTION = "task_id string, prediction_sql string, usage map<string,bigint>"
INFERENCE = "task_id string, model_label string, config_hash string, condition_hash string, episode string"
ATTEMPT = (
    "task_id string, split string, db_id string, complexity string, complexity_score int, config_hash string, harness_config_hash string, "
    "accepted boolean, rejection_reason string, episode string, sft_tokens bigint, database_size_bytes bigint, migrated_from string"
)
CONVERSATION = "task_id string, split string, messages array<struct<role:string,content:string>>, assistant_message_indexes array<int>, source_config_hash string, source_harness_config_hash string"
TOKENIZED = "input_ids array<int>, labels array<int>, attention_mask array<int>"
ROLLOUT = "prompt_ids array<int>, response_ids array<int>, response_mask array<int>, reward_score double, num_turns int, extra_fields map<string,string>"
JUDGE = "task_id string, decomposition int, tool_use int, recovery int, efficiency int, event_citations array<string>, rationale string"
CAMPAIGN = (
    "campaign_id string, target_total bigint, max_attempts bigint, cost_limit_usd double, token_limit bigint, attempts bigint, "
    "spent_micro_usd bigint, used_tokens bigint, recorded_episode_ids array<string>, harness_config_hashes array<string>"
)


def names(schema: str) -> list[str]:
    """The top-level field names of a schema string."""
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fieldNames()


def extra_keys(raw: Column, schema: str) -> Column:
    """Keys of a JSON object that a schema does not know; the record is strict where there are none."""
    return F.array_except(F.json_object_keys(raw), F.array(*[F.lit(n) for n in names(schema)]))


def value_errors(df: DataFrame, column: str, allowed: tuple[str, ...]) -> DataFrame:
    """Rows whose value is not one of those allowed (null is not)."""
    return df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
