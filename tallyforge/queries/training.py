"""Training sequences, reward groups and ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import groups, ledger, training
from ..session import table
from ..sources import adapters
from . import query

_R = """r AS (SELECT event_id AS idx, event_id // 4 AS uid, CASE WHEN event_id % 10 = 9 THEN NULL ELSE CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'click' THEN -0.2 WHEN 'signup' THEN -0.4 WHEN 'error' THEN -1.0 END END::DOUBLE AS reward FROM events)"""
_G = f"{_R}, g AS (SELECT uid, count(*) AS size, min(idx) AS first, min(reward) = max(reward) AS uniform, min(reward) AS low, count(*) FILTER (reward IS NULL) AS invalid FROM r GROUP BY uid)"


@query("e14_reward_groups", f"WITH {_G} SELECT uid, size, first, uniform, invalid FROM g")
def reward_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and whether all their rewards are equal."""
    return groups.analyze(adapters.rewards(spark, sf_dir)).select("uid", "size", "first", "uniform", "invalid")


@query("e14_group_problems", f"WITH {_G} SELECT uid, CASE WHEN size <> 4 THEN 'wrong size' ELSE 'reward is not finite' END AS problem FROM g WHERE size <> 4 OR invalid > 0")
def group_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that must be refused."""
    return groups.problems(groups.analyze(adapters.rewards(spark, sf_dir)), 4)


@query("e15_group_advantages", f"WITH {_R} SELECT idx, round(CASE WHEN reward IS NULL THEN NULL WHEN min(reward) OVER w = max(reward) OVER w THEN 0.0 ELSE (reward - avg(reward) OVER w) / stddev_pop(reward) OVER w END, 6) AS advantage FROM r WINDOW w AS (PARTITION BY uid)")
def group_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E15."""
    r = groups.positional(adapters.rewards(spark, sf_dir).select("idx", "reward"), 4)
    return groups.advantages(r).select("idx", F.round("advantage", 6).alias("advantage"))


_SEL = f"{_G}, d AS (SELECT *, row_number() OVER (ORDER BY first) AS n FROM g WHERE NOT uniform)"


@query("f10_diverse_group_select", f"WITH {_SEL} SELECT uid, first, CASE WHEN n <= 30 THEN 'selected' ELSE 'surplus' END AS state FROM d")
def diverse_group_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first groups up to the quota."""
    return groups.select_diverse(groups.analyze(adapters.rewards(spark, sf_dir)), 30)


@query("f10_selected_rows", f"WITH {_SEL} SELECT r.idx, r.uid FROM r JOIN d USING (uid) WHERE n <= 30")
def selected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rollouts of the selected groups."""
    r = adapters.rewards(spark, sf_dir)
    return groups.selected_rows(r, groups.select_diverse(groups.analyze(r), 30)).select("idx", "uid")


@query("e26_reward_buckets", f"WITH {_G} SELECT CASE WHEN low = 0 THEN '0' WHEN low = 1 THEN '1' WHEN low = -1 THEN '-1' ELSE low::VARCHAR END AS reward, count(*) AS groups FROM g WHERE uniform GROUP BY 1")
def reward_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform groups by their reward."""
    return groups.reward_buckets(groups.analyze(adapters.rewards(spark, sf_dir)))


@query("e26_filter_summary", f"WITH {_SEL} SELECT count(*) AS generated_groups, (SELECT count(*) FROM d) AS diverse, count(*) FILTER (uniform) AS uniform_groups, least(30, (SELECT count(*) FROM d)) AS retained, round(least(30, (SELECT count(*) FROM d)) / count(*), 6) AS effective_rate FROM g")
def filter_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E26."""
    g = groups.analyze(adapters.rewards(spark, sf_dir))
    n = F.count("*")
    kept = F.least(F.lit(30), F.count_if(~F.col("uniform")))
    return g.agg(n.alias("generated_groups"), F.count_if(~F.col("uniform")).alias("diverse"), F.count_if("uniform").alias("uniform_groups"), kept.alias("retained"), F.round(kept / n, 6).alias("effective_rate"))


#: Updates of 60 diverse groups from batches of 50 groups of 4.
H7_SQL = f"""WITH RECURSIVE {_G}, b AS (SELECT uid // 50 AS batch, count(*) AS groups, count(*) FILTER (NOT uniform) AS mixed, count(*) FILTER (uniform) AS flat FROM g WHERE uniform IS NOT NULL GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY batch) AS i FROM b),
w AS (SELECT i, 1 AS update, mixed AS have FROM n WHERE i = 1 UNION ALL
    SELECT n.i, CASE WHEN have >= 60 THEN update + 1 ELSE update END, CASE WHEN have >= 60 THEN mixed ELSE have + mixed END FROM w JOIN n ON n.i = w.i + 1),
u AS (SELECT update::BIGINT AS update, count(*) AS batches, sum(groups)::BIGINT AS groups, sum(mixed)::BIGINT AS mixed, sum(flat)::BIGINT AS flat FROM w JOIN n USING (i) GROUP BY 1),
k AS (SELECT *, CASE WHEN mixed >= 60 THEN 60 ELSE 0 END::BIGINT AS kept FROM u)
SELECT update, CASE WHEN mixed >= 60 THEN 'updated' ELSE 'data_exhausted' END AS status, batches AS generation_batches, groups AS generated_groups, mixed AS diverse_groups_seen, kept AS retained_groups,
    flat AS discarded_uniform_groups, greatest(mixed - 60, 0)::BIGINT AS discarded_surplus_diverse_groups, kept / groups AS effective_group_rate, ((groups - kept) * 4)::BIGINT AS extra_rollouts,
    sum(groups) OVER (ORDER BY update)::BIGINT AS total_generated_groups, sum(kept) OVER (ORDER BY update)::BIGINT AS total_retained_groups FROM k"""


@query("h7_updates", H7_SQL)
def filter_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of 60 diverse groups from batches of 50 groups, with the counters so far."""
    g = groups.analyze(adapters.rewards(spark, sf_dir)).where("uniform is not null").withColumn("batch", F.floor(F.col("uid") / 50))
    return groups.updates(g, 60, 4, 10**6).drop("generated_rollouts", "buffered_diverse_groups", "retained_rollouts", "total_generation_batches", "total_discarded_uniform_groups")


_ROLE = "CASE WHEN role = 'system' THEN 'tool' ELSE role END"
_C = f"m AS (SELECT conv_id, turn, {_ROLE} AS role, text FROM conversations)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages; those of the system stand for tools' answers."""
    return adapters.messages(spark, sf_dir).withColumn("role", F.when(F.col("role") == "system", "tool").otherwise(F.col("role")))


@query("c13_role_rewrite", f"WITH {_C} SELECT conv_id, turn, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role, CASE WHEN role = 'tool' THEN '<tool_response>' || chr(10) || text || chr(10) || '</tool_response>' ELSE text END AS content FROM m")
def role_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C13."""
    role, content = training.rewritten(F.col("role"), F.col("text"))
    return _messages(spark, sf_dir).select("conv_id", "turn", role.alias("role"), content.alias("content"))


@query(
    "c4_hidden_fields",
    """SELECT conv_id, turn, CASE (conv_id + turn) % 5 WHEN 0 THEN 'gold_sql' WHEN 1 THEN 'reward' ELSE 'correctness,reward' END AS hidden FROM conversations WHERE (conv_id + turn) % 5 < 3""",
)
def hidden_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: payloads with what an actor may not see: one level down, in a list, or in JSON inside a string; words that are no fields may stay."""
    n = (F.col("conv_id") + F.col("turn")) % 5
    text = F.struct(F.col("text").alias("said"))
    payload = (
        F.when(n == 0, F.to_json(F.struct(F.struct(F.lit("SELECT 1").alias("gold_sql"), text.alias("more")).alias("task"))))
        .when(n == 1, F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("reward"))).alias("events"))))
        .when(n == 2, F.to_json(F.struct(F.to_json(F.struct(F.lit(1).alias("reward"), F.lit("x").alias("correctness"))).alias("inner"))))
        .when(n == 3, F.to_json(F.struct(F.lit("the reward of gold_sql is its correctness").alias("note"))))
        .otherwise(F.to_json(text))
    )
    m = adapters.messages(spark, sf_dir).select("conv_id", "turn", payload.alias("payload"))
    return training.hidden_fields(m, "payload").select("conv_id", "turn", F.array_join("hidden", ",").alias("hidden"))


@query("fn_sft_messages", f"WITH {_C} SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS shape FROM m GROUP BY conv_id")
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of a conversation in order."""
    c = training.conversations(_messages(spark, sf_dir))
    return c.select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.length(m["content"]).cast("string"))), ",").alias("shape"))


_LEN = "length(CASE WHEN role = 'tool' THEN 'user' ELSE role END) + 12 + 1 + 11"


@query(
    "fn_action_only_mask",
    f"""WITH {_C}, s AS (SELECT conv_id, sum({_LEN} + length(text) + CASE WHEN role = 'tool' THEN 33 ELSE 0 END)::BIGINT AS n_ids, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS n_labels FROM m GROUP BY conv_id)
SELECT * FROM s WHERE n_labels > 0 AND n_ids <= 16384""",
)
def action_only_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and labels: only the assistant's content is learned."""
    s = training.action_only(training.conversations(_messages(spark, sf_dir)))
    return s.select("conv_id", F.size("input_ids").cast("long").alias("n_ids"), F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_labels"))


@query("fn_rollout_mask", f"WITH {_C} SELECT conv_id, least(sum(length(text)), 4000)::BIGINT AS n_ids, sum(length(text)) > 4000 AS cut FROM m GROUP BY conv_id")
def rollout_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of actions and observations, cut at a limit."""
    r = training.rollout(training.conversations(_messages(spark, sf_dir)), limit=4001)
    n = F.size("response_mask")
    return r.select("conv_id", F.least(n, F.lit(4000)).cast("long").alias("n_ids"), (n > 4000).alias("cut"))


@query(
    "fn_pad_collate",
    f"""WITH {_C}, s AS (SELECT conv_id, sum({_LEN} + length(text) + CASE WHEN role = 'tool' THEN 33 ELSE 0 END)::BIGINT AS n_ids, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS n_labels FROM m GROUP BY conv_id)
SELECT conv_id, max(n_ids) OVER (PARTITION BY conv_id // 8) AS width, n_ids FROM s WHERE n_labels > 0 AND n_ids <= 16384""",
)
def pad_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences filled up to the longest of their batch."""
    s = training.action_only(training.conversations(_messages(spark, sf_dir))).withColumn("batch", F.floor(F.col("conv_id") / 8))
    c = training.collate(s, "batch")
    return c.select("conv_id", F.size("input_ids").cast("long").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("n_ids"))


@query(
    "c17_sft_inspection",
    """SELECT conv_id, CASE WHEN arg_max(role, turn) <> 'assistant' THEN 'last message is not the assistant''s' WHEN arg_min(role, turn) = 'assistant' THEN 'first message is the assistant''s' ELSE 'empty message' END AS problem
FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) <> 'assistant' OR arg_min(role, turn) = 'assistant' OR bool_or(trim(coalesce(text, '')) = '')""",
)
def sft_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C17: conversations that cannot be trained on."""
    return training.inspect(training.conversations(adapters.messages(spark, sf_dir)))


@query("c18_grpo_inspection", "SELECT 'db_overlap' AS problem, count(*) AS n FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'task_overlap', 0 UNION ALL SELECT 'bad_path', count(*) FROM documents WHERE source = 'src1'")
def grpo_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of splits, and paths that leave their root."""
    t = adapters.tasks(spark, sf_dir).withColumn("path", F.when(F.col("db_id") == "src1", "../x").otherwise(F.col("db_id")))
    a, b = t.where("task_id % 2 = 0"), t.where("task_id % 2 = 1")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    out = count(a.select("db_id").intersect(b.select("db_id")), "db_overlap").unionByName(count(a.select("task_id").intersect(b.select("task_id")), "task_overlap"))
    return out.unionByName(count(t.where(F.col("path").rlike(r"(^|/)\.\.(/|$)|^/")), "bad_path"))


_L = """l AS (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type FROM events)"""


def _spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


@query("e19_campaign_totals", f"WITH {_L} SELECT count(*) AS attempts, sum(k)::BIGINT AS spent_micro_usd, sum(k + CASE WHEN event_id % 2 = 0 THEN k ELSE 2 * k END)::BIGINT AS used_tokens FROM l WHERE event_type <> 'error'")
def campaign_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of distinct episodes, without those that were migrated."""
    e = _spending(spark, sf_dir)
    a = e.select(
        F.col("event_id").alias("episode_id"), F.when(F.col("event_type") == "error", "old").alias("migrated_from"), F.col("k").alias("cost_micro_usd"), F.col("k").alias("input_tokens"),
        F.when(F.col("event_id") % 2 == 0, F.col("k")).alias("billed_output_tokens"), (2 * F.col("k")).alias("output_tokens"),
    )
    return ledger.totals(a.unionByName(a.where("episode_id % 3 = 0")))


@query("h5_budget_running", f"WITH {_L} SELECT event_id, coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before, coalesce(sum(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 50 <= 1500 AS allowed FROM l")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: what is spent before each request, and whether its reservation fits."""
    return ledger.running(_spending(spark, sf_dir), "user_id", ["event_id"], "k", F.lit(50), 1500).select("event_id", "spent_before", "allowed")


@query("h1_dedupe_latest", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type")
def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1: the last record of each key."""
    return ledger.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id")
