"""Sources and sinks, projections, joins and checks over records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import audit, checks, ledger
from ..session import removed_later, shared_dir, table
from ..sources import adapters, files, jsonl
from . import EP, EV, query



@query("b1_b2_jsonl_round_trip", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines and back, appended in two parts."""
    path = f"{shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    m = adapters.messages(spark, sf_dir)
    jsonl.write_jsonl(m.where("conv_id % 2 = 0"), path)
    jsonl.write_jsonl(m.where("conv_id % 2 = 1"), path, "append")
    return jsonl.read_jsonl(spark, path, "conv_id bigint, turn bigint, role string, text string")


@query("b3_stable_json", "SELECT n_nationkey, CAST(to_json({'n_name': n_name, 'n_nationkey': n_nationkey, 'n_regionkey': n_regionkey}) AS VARCHAR) AS body FROM nation")
def stable_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B3."""
    return table(spark, sf_dir, "nation").select("n_nationkey", X.stable_json("n_regionkey", "n_name", "n_nationkey").alias("body"))


@query("b4_c21_manifest_verify", "SELECT * FROM (VALUES ('changed', 1::BIGINT), ('missing', 1::BIGINT)) AS v(problem, n)")
def manifest_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of files against a manifest with one changed and one missing."""
    hashed = files.file_hashes(spark, f"{sf_dir}/nation.parquet").unionByName(files.file_hashes(spark, f"{sf_dir}/region.parquet"))
    m = hashed.select("path", F.when(F.col("path").endswith("nation.parquet"), F.sha2("path", 256)).otherwise(F.col("sha256")).alias("sha256"))
    m = m.unionByName(spark.createDataFrame([("nowhere", "x")], "path string, sha256 string"))
    return jsonl.verify_manifest(hashed, m).groupBy("problem").agg(F.count("*").alias("n"))


@query(
    "b6_positional_join",
    """WITH a AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS position, item_id, concat('db', item_id % 3) AS db_id, regexp_replace(text, '\\s+', ' ', 'g') AS sql FROM benchmark)
SELECT position, db_id, CASE WHEN item_id % 5 = 0 THEN sql || ' x' ELSE sql END AS gold_sql, item_id % 5 <> 0 AND item_id % 7 <> 0 AS source_match FROM a""",
)
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and line-aligned answers, read from two written files and joined by the places of their lines."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("db"), (F.col("item_id") % 3).cast("string")).alias("db_id"), F.regexp_replace("text", r"\s+", " ").alias("sql"))
    sql = F.when(F.col("item_id") % 5 == 0, F.concat("sql", F.lit(" x"))).otherwise(F.col("sql"))
    line = F.concat(sql, F.lit("\t"), F.when(F.col("item_id") % 7 == 0, "other").otherwise(F.col("db_id")))
    base = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    for name, value in (("records", F.to_json(F.struct("db_id", "sql"))), ("answers", line)):
        b.orderBy("item_id").select(value.alias("value")).coalesce(1).write.text(f"{base}/{name}")  # one file is the form of the input
    removed_later(spark, base)
    records = files.numbered_lines(spark, f"{base}/records").select("position", F.from_json("line", "db_id string, sql string").alias("r")).select("position", "r.*")
    return jsonl.aligned(records, files.numbered_lines(spark, f"{base}/answers")).select("position", "db_id", "gold_sql", "source_match")


@query("b7_load_asserts", "SELECT count(*) AS n, count(DISTINCT item_id) AS ids, count(*) = count(DISTINCT item_id) AS unique_ids FROM benchmark")
def load_asserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that a load must have."""
    return table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("ids")).withColumn("unique_ids", F.col("n") == F.col("ids"))


@query(
    "b13_source_select",
    "SELECT c_nationkey, c_custkey, segments FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment <> 'BUILDING', c_acctbal, c_custkey) AS r, (SELECT count(DISTINCT d.c_mktsegment) FROM customer d WHERE d.c_nationkey = c.c_nationkey) AS segments FROM customer c) WHERE r = 1",
)
def source_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each group, and how many kinds it has."""
    c = table(spark, sf_dir, "customer")
    best = c.groupBy("c_nationkey").agg(F.min(F.struct(F.col("c_mktsegment") != "BUILDING", "c_acctbal", "c_custkey"))["c_custkey"].alias("c_custkey"), F.count_distinct("c_mktsegment").alias("segments"))
    return best


@query("e2_inventory_counts", "SELECT source AS db_id, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY source")
def inventory_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks and size of each database."""
    return audit.inventory(adapters.tasks(spark, sf_dir).select(F.col("db_id").alias("name"), F.col("n_chars").alias("size"))).withColumnRenamed("name", "db_id")


@query("c1_actor_projection", "SELECT doc_id AS task_id, source AS db_id, text AS question FROM documents")
def actor_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what an actor may see."""
    return adapters.tasks(spark, sf_dir).select("task_id", "db_id", "question")


_GOOD = "SELECT doc_id, source, quality FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0"


@query("c2_task_answer_split", f"SELECT doc_id AS task_id, 'task' AS kind FROM ({_GOOD}) UNION ALL SELECT doc_id, 'answer' FROM ({_GOOD})")
def task_answer_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two outputs of clean records."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("rl_clean"), F.lit("passed").alias("status"))
    ex = adapters.tasks(spark, sf_dir).withColumn("evidence", F.lit("")).withColumn("sql", F.col("question"))
    tasks, answers = audit.outputs(lab, ex)
    return tasks.select("task_id", F.lit("task").alias("kind")).unionByName(answers.select("task_id", F.lit("answer").alias("kind")))


@query("c3_final_filter", "SELECT doc_id AS task_id FROM labels WHERE quality = 1 AND toxic = 0 AND doc_id % 10 <> 0")
def final_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C3."""
    lab = table(spark, sf_dir, "labels")
    r = lab.select(F.col("doc_id").alias("task_id"), (F.col("quality") == 1).alias("executable"), (F.col("toxic") == 0).alias("deterministic"), (F.col("doc_id") % 10 == 0).alias("result_too_large"))
    return audit.final_filter(r).select("task_id")


@query("c8_duplicate_keys", "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that come again."""
    return checks.duplicates(adapters.messages(spark, sf_dir), "conv_id")


@query("c8_key_differences", "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL")
def key_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that only one side has."""
    return checks.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


_RAW = """CASE event_id % 5 WHEN 0 THEN '{"action":"list_tables","arguments":{}}' WHEN 1 THEN '{"action":"fly"}' WHEN 2 THEN '{"action":"submit_sql","extra":1}' WHEN 3 THEN '[1]' ELSE 'no json' END"""


@query(
    "c9_action_parser",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'list_tables' END AS name, ['unknown action', 'unknown key', 'not an object', 'not an object'][event_id % 5] AS error FROM events",
)
def action_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    from ..schemas import TOOLS

    raw = F.expr(_RAW)
    return table(spark, sf_dir, "events").select("event_id", checks.action(raw, TOOLS).alias("a")).select("event_id", "a.name", "a.error")


@query(
    "c10_argument_checks",
    "SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 7 > 5 THEN 'tables' WHEN event_id % 3 = 0 AND event_id % 7 > 1 THEN 'tables repeat' WHEN event_id % 25 NOT BETWEEN 1 AND 20 THEN 'limit' WHEN event_id % 2 = 0 THEN 'sql' END AS problem FROM events",
)
def argument_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    i = F.col("event_id")
    n = (i % 7).cast("int")
    tables = F.transform(F.slice(F.array(*[F.lit(x) for x in range(1, 8)]), F.lit(1), n), lambda x: F.concat(F.lit("t"), F.when((i % 3 == 0), F.lit("1")).otherwise(x.cast("string"))))
    return table(spark, sf_dir, "events").select("event_id", checks.arguments(tables, i % 25, F.when(i % 2 == 0, F.lit(" ")).otherwise(F.lit("SELECT 1"))).alias("problem"))


@query(
    "c12_response_normaliser",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{\"name\":\"a\"}' WHEN 2 THEN 'plain' END AS call, CASE event_id % 4 WHEN 1 THEN 'several calls' WHEN 3 THEN 'no call' END AS error FROM events",
)
def response_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One native call, or the text."""
    raw = F.expr("""CASE event_id % 4 WHEN 0 THEN '{"content":"","tool_calls":[{"name":"a"}]}' WHEN 1 THEN '{"tool_calls":[{"name":"a"},{"name":"b"}]}' WHEN 2 THEN '{"content":"plain"}' ELSE '{"content":" ","tool_calls":[]}' END""")
    return table(spark, sf_dir, "events").select("event_id", checks.tool_call(raw).alias("c")).select("event_id", "c.call", "c.error")


@query("c14_blind_payload", f"WITH {EV}, {EP} SELECT episode_id, '{{\"episode_id\":\"' || episode_id || '\",\"n_events\":' || n_events || ',\"terminal_reason\":\"' || terminal_reason || '\"}}' AS payload FROM ep")
def blind_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: what a judge sees has no reward and no gold answer."""
    ep = adapters.episodes(adapters.events(spark, sf_dir)).withColumn("reward", F.lit(1.0)).withColumn("gold_sql", F.lit("x"))
    return ep.select("episode_id", checks.blind(["reward", "terminal_reason", "gold_sql", "n_events", "episode_id"]).alias("payload"))


@query("c16_comparison_gate", "SELECT 'a task has no score' AS problem UNION ALL SELECT 'different conditions' UNION ALL SELECT 'different tasks'")
def comparison_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What forbids a comparison of three runs."""
    d = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"))
    run = lambda label: d.select(F.lit(label).alias("label"), "task_id", F.when(F.col("task_id") != 3, 1.0).alias("ex"), F.sha2(F.lit("a" if label == "base" else "b"), 256).alias("condition_hash"))
    return checks.comparable(run("base").unionByName(run("sft")).unionByName(run("grpo").where("task_id > 1")))


@query("c19_package_cross_check", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN 'lang,source' WHEN doc_id % 3 = 0 THEN 'lang' ELSE 'source' END AS fields FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def package_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between two packages."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    e = d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "zz").otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 5 == 0, "zz").otherwise(F.col("source")).alias("source"))
    return checks.field_differences(d, e, "doc_id", ["lang", "source"]).select("doc_id", F.array_join("fields", ",").alias("fields"))


@query("c20_request_budget", "SELECT conv_id, sum(length(text))::BIGINT + 4096 + 512 AS reserved, sum(length(text)) + 4096 + 512 <= 8000 AS fits FROM conversations GROUP BY conv_id")
def request_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: a request's tokens at most."""
    n = F.sum(F.length("text")) + 4096 + 512
    return adapters.messages(spark, sf_dir).groupBy("conv_id").agg(n.alias("reserved"), (n <= 8000).alias("fits"))


_CONFIGS = """k AS (SELECT source AS name, count(*) AS total, count(*) FILTER (doc_id % 5 <> 0) AS train, count(*) FILTER (doc_id % 5 = 0 AND lang IS NOT NULL) AS validation,
    count(*) FILTER (doc_id % 3 = 0) AS simple, count(*) FILTER (doc_id % 3 = 1) AS moderate, count(*) FILTER (doc_id % 7 = 2) AS challenging FROM documents WHERE source IS NOT NULL GROUP BY source)"""


@query(
    "c7_config_predicates",
    f"""WITH {_CONFIGS} SELECT name, 'quota' AS rule FROM k WHERE train + validation <> total OR 300 + validation < total UNION ALL SELECT name, 'weights' FROM k WHERE simple + moderate + challenging <> total
UNION ALL SELECT name, 'group_size' FROM k WHERE total % 9 < 2""",
)
def config_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a configuration breaks, of one for each source with targets and weights from its documents."""
    from ..config import broken_rules

    n, part = F.count("*"), lambda rule: F.count_if(F.expr(rule))
    k = table(spark, sf_dir, "documents").where("source is not null").groupBy(F.col("source").alias("name")).agg(
        n.alias("total"), part("doc_id % 5 <> 0").alias("train"), part("doc_id % 5 = 0 AND lang IS NOT NULL").alias("validation"), *[part(r).alias(c) for c, r in (("simple", "doc_id % 3 = 0"), ("moderate", "doc_id % 3 = 1"), ("challenging", "doc_id % 7 = 2"))]
    )
    pairs = lambda *cs, of=lambda c: F.col(c): F.create_map(*[x for c in cs for x in (F.lit(c), of(c))])
    return broken_rules(
        k.select(
            "name", F.col("total").alias("target_total"), (300 + F.col("validation")).alias("max_attempts"), (F.col("total") % 9).alias("group_size"), F.lit(1).alias("groups_per_update"), F.lit(1).alias("max_generation_batches"),
            pairs("train", "validation").alias("split_targets"), pairs("simple", "moderate", "challenging", of=lambda c: F.col(c) / F.col("total")).alias("weights"),
        )
    )


@query(
    "d1_scoring_join",
    "SELECT b.item_id AS task_id, d.text AS gold, CASE WHEN b.item_id % 4 <> 0 THEN b.text END AS prediction FROM benchmark b JOIN documents d ON d.doc_id = b.item_id",
)
def scoring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers must be there, predictions may be missing."""
    from ..operators.metrics import score_records

    b = table(spark, sf_dir, "benchmark")
    answers = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), F.col("text").alias("gold"))
    return score_records(b.select(F.col("item_id").alias("task_id")), answers, b.where("item_id % 4 <> 0").select(F.col("item_id").alias("task_id"), F.col("text").alias("prediction")))


@query("d3_missing_database", "SELECT doc_id AS task_id, CASE WHEN source IN ('src1', 'src2') THEN 'missing_database' ELSE 'passed' END AS status FROM documents")
def missing_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: tasks whose database has no hash."""
    t = adapters.tasks(spark, sf_dir)
    hashes = t.where("db_id NOT IN ('src1', 'src2')").select("db_id").distinct().withColumn("sha256", F.sha2("db_id", 256))
    return t.join(hashes, "db_id", "left").select("task_id", F.when(F.col("sha256").isNull(), "missing_database").otherwise("passed").alias("status"))


@query(
    "d4_h1_resume_cache",
    "SELECT doc_id AS task_id, doc_id % 2 = 0 AND doc_id % 3 = 0 AS hit FROM documents",
)
def resume_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record counts if its last fingerprint is today's."""
    t = adapters.tasks(spark, sf_dir).select("task_id", F.sha2("question", 256).alias("fingerprint"))
    old = t.where("task_id % 2 = 0").select("task_id", F.lit("old").alias("fingerprint"), F.lit(1).alias("version"))
    new = t.where("task_id % 2 = 0").select("task_id", F.when(F.col("task_id") % 3 == 0, F.col("fingerprint")).otherwise("changed").alias("fingerprint"), F.lit(2).alias("version"))
    return ledger.cached(t, old.unionByName(new), F.col("version")).select("task_id", "hit")


@query("d10_catalog_anti", "SELECT DISTINCT source FROM documents WHERE source NOT IN (SELECT concat('src', n_nationkey) FROM nation WHERE n_nationkey < 15)")
def catalog_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted names that the catalog does not have."""
    known = table(spark, sf_dir, "nation").where("n_nationkey < 15").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return table(spark, sf_dir, "documents").select("source").distinct().join(known, "source", "left_anti")


@query("d11_table_coverage", "SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) FILTER (o_orderpriority <> '5-LOW') AS missing FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderpriority <> '5-LOW') > 0")
def table_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is used but not described."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("used"))
    o = o.withColumn("missing", F.array_sort(F.array_except("used", F.array(F.lit("5-LOW")))))
    return o.where(F.size("missing") > 0).select("o_custkey", F.array_join("missing", ",").alias("missing"))


@query("d12_pending_tasks", "SELECT doc_id AS task_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not done yet."""
    return ledger.pending(adapters.tasks(spark, sf_dir).select("task_id"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id")), ["task_id"])


@query("d13_episode_task_join", f"WITH {EV}, {EP} SELECT episode_id, c_name FROM ep JOIN customer ON c_custkey = user_id + 1")
def episode_task_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes with their tasks."""
    ep = adapters.episodes(adapters.events(spark, sf_dir))
    return ep.join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("user_id") + 1).select("episode_id", "c_name")


@query("d17_hash_stability", "SELECT false AS unchanged")
def hash_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of databases before and after."""
    h = X.content_hash(adapters.tasks(spark, sf_dir).select("db_id", F.sha2("question", 256).alias("f")), "db_id").withColumnRenamed("content_hash", "sha256")
    return audit.unchanged(h, h.withColumn("sha256", F.when(F.col("db_id") == "src3", "x").otherwise(F.col("sha256"))))


@query("e23_content_hash", """SELECT source, sha256(string_agg(p || h, ',' ORDER BY p || h)) AS content_hash FROM (SELECT source, f[1:4] AS p, sha256(string_agg(f, ',' ORDER BY f)) AS h
FROM (SELECT source, sha256(to_json({'doc_id': doc_id, 'lang': lang})) AS f FROM documents) GROUP BY ALL) GROUP BY source""")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash of rows whatever their order."""
    return X.content_hash(table(spark, sf_dir, "documents").select("source", X.fingerprint("doc_id", "lang").alias("f")), "source")


@query("e24_preflight_counts", f"WITH {EV}, {EP} SELECT split, complexity, terminal_reason, count(*) AS n FROM ep GROUP BY GROUPING SETS ((split), (complexity), (terminal_reason))")
def preflight_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by split, by class and by error."""
    cols = [F.col("split"), F.col("complexity"), F.col("terminal_reason")]
    return adapters.episodes(adapters.events(spark, sf_dir)).groupingSets([[c] for c in cols], *cols).agg(F.count("*").alias("n"))


@query("e27_unique_row_count", "SELECT count(*) AS row_count, count(DISTINCT (l_returnflag, l_linestatus, l_quantity)) AS unique_row_count FROM lineitem")
def unique_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E27."""
    return table(spark, sf_dir, "lineitem").agg(F.count("*").alias("row_count"), F.count_distinct(F.struct("l_returnflag", "l_linestatus", "l_quantity")).alias("unique_row_count"))


@query("g10_distinct_first_seen", "SELECT role, text, min(conv_id * 1000 + turn) AS first_at FROM conversations GROUP BY role, text")
def distinct_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows by their first place."""
    return adapters.messages(spark, sf_dir).groupBy("role", "text").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_at"))


@query("g11_chunks", "SELECT item_id // 8 AS chunk, count(*) AS n FROM benchmark GROUP BY 1")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of a fixed size."""
    return table(spark, sf_dir, "benchmark").groupBy(F.floor(F.col("item_id") / 8).alias("chunk")).agg(F.count("*").alias("n"))


@query(
    "audit_workload",
    "SELECT * FROM (VALUES ('t0', 'passed', true, 5::BIGINT), ('t1', 'missing_table_or_column', false, NULL), ('t2', 'passed', false, 0), ('t3', 'syntax_error', false, NULL), ('t4', 'passed', true, 25)) AS v(task_id, status, rl_clean, row_count)",
)
def audit_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit: each statement runs twice, and its record says whether it is clean."""
    from ..session import register

    register(spark, sf_dir, ("region", "nation"))
    sql = ("SELECT r_name FROM region", "SELECT nothing FROM region", "SELECT r_name FROM region WHERE r_regionkey < 0", "SELECT r_name FROM", "SELECT n_name, n_regionkey FROM nation")
    return audit.run(spark, [{"task_id": f"t{i}", "source_index": i, "db_id": "d", "sql": s} for i, s in enumerate(sql)], timeout=60).select("task_id", "status", "rl_clean", "row_count")
