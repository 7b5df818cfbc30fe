"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import report
from ..session import table
from . import query


@query("fn_seeded_hash", "SELECT doc_id, sha256(concat('42:', doc_id)) AS h FROM documents")
def seeded_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of seeded orders."""
    return table(spark, sf_dir, "documents").select("doc_id", X.seeded(F.col("doc_id")).alias("h"))


@query("fn_normalized_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents")
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions in the form in which they are compared."""
    return table(spark, sf_dir, "documents").select("doc_id", X.normalized(F.col("text")).alias("t"))


@query(
    "fn_word_shingles",
    r"""WITH w AS (SELECT doc_id, list_filter(string_split(trim(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, array_to_string(CASE WHEN len(w) < 3 THEN w ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END, '|') AS shingles FROM w""",
)
def word_shingles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word 3-grams."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(X.features(X.normalized(F.col("text"))), "|").alias("shingles"))


@query("fn_buckets", "SELECT event_id, CASE WHEN value * 3000000 < 10485760 THEN 'small_lt_10_mib' WHEN value * 3000000 < 104857600 THEN 'medium_lt_100_mib' ELSE 'large_ge_100_mib' END AS size_class, CASE WHEN event_id % 6 <= 1 THEN 'simple' WHEN event_id % 6 <= 3 THEN 'moderate' ELSE 'challenging' END AS class, CASE WHEN value / 40 <= 0 THEN 0 WHEN value / 40 >= 2 THEN 1.25 WHEN value / 40 >= 1 THEN 1 WHEN value / 40 >= 0.5 THEN 0.75 WHEN value / 40 >= 0.25 THEN 0.5 ELSE 0.25 END::DOUBLE AS reward FROM events")
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of sizes, scores and ratios."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", X.size_class(v * 3000000).alias("size_class"), X.complexity_class(F.col("event_id") % 6).alias("class"), X.ratio_reward(v / 40).alias("reward"))


@query("fn_cost", "SELECT event_id, round((CAST(json_extract_string(props, '$.k') AS BIGINT) * 0.8 + 100 * 2.5) / 1000000, 9) AS cost_usd FROM events")
def cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of tokens."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", F.round(X.cost(k, F.lit(100), 0.8, 2.5), 9).alias("cost_usd"))


@query("fn_map_merge_add", "SELECT event_type, 'k=' || sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) || ',n=' || count(*) AS usage FROM events GROUP BY event_type")
def map_merge_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps added key by key: halves first, then both."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events")
    half = lambda df, name: df.groupBy("event_type").agg(F.create_map(F.lit("k"), F.sum(k), F.lit("n"), F.count("*")).alias(name))
    both = half(e.where("event_id % 2 = 0"), "a").join(half(e.where("event_id % 2 = 1"), "b"), "event_type", "full")
    none = F.create_map().cast("map<string,bigint>")
    m = X.add_maps(F.coalesce("a", none), F.coalesce("b", none))
    return both.select("event_type", F.concat(F.lit("k="), m["k"].cast("string"), F.lit(",n="), m["n"].cast("string")).alias("usage"))


@query("fn_format", "SELECT item_id, 'train_' || lpad(item_id::VARCHAR, 6, '0') AS name, printf('%.2f%%', 100.0 * item_id / 7) AS share FROM benchmark")
def formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded ids and percentages."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.format_string("train_%06d", "item_id").alias("name"), F.format_string("%.2f%%", 100.0 * F.col("item_id") / 7).alias("share"))


@query("fn_result_canonical_row", """SELECT n_nationkey, '[["int","' || n_nationkey || '"],["str",' || to_json(n_name) || ']]' AS row FROM nation""")
def canonical_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: rows as JSON of tagged values."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return n.select("n_nationkey", X.canonical_row(n.dtypes, [F.col("n_nationkey"), F.col("n_name")]).alias("row"))


_RUNS = """r AS (SELECT label, event_id AS task_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE ['simple', 'moderate', 'challenging'][event_id % 3 + 1] END AS complexity,
  ((event_id + m) % 4 <> 0)::INT::DOUBLE AS ex, ((event_id * m) % 10) / 10.0 AS soft_f1, CASE WHEN event_id % 6 = 0 THEN NULL ELSE (event_id % 100 + m)::DOUBLE END AS r_ves,
  CASE WHEN event_type = 'error' AND (event_id + m) % 2 = 0 THEN 'syntax' END AS error_type FROM events, (VALUES ('base', 1), ('sft', 2), ('grpo', 3)) AS v(label, m))"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over the same tasks."""
    i = F.col("event_id")
    level = F.when(i % 7 != 0, F.get(F.array(F.lit("simple"), F.lit("moderate"), F.lit("challenging")), (i % 3).cast("int")))
    e = table(spark, sf_dir, "events").withColumn("x", F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(m).alias("m")) for n, m in (("base", 1), ("sft", 2), ("grpo", 3))])))
    e = e.withColumn("label", F.col("x.label")).withColumn("m", F.col("x.m"))
    m = F.col("m")
    return e.select(
        "label", i.alias("task_id"), level.alias("complexity"), ((i + m) % 4 != 0).cast("double").alias("ex"), ((i * m) % 10 / 10.0).alias("soft_f1"),
        F.when(i % 6 != 0, (i % 100 + m).cast("double")).alias("r_ves"), F.when((F.col("event_type") == "error") & ((i + m) % 2 == 0), "syntax").alias("error_type"),
    )


@query(
    "b16_comparison",
    f"""WITH {_RUNS}, g AS (SELECT label, NULL AS complexity, count(*) AS tasks, count(ex) AS scored, round(avg(ex), 6) AS ex, round(avg(soft_f1), 6) AS soft_f1, round(avg(r_ves), 6) AS r_ves FROM r GROUP BY label
UNION ALL SELECT label, coalesce(complexity, 'unknown'), count(*), count(ex), round(avg(ex), 6), round(avg(soft_f1), 6), round(avg(r_ves), 6) FROM r GROUP BY label, complexity)
SELECT g.*, round(g.ex - b.ex, 6) AS delta_ex FROM g LEFT JOIN g b ON b.label = 'base' AND b.complexity IS NOT DISTINCT FROM g.complexity""",
)
def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as a whole and by difficulty, against the first."""
    return report.by_run(_runs(spark, sf_dir))


@query("b16_errors", f"WITH {_RUNS} SELECT label, error_type, count(*) AS tasks FROM r WHERE error_type IS NOT NULL GROUP BY ALL")
def run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of runs by kind."""
    return report.error_counts(_runs(spark, sf_dir))


@query("b16_reports")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown reports, from aggregated rows."""
    r = _runs(spark, sf_dir)
    return spark.createDataFrame([("run", report.run_report(r.where("label = 'base'"), "base")), ("compare", report.compare_report(r))], "report string, markdown string")


@query("b17_tokenizer", r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> ''))::INTEGER AS n FROM conversations")
def tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer behind a column function, in Arrow batches."""
    from ..operators.training import tokenizer as make

    def encode(text: str) -> list[int]:
        return [len(w) for w in text.split()]

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(make(encode)(F.col("text"))).alias("n"))
