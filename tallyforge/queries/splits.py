"""Splits and leakage, sampling, and scores of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection, metrics, sampling, split
from ..session import removed_later, shared_dir, stored, table
from ..sources import adapters
from . import EP, EV, query

#: The test tables' texts are composed, and the only letter whose folded form is longer than its lower case is the sharp s.
NORM = r"trim(regexp_replace(regexp_replace(replace(lower({t}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.tasks(spark, sf_dir)


def _dev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("question"))


@query("f9_seeded_order", "SELECT doc_id AS task_id, row_number() OVER (PARTITION BY source ORDER BY sha256(concat('42:', doc_id))) AS rank FROM documents")
def seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the seeded order of tasks in their group."""
    t = _tasks(spark, sf_dir).withColumn("split", F.lit("train")).withColumn("complexity", F.lit("simple"))
    return sampling.ordered_cells(t).select("task_id", "rank")


_VAL = """cnt AS (SELECT source AS db_id, count(*) AS n FROM documents GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY sha256('42:' || db_id)) AS place, sum(n) OVER (ORDER BY sha256('42:' || db_id)) AS running,
  sum(n) OVER () AS total, count(*) OVER () AS groups FROM cnt), best AS (SELECT place FROM o WHERE running >= 100 AND place < groups ORDER BY abs(running::DOUBLE / total - 0.10), place LIMIT 1),
  val AS (SELECT db_id, n, place FROM o WHERE place <= (SELECT place FROM best))"""


@query("f8_validation_groups", f"WITH {_VAL} SELECT * FROM val")
def validation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Databases of the validation set."""
    return split.validation_groups(split.group_counts(_tasks(spark, sf_dir)))


@query("d5_d6_split_counts", f"WITH {_VAL} SELECT CASE WHEN source IN (SELECT db_id FROM val) THEN 'validation' ELSE 'train' END AS split, count(*) AS n, count(DISTINCT source) AS dbs FROM documents GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks routed to their split."""
    t = _tasks(spark, sf_dir)
    return split.assign(t, split.validation_groups(split.group_counts(t))).groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("db_id").alias("dbs"))


@query(
    "d7_exact_overlap",
    f"""WITH d AS (SELECT doc_id, {NORM.format(t='text')} AS q, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'dev' END AS side FROM documents),
b AS (SELECT q, min(doc_id) FILTER (side = 'train') AS class_id FROM d WHERE q <> '' GROUP BY q HAVING count(DISTINCT side) = 2) SELECT side, doc_id AS task_id, class_id FROM d JOIN b USING (q)""",
)
def exact_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions in two halves of the tasks."""
    t = _tasks(spark, sf_dir)
    return split.exact_overlap(t.where("task_id % 2 = 0"), t.where("task_id % 2 = 1"))


@query("d8_simhash_bands")
def simhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bands that propose near pairs."""
    return split.simhash_bands(_tasks(spark, sf_dir))


@query("d8_near_pairs")
def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near questions in two halves of the tasks."""
    t = _tasks(spark, sf_dir)
    return split.near_pairs(t.where("task_id % 2 = 0"), t.where("task_id % 2 = 1"))


@query(
    "d8_near_members",
    f"WITH d AS (SELECT doc_id, {NORM.format(t='text')} AS q FROM documents) SELECT doc_id AS task_id, min(doc_id) OVER (PARTITION BY q) AS class_id FROM d WHERE q <> ''",
)
def near_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of equal questions whose representatives ``d8_near_pairs`` compares."""
    return split.members(_tasks(spark, sf_dir))


@query("d9_set_overlap_checks", "SELECT 'lang' AS name, count(*) AS shared FROM (SELECT lang FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT lang FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'task_id', 0")
def set_overlap_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that two halves share."""
    t = _tasks(spark, sf_dir)
    return split.overlaps(t.where("task_id % 2 = 0"), t.where("task_id % 2 = 1"), ["lang", "task_id"])


@query(
    "e12_largest_remainder",
    """WITH g AS (SELECT source AS key, sqrt(count(*)) AS weight FROM documents GROUP BY source), r AS (SELECT *, 137 * weight / sum(weight) OVER () AS raw FROM g),
b AS (SELECT *, floor(raw) AS base FROM r), p AS (SELECT *, 137 - sum(base) OVER () AS rest, row_number() OVER (ORDER BY base - raw, sha256('42:' || key)) AS place FROM b)
SELECT key, (base + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM p""",
)
def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole shares by weight."""
    g = split.group_counts(_tasks(spark, sf_dir)).select(F.lit("all").alias("by"), F.col("db_id").alias("key"), F.sqrt("n").alias("weight"), F.lit(137).cast("long").alias("total"))
    return sampling.whole_shares(g, "by", "key", "total", "weight").select("key", F.col("share").alias("quota"))


_CELL = "c AS (SELECT doc_id AS task_id, source AS db_id, CASE WHEN doc_id % 5 = 0 THEN 'validation' ELSE 'train' END AS split, ['simple', 'moderate', 'challenging'][doc_id % 3 + 1] AS complexity FROM documents)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.array(*[F.lit(c) for c in sampling.CLASSES])
    return _tasks(spark, sf_dir).select(
        "task_id", "db_id", F.when(F.col("task_id") % 5 == 0, "validation").otherwise("train").alias("split"), F.get(classes, (F.col("task_id") % 3).cast("int")).alias("complexity")
    )


@query("e22_bucket_counts", f"WITH {_CELL} SELECT split, db_id, complexity, count(*) AS candidates FROM c GROUP BY GROUPING SETS ((split), (split, complexity), (split, db_id, complexity))")
def bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by split, by class and by cell."""
    return sampling.cell_counts(_cells(spark, sf_dir))


@query(
    "e11_e13_quota_plan",
    f"""WITH {_CELL}, n AS (SELECT split, db_id, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT split, CASE split WHEN 'train' THEN 60 ELSE 20 END AS total FROM (SELECT DISTINCT split FROM n)),
s AS (SELECT n.*, (total - count(*) OVER w) * sqrt(n) / sum(sqrt(n)) OVER w AS raw, total - count(*) OVER w AS rest FROM n JOIN t USING (split) WINDOW w AS (PARTITION BY split)),
p AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY floor(raw) - raw, sha256('42:' || db_id)) AS place, rest - sum(floor(raw)) OVER (PARTITION BY split) AS short FROM s)
SELECT split, 'database' AS kind, db_id AS name, (1 + floor(raw) + (place <= short)::INT)::BIGINT AS target, true AS fits FROM p
UNION ALL SELECT split, 'class', unnest(['simple', 'moderate', 'challenging']), unnest([3 * total // 10, 5 * total // 10, 2 * total // 10])::BIGINT, true FROM t""",
)
def quota_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets' sums by database, which follow the root of its candidates, and by class; and whether no cell is over its candidates."""
    t = _cells(spark, sf_dir)
    p = spark.createDataFrame([(*k, n) for k, n in sampling.plan(t, {"train": 60, "validation": 20}).items()], "split string, db_id string, complexity string, target long")
    j = p.join(t.groupBy("split", "db_id", "complexity").agg(F.count("*").alias("n")), ["split", "db_id", "complexity"], "left")
    out = lambda kind, c: j.groupBy("split", F.col(c).alias("name")).agg(F.sum("target").alias("target"), F.bool_and(F.col("target") <= F.coalesce("n", F.lit(0))).alias("fits")).select("split", F.lit(kind).alias("kind"), "name", "target", "fits")
    return out("database", "db_id").unionByName(out("class", "complexity"))


_STATE = f"""{_CELL}, x AS (SELECT split, db_id, complexity, least(count(*), 2 + count(*) % 5)::BIGINT AS target, count(*) FILTER (task_id % 7 = 0) AS tried,
    count(*) FILTER (task_id % 14 = 0) AS accepted, count(*) FILTER (task_id % 7 <> 0) AS waiting FROM c GROUP BY split, db_id, complexity),
i AS (SELECT x.*, nth, (tried + nth) / target AS own, (accepted + nth - 1) / target AS held, sha256('42:' || split || ':' || db_id || ':' || complexity) AS tie
    FROM x, unnest(range(1, least(target - accepted, waiting) + 1)) AS u(nth)),
k AS (SELECT i.*, ((SELECT sum(tried) FROM x WHERE x.split = i.split AND x.complexity = i.complexity) + row_number() OVER (PARTITION BY split, complexity ORDER BY own, held, tie))
    / (SELECT sum(target) FROM x WHERE x.split = i.split AND x.complexity = i.complexity) AS of_class FROM i),
s AS (SELECT k.*, ((SELECT sum(tried) FROM x WHERE x.split = k.split) + row_number() OVER (PARTITION BY split ORDER BY of_class, own, held, tie))
    / (SELECT sum(target) FROM x WHERE x.split = k.split) AS of_split FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY of_split, of_class, own, held, tie) AS place FROM s),
w AS (SELECT *, row_number() OVER (PARTITION BY split, db_id, complexity ORDER BY sha256('42:' || task_id)) AS nth FROM c WHERE task_id % 7 <> 0)"""


@query("f13_schedule", f"WITH {_STATE} SELECT task_id, split, db_id, complexity, place FROM o JOIN w USING (split, db_id, complexity, nth)")
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tasks to try next and their order, where a seventh of the tasks has been tried and half of those were accepted."""
    t = _cells(spark, sf_dir)
    n = F.count("*")
    targets = t.groupBy(*sampling.CELL).agg(F.least(n, 2 + n % 5).alias("target"))
    log = t.where("task_id % 7 = 0").select("task_id", (F.col("task_id") % 14 == 0).alias("accepted"))
    return sampling.handed_out(t, targets, log)


@query(
    "h3_collection",
    f"""WITH {_CELL}, x AS (SELECT split, db_id, complexity, least(count(*), 2 + count(*) % 5)::BIGINT AS target FROM c GROUP BY ALL),
o AS (SELECT task_id, target, task_id % 3 <> 0 AS accepted, coalesce(sum((task_id % 3 <> 0)::INT) OVER (PARTITION BY split, db_id, complexity ORDER BY sha256('42:' || task_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM c JOIN x USING (split, db_id, complexity)) SELECT task_id, accepted FROM o WHERE before < target""",
)
def collected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2, H3: what a collection has tried when all its cells are filled or used up; it is broken off after a round, once between results and commit, and gone on with."""
    t = _cells(spark, sf_dir)
    n = F.count("*")
    targets = stored(t.groupBy(*sampling.CELL).agg(F.least(n, 2 + n % 5).alias("target")))
    per_round = 1 + targets.agg(F.sum("target")).first()[0] // 2
    attempt = lambda due: due.select("task_id", (F.col("task_id") % 3 != 0).alias("accepted"))
    base = f"{shared_dir(spark)}/collection-{uuid.uuid4().hex}"
    removed_later(spark, base)
    of = lambda: collection.Collection(spark, base, t, targets, attempt, per_round, config_hash="c", label="first", ahead=True)
    of().run(1)
    attempt(sampling.handed_out(t, targets, of().log().select("task_id", "accepted"), per_round)).write.parquet(f"{base}/open-lost")  # died before its commit
    of().run()
    return of().log().select("task_id", "accepted")


@query(
    "f14_reallocation",
    f"""WITH RECURSIVE {_CELL}, x AS (SELECT split, db_id, complexity, 5 + count(*) % 4 AS target, CASE WHEN count(*) % 3 = 0 THEN 2 ELSE 6 + count(*) % 5 END AS reach FROM c GROUP BY ALL),
n AS (SELECT *, row_number() OVER (ORDER BY split, db_id, complexity) AS cell, dense_rank() OVER (ORDER BY split, db_id) AS db, sha256('42:' || split || ':' || db_id || ':' || complexity) AS tie FROM x),
f AS (SELECT db, sum(target) AS first, greatest(1, sum(target) - greatest(1, ceil(sum(target) * 0.2))) AS low, greatest(1, sum(target) + greatest(1, ceil(sum(target) * 0.2))) AS high FROM n GROUP BY db),
p AS (SELECT list(split || complexity ORDER BY cell) AS class, list(db ORDER BY cell) AS dbs, list(reach ORDER BY cell) AS reach, list(tie ORDER BY cell) AS tie, list(target ORDER BY cell) AS target,
    (SELECT list(first ORDER BY db) FROM f) AS first, (SELECT list(low ORDER BY db) FROM f) AS low, (SELECT list(high ORDER BY db) FROM f) AS high FROM n),
l AS (SELECT cell, row_number() OVER (ORDER BY cell, u.i) AS i FROM n, unnest(range(1, target - reach + 1)) AS u(i)),
w AS (SELECT 0::BIGINT AS i, target AS out, first AS now FROM p UNION ALL
    SELECT i, CASE WHEN goes IS NULL THEN out ELSE list_transform(out, lambda v, j: v + (j = goes)::INT - (j = cell)::INT) END, CASE WHEN goes IS NULL THEN now ELSE list_transform(now, lambda v, j: v + (j = dbs[goes])::INT - (j = dbs[cell])::INT) END
    FROM (SELECT l.i, l.cell, w.out, w.now, p.dbs, CASE WHEN w.now[p.dbs[l.cell]] <= p.low[p.dbs[l.cell]] THEN NULL ELSE list_min(list_transform(list_filter(range(1, len(p.dbs) + 1),
        lambda j: p.class[j] = p.class[l.cell] AND p.dbs[j] <> p.dbs[l.cell] AND p.reach[j] > w.out[j] AND w.now[p.dbs[j]] < p.high[p.dbs[j]]), lambda j: {{'r': w.now[p.dbs[j]] / greatest(1, p.first[p.dbs[j]]), 't': p.tie[j], 'j': j}})).j END AS goes
        FROM w JOIN l ON l.i = w.i + 1, p))
SELECT split, db_id, complexity, out[cell]::BIGINT AS target FROM n, (SELECT out FROM w ORDER BY i DESC LIMIT 1)""",
)
def reallocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what cells cannot reach of their targets goes to other databases of their class, within a fifth of each database's target."""
    n = F.count("*")
    x = _cells(spark, sf_dir).groupBy(*sampling.CELL).agg((5 + n % 4).alias("target"), F.when(n % 3 == 0, 2).otherwise(6 + n % 5).alias("reach")).collect()  # a row for each cell
    out, _ = sampling.reallocated({tuple(r[:3]): r.target for r in x}, {tuple(r[:3]): r.reach for r in x})
    return spark.createDataFrame([(*k, v) for k, v in out.items()], "split string, db_id string, complexity string, target long")


def _hashed(name: str, rows: str) -> str:
    return f"""SELECT '{name}' AS name, sha256(string_agg(p || h, ',' ORDER BY p || h)) AS content_hash FROM (SELECT f[1:4] AS p, sha256(string_agg(f, ',' ORDER BY f)) AS h
FROM (SELECT sha256(to_json({{'complexity': complexity, 'db_id': db_id, 'split': split, 'task_id': task_id}})) AS f FROM ({rows})) GROUP BY 1)"""


@query(
    "e22_plan_hash_order",
    f"WITH {_CELL} " + " UNION ALL ".join(_hashed(n, r) for n, r in (("as it is", "SELECT * FROM c"), ("reversed", "SELECT * FROM c"), ("changed", "SELECT * REPLACE (CASE WHEN task_id = 7 THEN 'other' ELSE complexity END AS complexity) FROM c"))),
)
def plan_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a plan's candidates, in order, in another order, and with one row changed."""
    t = _cells(spark, sf_dir)
    cases = (("as it is", t), ("reversed", t.orderBy(F.desc("task_id"))), ("changed", t.withColumn("complexity", F.when(F.col("task_id") == 7, "other").otherwise(F.col("complexity")))))
    out = None
    for name, rows in cases:
        one = sampling.candidate_hash(rows).select(F.lit(name).alias("name"), "content_hash")
        out = one if out is None else out.unionByName(one)
    return out


# Result pairs: every customer's orders, against the same with some values changed; a quarter of the customers has no prediction.
_GOLD = "g AS (SELECT o_custkey AS pair_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderstatus AS a, o_orderpriority AS b FROM orders)"
_PRED = "p AS (SELECT o_custkey AS pair_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS a, o_orderpriority AS b FROM orders WHERE o_custkey % 4 <> 1)"


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    base = o.select(F.col("o_custkey").alias("pair_id"), F.row_number().over(w).alias("position"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    gold = base.select("pair_id", "position", F.array("o_orderstatus", "o_orderpriority").alias("row"))
    pred = base.where("pair_id % 4 <> 1").select("pair_id", "position", F.array(F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")), "o_orderpriority").alias("row"))
    return pred, gold, base.select("pair_id").distinct()


@query(
    "e18_execution_match",
    f"""WITH {_GOLD}, {_PRED}, odd AS (SELECT DISTINCT pair_id FROM ((SELECT pair_id, a, b FROM g EXCEPT SELECT pair_id, a, b FROM p) UNION ALL (SELECT pair_id, a, b FROM p EXCEPT SELECT pair_id, a, b FROM g)))
SELECT DISTINCT g.pair_id, CASE WHEN odd.pair_id IS NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS ex FROM g LEFT JOIN odd USING (pair_id)""",
)
def execution_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E18."""
    return metrics.execution_match(*_results(spark, sf_dir))


_SOFT = f"""{_GOLD}, {_PRED}, gd AS (SELECT pair_id, [a, b] AS r, row_number() OVER (PARTITION BY pair_id ORDER BY min(position)) AS at FROM g GROUP BY pair_id, a, b),
pd AS (SELECT pair_id, [a, b] AS r, row_number() OVER (PARTITION BY pair_id ORDER BY min(position)) AS at FROM p GROUP BY pair_id, a, b),
j AS (SELECT coalesce(gd.pair_id, pd.pair_id) AS pair_id, gd.r AS g, pd.r AS p FROM gd FULL JOIN pd ON gd.pair_id = pd.pair_id AND gd.at = pd.at),
s AS (SELECT pair_id, sum(CASE WHEN p IS NULL OR g IS NULL THEN 0 ELSE len(list_filter(p, lambda v: list_contains(g, v))) / 2 END) AS tp, sum(CASE WHEN g IS NULL THEN 1 WHEN p IS NULL THEN 0 ELSE len(list_filter(p, lambda v: NOT list_contains(g, v))) / 2 END) AS fp,
  sum(CASE WHEN p IS NULL THEN 1 WHEN g IS NULL THEN 0 ELSE len(list_filter(g, lambda v: NOT list_contains(p, v))) / 2 END) AS fn FROM j GROUP BY pair_id),
q AS (SELECT pair_id, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS re FROM s)"""


@query("e16_soft_f1", f"WITH {_SOFT} SELECT pair_id, round(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 9)::DOUBLE AS soft_f1 FROM q")
def soft_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E16."""
    return metrics.soft_f1(*_results(spark, sf_dir)).withColumn("soft_f1", F.round("soft_f1", 9))


@query(
    "e17_relative_efficiency",
    """WITH t AS (SELECT user_id AS pair_id, value / 50.0 AS ratio FROM events), m AS (SELECT *, avg(ratio) OVER w AS m, stddev_pop(ratio) OVER w AS s FROM t WINDOW w AS (PARTITION BY pair_id)),
c AS (SELECT *, s = 0 OR (ratio > m - 3 * s AND ratio < m + 3 * s) AS fits FROM m), k AS (SELECT * FROM (SELECT *, bool_or(fits) OVER (PARTITION BY pair_id) AS anyfit FROM c) WHERE fits OR NOT anyfit), a AS (SELECT pair_id, avg(ratio) AS r FROM k GROUP BY pair_id)
SELECT pair_id, round(sqrt(CASE WHEN r <= 0 THEN 0 WHEN r >= 2 THEN 1.25 WHEN r >= 1 THEN 1 WHEN r >= 0.5 THEN 0.75 WHEN r >= 0.25 THEN 0.5 ELSE 0.25 END) * 100, 6) AS r_ves FROM a""",
)
def relative_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outliers go, then the stepwise reward of the mean."""
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("pair_id"), (F.col("value") / 50.0).alias("ratio"))
    return metrics.efficiency(t).withColumn("r_ves", F.round("r_ves", 6))


_REC = f"{EV}, {EP}, rec AS (SELECT episode_id, CASE WHEN n_events % 5 = 0 THEN NULL ELSE (tokens % 2)::DOUBLE END AS ex, tokens / 200.0 AS soft_f1, CASE WHEN tokens % 3 = 0 THEN NULL ELSE tokens * 1.0 END AS r_ves FROM ep)"


@query(
    "e3_summary_means",
    f"""WITH {_REC} SELECT count(*) AS official_n, count(ex) AS final_n, count(*) - count(ex) AS excluded, round(avg(ex), 6) AS ex, round(avg(soft_f1) FILTER (ex IS NOT NULL), 6) AS soft_f1, round(avg(r_ves) FILTER (ex IS NOT NULL), 6) AS r_ves FROM rec""",
)
def summary_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over what is scored."""
    t = F.col("tokens")
    r = adapters.episodes(adapters.events(spark, sf_dir)).select(
        F.when(F.col("n_events") % 5 != 0, (t % 2).cast("double")).alias("ex"), (t / 200.0).alias("soft_f1"), F.when(t % 3 != 0, t * 1.0).alias("r_ves")
    )
    return metrics.summarize(r)


