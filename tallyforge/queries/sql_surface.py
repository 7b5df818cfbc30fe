"""Layer A: guarded SQL over the tables. The same text runs on both engines where their dialects agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import execute, guard, shapes
from ..session import register, settings, stored, table
from ..sources import catalog
from . import query

TEXTS = {
    "a_scan_filter": ("lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03"),
    "a_equi_join_agg": (
        "customer orders lineitem",
        "SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer "
        "JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' GROUP BY c_mktsegment",
    ),
    "a_left_join": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey"),
    "a_full_join": ("customer supplier", "SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50"),
    "a_cross_small": ("region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey < n_regionkey"),
    "a_theta_join": ("part", "SELECT a.p_partkey AS small, b.p_partkey AS large FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_retailprice < b.p_retailprice AND b.p_retailprice < a.p_retailprice + 5"),
    "a_semi_join": ("orders lineitem", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"),
    "a_anti_join": ("customer orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "a_in_subquery": ("supplier nation", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)"),
    "a_correlated_scalar": ("lineitem", "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)"),
    "a_group_having": ("orders", "SELECT o_custkey, count(*) AS n, round(max(o_totalprice), 2) AS most FROM orders GROUP BY o_custkey HAVING count(*) > 12"),
    "a_order_limit": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"),
    "a_union": ("customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "a_union_all": ("customer supplier", "SELECT c_nationkey AS k, c_acctbal AS b FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier"),
    "a_intersect": ("orders lineitem", "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_quantity > 40"),
    "a_except": ("orders lineitem", "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_quantity > 10"),
    "a_window_rank": (
        "orders",
        "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, "
        "CAST(rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS BIGINT) AS rk FROM orders",
    ),
    "a_window_running": ("events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events"),
    "a_cte": ("lineitem supplier", "WITH revenue AS (SELECT l_suppkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY l_suppkey) SELECT s_suppkey, s_name, round(total, 2) AS total FROM supplier JOIN revenue ON s_suppkey = l_suppkey"),
    "a_recursive_cte": (
        "part",
        "WITH RECURSIVE tree(k, size, depth) AS (SELECT p_partkey, CAST(p_size AS BIGINT), 1 FROM part WHERE p_partkey = 1 UNION ALL "
        "SELECT p.p_partkey, t.size + p.p_size, t.depth + 1 FROM tree t JOIN part p ON CAST(floor(p.p_partkey / 2) AS BIGINT) = t.k WHERE p.p_partkey > 1) SELECT k, size, depth FROM tree",
    ),
    "a_nested_select": ("orders", "SELECT o_orderpriority, n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority) x WHERE n > 10"),
    "a_distinct": ("lineitem", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem"),
    "a_case_functions": ("part", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS class, upper(substring(p_name, 1, 3)) AS head, CAST(length(p_type) AS BIGINT) AS n, CAST(instr(p_type, 'STEEL') AS BIGINT) AS place FROM part"),
    "a_aggregates": (
        "lineitem",
        "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_discount) AS low, max(l_tax) AS high, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
}


#: Prices in steps of a power of two are exact, and two prices of the join are less than a step apart, so they meet in the step of the smaller price or the one above. Prices
#: beyond 1e15, where a step is no longer exact, share one.
_STEP = "CAST(floor(least(greatest(p_retailprice, -1e15D), 1e15D) / 8D) AS BIGINT)"


def _theta_join(spark: SparkSession, sql: str) -> DataFrame:
    """The statement of ``a_theta_join`` with a step of the price as one more key: only rows of neighbouring steps are compared, and both sides are dealt over as many
    tasks as the session has shuffle partitions, which are not put together, since the output is larger than what is read."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = lambda step: f"(SELECT /*+ REPARTITION({parts}, p_brand, p_size, step) */ p_partkey, p_brand, p_size, p_retailprice, step FROM (SELECT *, {step} AS step FROM part))"
    near = sql.replace("FROM part a JOIN part b ON ", f"FROM {rows(f'explode(array({_STEP}, {_STEP} + 1))')} a JOIN {rows(_STEP)} b ON a.step = b.step AND ")
    return spark.sql(near.replace("SELECT a.p_partkey", "SELECT /*+ SHUFFLE_HASH(b) */ a.p_partkey", 1))


def _text(name: str, tables: str, sql: str) -> None:
    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tuple(tables.split()))
        guard.validate(spark, sql)
        if name == "a_theta_join":
            return _theta_join(spark, sql)
        if not sql.startswith("WITH RECURSIVE"):
            return spark.sql(sql)
        with settings(spark, **{"spark.sql.cteRecursionRowLimit": "-1"}):  # a recursion over a table has as many rows as the table; the limit is read when it runs
            return stored(spark.sql(sql))


for _name, (_tables, _sql) in TEXTS.items():
    _text(_name, _tables, _sql)

#: (statement, status) that the guard and the engine must give.
CASES = (
    ("SELECT r_name FROM region", "passed"),
    ("WITH x AS (SELECT 1 AS a) SELECT a FROM x", "passed"),
    ("SELECT FROM", "syntax_error"),
    ("SELECT r_name FROM region WHERE", "syntax_error"),
    ("SELECT missing FROM region", "missing_table_or_column"),
    ("SELECT 1 FROM no_such_table", "missing_table_or_column"),
    ("SELECT made_up_function(r_name) FROM region", "unsupported_function"),
    ("DELETE FROM region", "unsafe_sql"),
    ("PRAGMA table_info(region)", "unsafe_sql"),
    ("ATTACH 'x' AS y", "unsafe_sql"),
    ("SELECT 1; SELECT 2", "unsafe_sql"),
    ("SELECT 1; DROP TABLE region", "unsafe_sql"),
    ("CREATE TABLE z (a INT)", "unsafe_sql"),
    ("WITH x AS (SELECT 1) DELETE FROM region", "unsafe_sql"),
    ("SELECT java_method('java.lang.System', 'gc')", "unsafe_sql"),
    ("", "unsafe_sql"),
)
_quote = lambda s: "'" + s.replace("'", "''") + "'"


@query("a1_a7_guard_and_status", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_quote(s)}, {_quote(st)})" for i, (s, st) in enumerate(CASES)) + ") AS v(n, statement, status)")
def guard_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the guard refuses, and the status of what fails."""
    register(spark, sf_dir, ("region",))
    rows = [(i, s, execute.run_sql(spark, s, timeout=60).status) for i, (s, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "n long, statement string, status string")


DIGESTED = "SELECT o_orderpriority, o_custkey FROM orders GROUP BY o_orderpriority, o_custkey"


@query(
    "a3_a6_result_digest",
    f"""WITH r AS (SELECT DISTINCT concat('[["str",', to_json(o_orderpriority), '],["int","', o_custkey, '"]]') AS row FROM ({DIGESTED})),
f AS (SELECT list(encode(row) ORDER BY encode(row)) AS l FROM r)
SELECT (SELECT count(*) FROM ({DIGESTED})) AS row_count, len(l)::BIGINT AS unique_row_count, (SELECT count(*) FROM ({DIGESTED})) > 100000 AS result_too_large,
  sha256(list_reduce(list_transform(l, lambda x: unhex(lpad(to_hex(octet_length(x)), 16, '0')) || x), lambda a, b: a || b)) AS digest FROM f""",
)
def result_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set digest of a whole result, made by the executors, and whether ``run_sql`` would stop before its end."""
    register(spark, sf_dir, ("orders",))
    got = execute.digest_of(execute.canonical(spark.sql(DIGESTED)))
    return got.select("row_count", "unique_row_count", (F.col("row_count") > execute.MAX_ROWS).alias("result_too_large"), "digest")


_LANES = ", ".join(f"sum(('0x' || h[{16 * i + 1}:{16 * i + 16}])::UBIGINT) AS s{i}" for i in range(4))


def _multiset(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS name, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS digest, n AS row_count FROM (SELECT count(*) AS n, {_LANES} FROM (SELECT sha256(row) AS h FROM ({rows})))"


_LINE_ROWS = """SELECT concat('[["int","', l_orderkey, '"],["int","', l_linenumber % 3, '"],["str",', to_json(l_returnflag), ']]') AS row FROM lineitem"""


@query("a6_multiset_digest", f"{_multiset('all', _LINE_ROWS)} UNION ALL {_multiset('distinct', _LINE_ROWS.replace('SELECT', 'SELECT DISTINCT', 1))} UNION ALL {_multiset('less one', _LINE_ROWS + ' WHERE NOT (l_orderkey = 1 AND l_linenumber = 1)')}")
def multiset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of a large result whose rows are summed where they lie: all rows, as a set, and without one row."""
    rows = table(spark, sf_dir, "lineitem")
    of = lambda d: execute.canonical(d.select("l_orderkey", (F.col("l_linenumber") % 3).alias("n"), "l_returnflag"))
    named = lambda name, d: d.select(F.lit(name).alias("name"), "digest", "row_count")
    out = named("all", execute.multiset_digest(of(rows))).unionByName(named("distinct", execute.multiset_digest(of(rows), distinct=True)))
    return out.unionByName(named("less one", execute.multiset_digest(of(rows.where("NOT (l_orderkey = 1 AND l_linenumber = 1)")))))


@query("a4_a9_rows_and_caps", "SELECT * FROM (VALUES ('all', 25::BIGINT, false, 'passed'), ('ten', 11::BIGINT, true, 'passed'), ('bytes', 2::BIGINT, true, 'passed')) AS v(cap, row_count, result_too_large, status)")
def rows_and_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order, and what the caps do; the row that breaks a cap counts."""
    register(spark, sf_dir, ("nation",))
    sql = "SELECT n_nationkey FROM nation ORDER BY n_nationkey"
    got = {"all": execute.run_sql(spark, sql, 60, keep_rows=True), "ten": execute.run_sql(spark, sql, 60, max_rows=10), "bytes": execute.run_sql(spark, sql, 60, max_bytes=20)}
    return spark.createDataFrame([(k, e.row_count, e.result_too_large, e.status) for k, e in got.items()], "cap string, row_count long, result_too_large boolean, status string")


@query("a8_timeout", "SELECT 'timeout' AS status")
def timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A statement over its time is cancelled."""
    register(spark, sf_dir, ("lineitem",))
    sql = "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_quantity < b.l_quantity + a.l_tax JOIN lineitem c ON b.l_tax < c.l_quantity"
    return spark.createDataFrame([(execute.run_sql(spark, sql, timeout=0.5).status,)], "status string")


def _judged(spark: SparkSession, sf_dir: str, cases: tuple, judge, result: str, n: int = 1, more: int = 0) -> DataFrame:
    """(s_suppkey, ``result``) of every supplier: ``judge`` of the first ``n`` texts of its key's case and ``more`` values after them. The statements are made from the table's keys."""
    names = [f"c{i}" for i in range(n + more)]
    case = F.get(F.array(*[F.struct(*[F.lit(c[i]).alias(x) for i, x in enumerate(names)]) for c in cases]), F.pmod("s_suppkey", F.lit(len(cases))).cast("int"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", case.alias("c")).select("s_suppkey", "c.*")
    with_key = lambda x: F.replace(F.replace(x, F.lit("{k}"), F.col("s_suppkey").cast("string")), F.lit("{l}"), (F.col("s_suppkey") + 1).cast("string"))
    rows = rows.select("s_suppkey", *[with_key(F.col(x)).alias(x) for x in names])
    return shapes.judged(rows, names[:n], judge, result, tuple(names[n:]))


def _cases(cases: tuple, *places: tuple[int, str]) -> str:
    """SQL for what the cases of suppliers' keys say at these places."""
    lit = lambda x: _quote(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}::BIGINT"
    return ", ".join(f"CASE s_suppkey % {len(cases)} " + " ".join(f"WHEN {i} THEN {lit(c[p])}" for i, c in enumerate(cases)) + f" END AS {name}" for p, name in places)


NORMAL = (
    ("SELECT  s_name\nFROM supplier WHERE s_suppkey = {k};", "select S_NAME from Supplier where s_suppkey={k}", True),
    ("SELECT s_name FROM supplier WHERE s_suppkey = {k}", "SELECT s_name FROM supplier WHERE s_suppkey = {l}", False),
    ("SELECT s_name FROM supplier WHERE s_suppkey < {k} -- note", "select `s_name` from supplier where s_suppkey<{k}", True),
    ("SELECT 'A{k}' AS x FROM supplier", "SELECT 'a{k}' AS x FROM supplier", False),
)


@query("a10_normalised_sql", f"SELECT s_suppkey, {_cases(NORMAL, (2, 'same'))} FROM supplier")
def normalised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: which two statements about a supplier are the same after normalisation."""
    return _judged(spark, sf_dir, NORMAL, lambda a, b: (guard.normalize(spark, a) == guard.normalize(spark, b),), "same boolean", 2)


PHYSICAL = (
    ("WITH x AS (SELECT * FROM Orders WHERE o_orderkey > {k}) SELECT * FROM x JOIN customer c ON c.c_custkey = x.o_custkey", "customer,orders"),
    ("SELECT {k} FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)", "nation,region"),
    ("SELECT {k}", ""),
    ("SELECT s_name FROM supplier s WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s.s_nationkey) AND s_suppkey = {k} UNION SELECT c_name FROM customer", "customer,nation,supplier"),
)


@query("a11_physical_tables", f"SELECT s_suppkey, {_cases(PHYSICAL, (1, 'tables'))} FROM supplier")
def physical_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of a statement without its own names, for a statement about each supplier."""
    return _judged(spark, sf_dir, PHYSICAL, lambda a: (",".join(sorted(guard.physical_tables(spark, a))),), "tables string")


@query("b9_catalog_scan", "SELECT table_name, count(*) AS n_columns FROM information_schema.columns WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem') GROUP BY table_name")
def catalog_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the catalog."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    register(spark, sf_dir, names)
    return catalog.columns(spark, [n for n in catalog.tables(spark) if n in names]).groupBy("table_name").agg(F.count("*").alias("n_columns"))


@query(
    "b10_schema_scan",
    """SELECT table_name, (ordinal_position - 1)::BIGINT AS position, column_name, CASE WHEN data_type IN ('INTEGER', 'BIGINT') THEN 'integer' WHEN data_type = 'DOUBLE' THEN 'real'
  WHEN data_type LIKE 'TIMESTAMP%' THEN 'time' WHEN data_type = 'VARCHAR' THEN 'text' ELSE 'nested' END AS kind
FROM information_schema.columns WHERE table_name IN ('customer', 'orders', 'embeddings')""",
)
def schema_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of tables."""
    register(spark, sf_dir, ("customer", "orders", "embeddings"))
    return catalog.columns(spark, ["customer", "orders", "embeddings"])


KEYED = {t: [f"{p}{c}" for c in cs] for t, p, cs in (
    ("region", "r_", ["regionkey"]), ("nation", "n_", ["nationkey", "regionkey"]), ("supplier", "s_", ["suppkey", "nationkey"]), ("customer", "c_", ["custkey", "nationkey"]),
    ("part", "p_", ["partkey", "size"]), ("orders", "o_", ["orderkey", "custkey"]), ("lineitem", "l_", ["orderkey", "partkey", "suppkey", "linenumber"]),
)}
_VALUES = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {c}::BIGINT AS v FROM {t}" for t, cs in KEYED.items() for c in cs)


@query(
    "b10_keys",
    f"""WITH v AS (SELECT t, c, v, count(*) AS n FROM ({_VALUES}) WHERE v IS NOT NULL GROUP BY ALL), s AS (SELECT t, c, count(*) AS many, max(n) = 1 AS once FROM v GROUP BY ALL),
u AS (SELECT v.*, once FROM v JOIN s USING (t, c)),
i AS (SELECT a.t, a.c, b.t AS rt, b.c AS rc, count(*) AS shared FROM u a JOIN u b ON a.v = b.v AND a.t <> b.t AND b.once GROUP BY ALL)
SELECT t AS table_name, c AS column_name, 'unique' AS kind, NULL AS referenced FROM s WHERE once UNION ALL SELECT i.t, i.c, 'included', rt || '.' || rc FROM i JOIN s ON s.t = i.t AND s.c = i.c WHERE shared = many""",
)
def key_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that are unique, and those whose values all occur in a unique column of another table."""
    return catalog.keys({t: table(spark, sf_dir, t).select(*cs) for t, cs in KEYED.items()})


@query("b_search_values", "SELECT DISTINCT p_name FROM part WHERE instr(CAST(p_name AS VARCHAR), 'ring') > 0 ORDER BY p_name LIMIT 20")
def search_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tool that searches a column's values."""
    return catalog.search_values(table(spark, sf_dir, "part"), "p_name", "ring", 20)


COMPLEX = (
    ("SELECT r_name FROM region", 0, "simple"),
    ("SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey", 2, "moderate"),
    ("SELECT r_name FROM region UNION SELECT n_name FROM nation", 4, "challenging"),
    ("WITH x AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS n FROM region) SELECT r_name FROM x WHERE n = {k}", 5, "challenging"),
    ("SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey HAVING count(*) > {k}", 3, "moderate"),
)


@query("fn_sql_complexity", f"SELECT s_suppkey, {_cases(COMPLEX, (1, 'score'), (2, 'class'))} FROM supplier")
def sql_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of statements about suppliers, from their plans."""
    return _judged(spark, sf_dir, COMPLEX, lambda a: tuple(guard.complexity(spark, a)), "score long, class string")


#: Prediction, gold, status of the prediction (empty: none), label.
TAXONOMY = (
    ("SELECT b FROM t WHERE k = {k}", "SELECT a FROM t WHERE k = {k}", "", "schema_linking"),
    ("SELECT a FROM t WHERE a = {k}", "SELECT a FROM t WHERE a = {l}", "", "filter_value"),
    ("SELECT COUNT(a) FROM t WHERE k = {k}", "SELECT SUM(a) FROM t WHERE k = {k}", "", "aggregation_grouping"),
    ("SELECT a FROM t WHERE k = {k} ORDER BY a", "SELECT a FROM t WHERE k = {k}", "", "order_limit"),
    ("SELECT a FROM t UNION SELECT a FROM u", "SELECT a FROM t INTERSECT SELECT a FROM u", "", "set_operation"),
    ("SELECT t.a FROM t LEFT JOIN u ON t.a = u.a", "SELECT t.a FROM t JOIN u ON t.a = u.a", "", "join"),
    ("SELECT a AS x FROM t WHERE k = {k}", "SELECT a AS y FROM t WHERE k = {k}", "", "other_semantic"),
    ("", "SELECT a FROM t WHERE k = {k}", "", "protocol"),
    ("SELECT a FROM t", "SELECT a FROM t", "timeout", "timeout"),
    ("SELECT a FROM t", "SELECT a FROM t", "missing_table_or_column", "table_or_column"),
    ("DROP TABLE t{k}", "SELECT a FROM t", "", "safety"),
    ("SELECT a FROM t WHERE", "SELECT a FROM t WHERE k = {k}", "", "syntax"),
)


@query("fn_error_taxonomy", f"SELECT s_suppkey, {_cases(TAXONOMY, (3, 'label'))} FROM supplier")
def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of wrong predictions, of a prediction about each supplier."""
    return _judged(spark, sf_dir, TAXONOMY, lambda prediction, gold, status: (guard.classify(spark, prediction, gold, status or None),), "label string", 2, 1)
