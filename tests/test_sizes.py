"""What failed on larger tables only, on small ones."""

import itertools
import random
import time
from difflib import SequenceMatcher

import pyarrow as pa
import pytest

from tallyforge.operators import split
from tallyforge.plans import execute, guard, shapes
from tallyforge.queries import ORACLES, QUERIES
from tallyforge.streaming import campaign

from .oracle import connect, duck_rows, spark_rows


def test_a_recursion_has_no_limit_of_rows(spark, tmp_path):
    spark.range(1, 60).selectExpr("id AS p_partkey", "CAST(id % 7 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    name = "spark.sql.cteRecursionRowLimit"
    spark.conf.set(name, "40")
    try:
        assert QUERIES["a_recursive_cte"](spark, str(tmp_path)).count() == 59
        assert spark.conf.get(name) == "40"
    finally:
        spark.conf.unset(name)


def test_answers_after_a_month_settle_their_reservation(spark, tmp_path):
    """Values are hours: with millions of events some answers come more than 31 days after their request."""
    at = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id * 7 AS INT))"
    kind = "CASE WHEN id = 3 THEN 'signup' WHEN id % 5 = 0 THEN 'error' ELSE 'view' END"
    e = spark.range(1, 60).selectExpr("id AS event_id", f"{at} AS ts", "id % 2 AS user_id", f"{kind} AS event_type", "CASE WHEN id < 8 THEN 740.0D + id ELSE 1.5D * id END AS value", "concat('{\"k\": ', id % 50, '}') AS props")
    e.write.parquet(f"{tmp_path}/events.parquet")
    rows = spark_rows(QUERIES["h5_reservations"](spark, str(tmp_path)))[2]
    assert rows == duck_rows(connect(str(tmp_path)), ORACLES["h5_reservations"])[2] and any("settled_late" in r for r in rows)


def test_statements_of_one_shape_are_judged_alike(spark):
    """Shapes against the judgements one by one, with values that are equal, unequal, or equal but for letter case or form."""
    atoms = ("5", "6", "05", "5.0", "2147483648", "'A5'", "'a5'", "'b'", "DATE '2024-01-01'", "DATE '2024-13-01'", "x5", '"select"')
    texts = [f"SELECT a FROM t WHERE k = {x}" for x in atoms] + ["SELECT a FROM t LIMIT 5", "DROP TABLE t5", "DROP TABLE t6", "", "SELECT FROM", "SELECT a FROM t WHERE"]
    by_shape: dict[str, set] = {}

    def normal(a: str, b: str):
        try:
            return guard.normalize(spark, a) == guard.normalize(spark, b)
        except ValueError as e:
            return type(e).__name__

    for a, b in itertools.product(texts[:9] + texts[12:], texts[:12]):
        by_shape.setdefault(shapes.shape([a, b]), set()).add((guard.classify(spark, a, b), normal(a, b)))
    assert all(len(x) == 1 for x in by_shape.values())
    of = lambda *t: shapes.shape(list(t))
    assert of("SELECT 5", "SELECT 6") == of("SELECT 17", "SELECT 4") != of("SELECT 5", "SELECT 5")
    assert of("SELECT 'A5'", "SELECT 'a5'") == of("SELECT 'B7'", "SELECT 'b7'") != of("SELECT 'A5'", "SELECT 'b5'")


@pytest.mark.parametrize("name", ["a10_normalised_sql", "a11_physical_tables", "fn_sql_complexity", "fn_error_taxonomy"])
def test_the_parser_sees_each_shape_once(spark, tmp_path, monkeypatch, name):
    spark.range(600).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    parsed, parse = [], guard.parse
    monkeypatch.setattr(guard, "parse", lambda s, sql: parsed.append(sql) or parse(s, sql))
    rows = spark_rows(QUERIES[name](spark, str(tmp_path)))[2]
    assert rows == duck_rows(connect(str(tmp_path)), ORACLES[name])[2] and 0 < len(parsed) < 40


def test_a_band_join_compares_neighbours_only(spark, tmp_path):
    """Prices on and beside the steps' edges, far apart, very large, odd; against SQL, and the join has a key of the price."""
    prices = [0.0, 2.9999999999999996, 3.0, 7.999999999999999, 8.0, 12.999999999999998, 13.0, -0.5, -8.0, -4.0, 1e15, 1e15 + 4, 4e15, 1e17, 1e17 + 16, float("inf"), float("-inf"), float("nan"), None]
    rows = [(i, "b", 1 + i % 2, p) for i, p in enumerate(x for p in prices for x in (p, p))] + [(100 + i, None, None, 3.0) for i in range(2)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["a_theta_join"](spark, str(tmp_path))
    rows = spark_rows(df)[2]
    assert rows == duck_rows(connect(str(tmp_path)), ORACLES["a_theta_join"])[2] and len(rows) > 10
    assert "step" in df._jdf.queryExecution().executedPlan().toString()


def test_long_texts_are_compared_as_the_matcher_does(monkeypatch):
    """Texts beyond 200 letters with few and many changes: the same ratio, or 0 where it is under the limit, without the matcher's own search."""
    rng = random.Random(3)
    cases = []
    for n in (40, 120, 700):
        for changes in (0, 1, 2, 5, n // 12, n // 3):
            for letters in ("etaoinshrdlu", "etaoinshrdluwmfcgypbvkjxqz0123456789"):
                w = ["".join(rng.choices(letters, [2.0**-i + 0.01 for i in range(len(letters))], k=rng.randrange(2, 9))) for _ in range(n)]
                v = list(w)
                for _ in range(changes):
                    v[rng.randrange(n)] = rng.choice(w)[::-1]
                cases.append((" ".join(w), " ".join(v)))
    want = [SequenceMatcher(None, a, b).ratio() for a, b in cases]
    assert any(0.95 <= x < 1 for x in want) and any(x < 0.95 for x in want)
    monkeypatch.setattr(split.SequenceMatcher, "find_longest_match", lambda *a, **k: pytest.fail("the matcher went through a long text"))
    long = [(c, x) for c, x in zip(cases, want) if SequenceMatcher(None, *c).bpopular]
    assert len(long) > 20 and [split.similar(*c) for c, _ in long] == [x if x >= split.SIMILAR else 0.0 for _, x in long]


def test_texts_are_hashed_in_small_batches(spark, monkeypatch):
    name, seen, stored = "spark.sql.execution.arrow.maxRecordsPerBatch", [], split.stored
    before = spark.conf.get(name)
    monkeypatch.setattr(split, "stored", lambda df: seen.append(spark.conf.get(name)) or stored(df))
    assert split.simhash_bands(spark.createDataFrame([(1, "a b c"), (2, None)], "task_id long, question string")).count() == 4
    assert seen == [split.TEXTS_AT_ONCE] and spark.conf.get(name) == before


def test_a_task_hands_sums_to_the_ledger():
    """Attempts and reports of a task are one row each, whatever the number of batches."""
    def batch(rows):
        names = ["campaign", "shard", "kind", "n", "cost_micro", "tokens", "seq"]
        return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(c, pa.string() if c in ("campaign", "kind") else pa.int32() if c == "shard" else pa.int64()) for c in names]))

    parts = [batch([("c", 1, "attempt", 1, 5, None, i), ("c", 0, "report", 1, 9 - i, 2, i), ("c", 0, "open", 1, None, None, i)]) for i in range(3)]
    got = sorted(tuple(r.values()) for b in campaign._summed(iter(parts)) for r in b.to_pylist() if r["kind"] != "open")
    assert got == [("c", 0, "report", 3, 9, 2, None), ("c", 1, "attempt", 3, 15, None, None)]
    assert sum(r["kind"] == "open" for b in campaign._summed(iter(parts)) for r in b.to_pylist()) == 3


@pytest.mark.parametrize("timeout", [0.001, 2.0])
def test_a_late_statement_leaves_no_task(spark, timeout):
    """Late before its first job, and late within a loop over rows of three tables: it ends, and so do its tasks."""
    spark.range(6000).createOrReplaceTempView("wide")
    running = lambda: sum(i.numRunningTasks() for i in spark.sparkContext._jsc.sc().statusTracker().getExecutorInfos())
    out = execute.run_sql(spark, "SELECT count(*) AS n FROM wide a JOIN wide b ON a.id < b.id + 7000 JOIN wide c ON b.id < c.id + 7000", timeout=timeout)
    assert out.status == "timeout" and out.elapsed_ms < 1000 * timeout + 4000
    end = time.monotonic() + 3
    while running() and time.monotonic() < end:
        time.sleep(0.05)
    assert running() == 0


def test_joins_that_can_be_stopped_have_the_same_rows(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.range(40).createOrReplaceTempView("narrow")
    for kind in ("JOIN", "LEFT JOIN", "FULL JOIN"):
        out = execute.run_sql(spark, f"SELECT a.id, b.id FROM narrow a {kind} narrow b ON a.id > b.id + 30 AND a.id < 38", timeout=60, keep_rows=True)
        rows = [(a, b) for a in range(38) for b in range(40) if a > b + 30]
        rows += [(a, None) for a in range(40) if kind != "JOIN" and a not in {x for x, _ in rows}]
        rows += [(None, b) for b in range(40) if kind == "FULL JOIN" and b not in {y for _, y in rows}]
        assert out.status == "passed" and sorted(out.rows, key=str) == sorted(rows, key=str)
    assert spark.conf.get(name) == before


def test_near_pairs_bring_few_texts_at_once(spark, monkeypatch):
    """400 candidates of 40 texts: compared in rounds of about as many letters as the classes have, all of them, and no shuffle file is left but those of the last sort."""
    rng = random.Random(5)
    w = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(3, 9))) for _ in range(30)]
    texts = [" ".join([*w[: i % 25], f"x{i}", *w[i % 25 + 1 :]]) for i in range(40)] + [" ".join(w)] * 2
    tasks = spark.createDataFrame(list(enumerate(texts)), "task_id long, question string")
    seen, stored = [], split.stored
    monkeypatch.setattr(split, "stored", lambda df: seen.append(df.columns) or stored(df))
    monkeypatch.setattr(split, "LETTERS_AT_ONCE", 1, raising=False)
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(f.length() for f in (lambda s: (s.apply(i) for i in range(s.size())))(files.getAllFiles()) if f.getName().startswith("shuffle_"))
    before = held()
    df = split.near_pairs(tasks.where("task_id % 2 = 0"), tasks.where("task_id % 2 = 1"))
    left = held() - before
    got = {(r.train_task_id, r.dev_task_id): r.similarity for r in df.collect()}
    want = {(i, j): round(split.similar(texts[i], texts[j]), 6) for i in range(0, 42, 2) for j in range(1, 42, 2) if texts[i] != texts[j]}
    assert got == {k: v for k, v in want.items() if v >= split.SIMILAR} and len(got) > 100
    assert sum("similarity" in c for c in seen) > 5 and left < 1000
