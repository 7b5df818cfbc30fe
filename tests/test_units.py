"""Single operators on small fixtures."""

import hashlib
import math
import os
import random
import re
import sys
import unicodedata
from difflib import SequenceMatcher
from itertools import zip_longest

import pytest
from pyspark.sql import functions as F

from tallyforge import config, schemas
from tallyforge.functions import exprs as X
from tallyforge.operators import checks, diagnostics, episodes, groups, ledger, metrics, report, sampling, split, training
from tallyforge.plans import execute, guard
from tallyforge.session import stored
from tallyforge.sources import catalog, jsonl

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def items(spark):
    rows = [(7, "oak", b"\x01\x80\x02", -0.75), (8, "elm", None, 12.0), (9, "oak", b"\x01\x80\x02", -0.75)]
    spark.createDataFrame(rows, "tree int, kind string, seed binary, height double").createOrReplaceTempView("items")


WRITES = ["UPDATE items SET kind = 'ash'", "TRUNCATE TABLE items", "ALTER TABLE items ADD COLUMNS (x INT)", "DROP VIEW items", "SET spark.sql.ansi.enabled = false", "USE other", "CACHE TABLE items", "SELECT 2; SELECT 3", "", ";;"]
BROKEN = ["SELECT kind FROM", "SELECT kind WHERE FROM items", "SELECT kind FROM items GROUP", "SELECT max(tree FROM items"]


@pytest.mark.parametrize("sql", WRITES)
def test_guard_refuses_writes(spark, items, sql):
    with pytest.raises(guard.UnsafeSQL):
        guard.validate(spark, sql)


@pytest.mark.parametrize("sql", BROKEN)
def test_guard_tells_broken_queries(spark, items, sql):
    with pytest.raises(guard.BadSyntax):
        guard.validate(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT kind FROM items WHERE height > (SELECT avg(height) FROM items)", "/* a; b */ SELECT 'x;y' AS z", "(SELECT max(height) FROM items)", "WITH t AS (SELECT tree FROM items) SELECT count(*) FROM t;"])
def test_guard_lets_reads_pass(spark, items, sql):
    guard.validate(spark, sql)


def test_digest_ignores_order_and_repetition_but_not_types(spark, items):
    run = lambda s: execute.run_sql(spark, s, timeout=60)
    a = run("SELECT kind, seed, height FROM items ORDER BY tree DESC")
    b = run("SELECT DISTINCT kind AS k, seed, height FROM items")
    assert a.status == b.status == "passed" and a.digest == b.digest and (a.row_count, a.unique_row_count, b.row_count) == (3, 2, 2)
    assert len({run(f"SELECT {x} AS x").digest for x in ("7", "7.0D", "'7'", "8")}) == 4
    rows = execute.canonical(spark.sql("SELECT kind, seed, height FROM items"))
    assert execute.digest_of(rows).first().digest == a.digest
    assert run("SELECT kind FROM items WHERE height > 99").empty_result


def test_timeout_and_late_rows(spark, items):
    spark.range(3_000_000).createOrReplaceTempView("big")
    out = execute.run_sql(spark, "SELECT count(*) AS n FROM big a JOIN big b ON a.id < b.id JOIN big c ON b.id < c.id", timeout=0.5)
    assert out.status == "timeout"
    out = execute.run_sql(spark, "SELECT id FROM big ORDER BY id", timeout=60, max_rows=5, keep_rows=True, preview=2)
    assert out.result_too_large and [r[0] for r in out.rows] == [0, 1, 2, 3, 4, 5] and len(out.preview) == 2


PAIRS = [([], []), ([(1,), (1,)], [(1,)]), ([(2,), (1,)], [(1,), (2,)]), ([(1, 2)], [(1, 3)]), ([(1,), (2,)], [(1,)]), ([], [(1,)]), ([(1,)], [])]


def plain_f1(predicted, gold):
    """Soft F1 of two results, partner by partner."""
    if not predicted and not gold:
        return 1.0
    both = list(zip_longest(dict.fromkeys(predicted), dict.fromkeys(gold)))
    share = lambda a, b, n, inside: sum((v in b) == inside for v in a) / n
    tp = sum(share(p, g, len(g), True) for p, g in both if p and g)
    fp = sum(1 if g is None else share(p, g, len(g), False) for p, g in both if p)
    fn = sum(1 if p is None else share(g, p, len(g), False) for p, g in both if g)
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def test_scores_of_pairs(spark):
    rows = lambda k: [(i, n, [str(v) for v in r]) for i, p in enumerate(PAIRS) for n, r in enumerate(p[k])]
    schema = "pair_id int, position int, row array<string>"
    p, g, pairs = spark.createDataFrame(rows(0), schema), spark.createDataFrame(rows(1), schema), spark.createDataFrame([(i,) for i in range(len(PAIRS))], "pair_id int")
    assert [r.ex for r in metrics.execution_match(p, g, pairs).orderBy("pair_id").collect()] == [float(set(a) == set(b)) for a, b in PAIRS] == [1, 1, 1, 0, 0, 0, 0]
    got = [r.soft_f1 for r in metrics.soft_f1(p, g, pairs).orderBy("pair_id").collect()]
    assert got == pytest.approx([plain_f1(a, b) for a, b in PAIRS]) and got[:4] == pytest.approx([1, 1, 0, 0.5])


@pytest.mark.parametrize(("ratio", "reward"), [(0, 0), (0.1, 0.25), (0.25, 0.5), (0.5, 0.75), (1, 1), (2, 1.25)])
def test_efficiency_steps(spark, ratio, reward):
    assert one(spark, X.ratio_reward(F.lit(float(ratio)))) == reward
    df = spark.createDataFrame([(1, float(ratio))] * 3, "pair_id int, ratio double")
    assert metrics.efficiency(df).first().r_ves == pytest.approx(math.sqrt(reward) * 100)


def test_wilson_and_percentiles(spark):
    assert one(spark, X.wilson_upper(F.lit(9), F.lit(20))) == pytest.approx(0.6579146575496577, abs=1e-15)
    assert one(spark, X.wilson_upper(F.lit(0), F.lit(0))) == 1.0
    rng = random.Random(1)
    rows = [(k, rng.choice([0.0, 1.0, -2.5, rng.uniform(-1, 1), rng.gauss(0, 1e6), 1e300, float("inf"), float("nan")]), rng.choice([1, 1, 3])) for k in ("a", "b", None) for _ in range(rng.randrange(60, 90))]
    rows += [("one", 7.0, 1), ("none", None, 1)]
    df = spark.createDataFrame(rows, "k string, x double, times int")
    shares = {"low": 0.0, "p25": 0.25, "p50": 0.5, "p95": 0.95, "high": 1.0}
    key = lambda x: (math.isnan(x), x)
    for times in (None, F.col("times")):
        want = {}
        for k in ("a", "b", None, "one"):
            values = sorted((x for g, x, n in rows if g == k for _ in range(n if times is not None else 1)), key=key)
            want[k] = tuple(repr(values[round((len(values) - 1) * p)]) for p in shares.values())
        assert {r.k: tuple(repr(r[c]) for c in shares) for r in X.ranked(df, "x", ["k"], times, **shares).collect()} == want


def test_updates_of_groups(spark):
    judge = lambda rows: spark.createDataFrame(rows, "batch long, uid string, uniform boolean")
    got = groups.updates(judge([(7, "p", True), (7, "q", False), (8, "r", False), (8, "s", False), (9, "t", True)]), 2, 3, 5).orderBy("update").collect()
    assert [r.status for r in got] == ["updated", "data_exhausted"] and set(groups.COUNTERS) < set(got[0].asDict())
    assert [(r.generation_batches, r.generated_rollouts, r.retained_rollouts, r.discarded_surplus_diverse_groups, r.extra_rollouts, r.total_generated_groups) for r in got] == [(2, 12, 6, 1, 6, 4), (1, 3, 0, 0, 3, 5)]
    got = groups.updates(judge([(b, f"{b}", True) for b in range(9)]), 1, 4, 3).collect()
    assert [(r.status, r.generation_batches, r.retained_groups) for r in got] == [("max_batches_exceeded", 3, 0)]
    assert [r.uid for r in groups.repeated_groups(spark.createDataFrame([(1, "a"), (2, "a"), (2, "b"), (2, "b")], "batch int, uid string")).collect()] == ["a"]


@pytest.mark.parametrize("x", [0.0, 1.0, -0.2, 123456.789, 1e-5, 0.0001, -3.25e-7, 1e12, 123456789012.0, 1234567890123.0, 1 / 3, 100.0, 2.5e20])
def test_twelve_digits(spark, x):
    assert one(spark, groups.short_number(F.lit(x))) == format(x, ".12g")


def test_quotas_of_databases_and_classes(spark):
    of = lambda total, **n: {r.db_id: r.quota for r in sampling.database_quotas(spark.createDataFrame([("s", d, k, total) for d, k in n.items()], "split string, db_id string, n long, total long")).collect()}
    with pytest.raises(sampling.Infeasible):
        of(1, a=3, b=3)
    with pytest.raises(sampling.Infeasible):
        of(7, a=3, b=3)
    q = of(10, a=100, b=4, c=1)
    assert sum(q.values()) == 10 and q["c"] == 1 and q["b"] <= 4
    assert of(8, a=3, b=4, c=1) == {"a": 3, "b": 4, "c": 1} and of(2, a=1, b=9) == {"a": 1, "b": 1}
    k = {(r.split, r.complexity): r.quota for r in sampling.class_quotas(spark, {"s": 10, "t": 0}).collect()}
    assert k == {("s", "simple"): 3, ("s", "moderate"): 5, ("s", "challenging"): 2, ("t", "simple"): 0, ("t", "moderate"): 0, ("t", "challenging"): 0}
    with pytest.raises(ValueError):
        sampling.class_quotas(spark, {"s": 3}, {"simple": -1.0})


def test_flow_and_reallocation():
    cap = {(d, c): n for d in ("a", "b") for c, n in zip(sampling.CLASSES, (3, 5, 2))}
    cells = sampling.allocate(cap, {"a": 5, "b": 5}, {"simple": 3, "moderate": 5, "challenging": 2})
    assert all(cells[k] <= cap[k] for k in cap) and sum(cells.values()) == 10 and sum(n for (d, _), n in cells.items() if d == "a") == 5
    with pytest.raises(sampling.Infeasible):
        sampling.allocate(cap, {"a": 9, "b": 9}, {"simple": 3, "moderate": 5, "challenging": 2})
    targets = {("s", d, "simple"): n for d, n in (("x", 4), ("y", 6))}
    out, moves = sampling.reallocated(targets, {("s", "x", "simple"): 1, ("s", "y", "simple"): 20})
    assert out == {("s", "x", "simple"): 3, ("s", "y", "simple"): 7} and moves == [(("s", "x", "simple"), ("s", "y", "simple"))]
    assert sampling.reallocated(targets, targets) == (targets, [])


def test_handing_out_goes_on_from_the_log(spark):
    """Batch by batch with the log kept, the order is that of one plan; refused tasks are replaced."""
    tasks = spark.createDataFrame([(f"{d}{i}", "s", d, k) for d in "xy" for k in ("simple", "moderate") for i in range(12)], "n string, split string, db_id string, complexity string")
    tasks = tasks.select(F.concat("n", "complexity").alias("task_id"), *sampling.CELL).cache()
    targets = spark.createDataFrame([("s", "x", "simple", 3), ("s", "y", "simple", 1), ("s", "x", "moderate", 2), ("s", "y", "moderate", 4)], "split string, db_id string, complexity string, target int")
    log: list[tuple[str, bool]] = []
    df = lambda: spark.createDataFrame(log, "task_id string, accepted boolean")
    whole = [r.task_id for r in sampling.handed_out(tasks, targets, df()).orderBy("place").collect()]
    assert len(whole) == len(set(whole)) == 10
    got = []
    while len(got) < 10:
        step = [r.task_id for r in sampling.handed_out(tasks, targets, df(), 4).orderBy("place").collect()]
        got += step
        log += [(t, True) for t in step]
    assert got == whole
    log[0] = (log[0][0], False)
    again = sampling.handed_out(tasks, targets, df()).collect()
    assert len(again) == 1 and again[0].task_id not in got


def slow_simhash(text):
    w = text.split()
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else w
    out = 0
    for bit in range(64):
        votes = [int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "big") >> bit & 1 for g in grams]
        out |= (2 * sum(votes) >= len(votes)) << bit
    return out


def slow_norm(text):
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", text).casefold()).split())


QUESTIONS = [
    "Wie heißt die Straße am Fluß?", "WIE HEISST DIE STRASSE AM FLUSS", "Ｗｉｅ heißt die Straße am Fluß", "How many ships are in the harbour of Bergen today?", "How many ships are in the harbours of Bergen today?",
    "how many ships are in the harbour of bergen today", "cafe\u0301 au lait", "café au lait!", "x", "", "?!", "ﬁne weather in the north sea is rare in the month of may", "fine weather in the north sea is rare in the month of may.",
    "fine weather in the north sea is rare in the month of june", "a b", "b a",
]


def test_leaks_between_splits(spark):
    long = " ".join(f"w{i}" for i in range(45))
    rows = [(i, q) for i, q in enumerate(QUESTIONS)] + [(50, QUESTIONS[3]), (51, QUESTIONS[4]), (60, long), (61, long + "s"), (62, long), (63, "x" + long), (64, long + " tail of another length that is far too long to be near")]
    df = spark.createDataFrame(rows, "task_id long, question string")
    norm = {k: slow_norm(q) for k, q in rows}
    assert {r.task_id: r.t for r in df.select("task_id", X.normalized(F.col("question")).alias("t")).collect()} == norm
    bands = {}
    for r in split.simhash_bands(df).collect():
        bands.setdefault(r.task_id, {})[r.band] = r.value
    assert bands == {k: {b: slow_simhash(q) >> 16 * b & 0xFFFF for b in range(4)} for k, q in norm.items()}
    train, dev = df.where("task_id % 2 = 0"), df.where("task_id % 2 = 1")
    a, b = ({k: q for k, q in norm.items() if k % 2 == x} for x in (0, 1))
    shared = {q for q in a.values() if q and q in b.values()}
    least = {q: min(k for k in a if a[k] == q) for q in shared}
    got = {(r.side, r.task_id, r.class_id) for r in split.exact_overlap(train, dev).collect()}
    assert got == {(s, k, least[q]) for s, d in (("train", a), ("dev", b)) for k, q in d.items() if q in shared} and got
    size = lambda d, q: sum(x == q for x in d.values())
    want = set()
    for x in a.values():
        for y in b.values():
            ratio = SequenceMatcher(None, x, y).ratio()
            if x and y and x != y and ratio >= 0.95:
                want.add((min(k for k in a if a[k] == x), min(k for k in b if b[k] == y), round(ratio, 6), size(a, x), size(b, y)))
    found = [tuple(r) for r in split.near_pairs(train, dev).collect()]
    assert found == sorted(want, key=lambda r: (-r[2], r[0], r[1])) and found
    assert {(r.task_id, r.class_id) for r in split.members(df).collect()} == {(k, min(j for j in norm if norm[j] == q)) for k, q in norm.items() if q}


def test_near_pairs_are_not_lost(spark, capsys):
    """Pairs of a ratio of 0.95 or more, planted in texts of several lengths, against the matcher alone."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9)))
    rows, planted = [], set()
    for n in (2, 4, 7, 15, 15, 60, 60, 300):
        for _ in range(60):
            w = [word() for _ in range(n)]
            v = list(w)
            if n >= 60:
                for _ in range(rng.randrange(1, 1 + n // 30)):
                    v[rng.randrange(n)] = word()
            elif n == 15:
                v[-1] = v[-1][:-2] + word()[:2]
            else:
                i = rng.randrange(n)
                v[i] = v[i] + "s"
            if w == v:
                continue
            i = len(rows)
            rows += [(i, " ".join(w)), (i + 1, " ".join(v))]
            if SequenceMatcher(None, rows[-2][1], rows[-1][1]).ratio() >= 0.95:
                planted.add((i, i + 1))
    df = spark.createDataFrame(rows, "task_id long, question string")
    got = {(r.train_task_id, r.dev_task_id) for r in split.near_pairs(df.where("task_id % 2 = 0"), df.where("task_id % 2 = 1")).collect()}
    with capsys.disabled():
        print(f" near pairs found: {len(planted & got)} of {len(planted)}")
    assert len(planted) > 200 and len(planted & got) >= 0.99 * len(planted)


def test_plan_does_not_depend_on_order(spark):
    rows = [(f"{s}{d}{i}", s, d, "simple" if i < 2 else "moderate" if i < 4 else "challenging") for s in ("train", "validation") for d in "ab" for i in range(5)]
    df = spark.createDataFrame(rows, "task_id string, split string, db_id string, complexity string")
    a, b = sampling.plan(df, {"train": 5, "validation": 5}), sampling.plan(df.orderBy(F.desc("task_id")), {"train": 5, "validation": 5})
    assert a == b and sum(a.values()) == 10
    assert sampling.plan_hash(df, a) == sampling.plan_hash(df.orderBy("task_id"), b) != sampling.plan_hash(df.limit(19), a)


def test_validation_groups(spark):
    df = spark.createDataFrame([(f"db_{i}", 100 + i) for i in range(12)], "db_id string, n long")
    order = sorted((f"db_{i}" for i in range(12)), key=lambda d: sampling.tie(42, d))
    total, run, best = sum(range(100, 112)), 0, None
    for at, d in enumerate(order[:-1], 1):
        run += 100 + int(d[3:])
        best = min(best or (9, 0), (abs(run / total - 0.1), at)) if run >= 100 else best
    got = [r.db_id for r in split.validation_groups(df).orderBy("place").collect()]
    assert got == order[: best[1]]


def test_loops_and_runs(spark):
    keys = ["a", "a", "b", "b", "b", "b", "c"]
    ev = spark.createDataFrame([("e", i, k, "x", True, 1) for i, k in enumerate(keys)], "episode_id string, step int, event_type string, tool string, ok boolean, tokens int")
    assert episodes.loops(ev).first().step == 4
    assert episodes.repeated_calls(ev).first().repeated == 4
    assert episodes.context(ev, 10).first().max_context == 16


def test_advantages(spark):
    df = spark.createDataFrame([(0, 1, 1.0), (1, 1, 0.0), (2, 1, None), (3, 2, 0.5), (4, 2, 0.5), (5, 3, None)], "idx int, uid int, reward double")
    got = {r.idx: r.advantage for r in groups.advantages(df).collect()}
    assert got == {0: 1.0, 1: -1.0, 2: None, 3: 0.0, 4: 0.0, 5: None}


def test_sequences_learn_only_actions(spark):
    m = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "abc"), (1, 2, "tool", "t"), (1, 3, "assistant", "d")], "conv_id int, turn int, role string, text string")
    s = training.action_only(training.conversations(m)).first()
    assert "".join(chr(x) for x in s.labels if x != -100) == "abcd" and len(s.input_ids) == len(s.labels) == len(s.attention_mask)
    assert "<tool_response>\nt\n</tool_response>" in "".join(map(chr, s.input_ids))
    r = training.rollout(training.conversations(m)).first()
    assert list(r.response_mask) == [0, 0, 1, 1, 1, 0, 1]
    encode = training.tokenizer(lambda t: [len(t)])
    assert m.select(encode("text").alias("x")).first().x == [2]


def test_strict_records(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    assert jsonl.read_jsonl(spark, path, "a int").count() == 0
    jsonl.write_jsonl(spark.createDataFrame([(1, None)], "b int, a string"), path)
    assert "".join(f.read_text() for f in sorted(tmp_path.glob("r/part*"))) == '{"a":null,"b":1}\n'
    assert jsonl.read_jsonl(spark, path, "a string, b int").first() == (None, 1)
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, path, "a string")
    (tmp_path / "bad").write_text("[1]\n")
    with pytest.raises(ValueError):
        jsonl.read_jsonl(spark, f"file://{tmp_path}/bad", "a string")
    assert schemas.names(schemas.TASK)[:2] == ["schema_version", "task_id"]
    for s in (schemas.ANSWER, schemas.EPISODE, schemas.EVALUATION, schemas.AUDIT, schemas.ATTEMPT, schemas.CONVERSATION, schemas.CAMPAIGN):
        assert schemas.names(s)
    assert schemas.value_errors(spark.createDataFrame([("passed",), ("odd",), (None,)], "s string"), "s", schemas.AUDIT_STATUS).count() == 2


def test_catalog(spark, items):
    assert catalog.missing(spark, ["items", "nothing"]) == ["nothing"]
    got = [r.kind for r in catalog.search_values(spark.table("items"), "kind", "ak", 5).collect()]
    assert got == ["oak"]
    with pytest.raises(ValueError):
        catalog.search_values(spark.table("items"), "kind", "a", 21)
    s = spark.createDataFrame([(0, "a", "x" * 50), (1, "b", "x" * 60), (2, "c", "x")], "position int, table_name string, body string")
    assert [r.kept for r in catalog.page_schemas(s, 100).orderBy("position").collect()] == [True, False, False]


def test_sequence_over_partitions(spark):
    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    got = diagnostics.sequence(df, "k").orderBy("k").collect()
    assert [r.seq for r in got] == list(range(1, 1001))
    assert stored(df).count() == 1000


def test_config_and_checks(spark, tmp_path):
    assert config.problems(config.CONFIG) == [] and config.rollouts(config.CONFIG) == (800, 8000)
    assert config.problems(config.Config(target_total=7)) == ["quota"]
    (tmp_path / "c.json").write_text('{"nope": 1}')
    with pytest.raises(TypeError):
        config.load(str(tmp_path / "c.json"))
    assert one(spark, checks.tool_call(F.lit('{"tool_calls":[{"name":"a"}]}'))).call == '{"name":"a"}'


def test_entry_without_the_corpus_operators(tmp_path):
    """The rest imports and has its queries where the corpus operators are not there."""
    import shutil
    import subprocess

    shutil.copytree(HERE, tmp_path / "r", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_reports(spark):
    rows = [(label, i, ["simple", "challenging"][i % 2], float((i + m) % 2), 0.5, 100.0 * m, "syntax" if i == m else None) for m, label in enumerate(("base", "sft")) for i in range(4)]
    schema = "label string, task_id int, complexity string, ex double, soft_f1 double, r_ves double, error_type string"
    r = spark.createDataFrame(rows, schema)
    text = report.compare_report(r, ("base", "sft"), {"base": "h", "sft": "h"})
    assert "| base | 4 | 50.00% | 50.00% | 0.00 | +0.00 |" in text and "| challenging | sft | 2 | 0.00% | 50.00% | 100.00 | -100.00 |" in text and "| sft | syntax | 1 |" in text
    for bad, why in ((r.where("label = 'base' OR task_id > 0"), "missing"), (r.unionByName(r.limit(1)), "twice"), (r.withColumn("ex", F.when(F.col("task_id") > 1, F.col("ex"))), "no score"), (r.where("label = 'base'"), "run is missing")):
        with pytest.raises(ValueError, match=why):
            report.compare_report(bad, ("base", "sft"))
    with pytest.raises(ValueError, match="conditions"):
        report.compare_report(r, ("base", "sft"), {"base": "h", "sft": "other"})
    one = report.run_report(r.where("label = 'sft'"), "sft", source={"seed": "42"})
    assert "| R-VES | 100.00 |" in one and "| simple | 2 | 100.00% |" in one and "| seed | 42 |" in one
