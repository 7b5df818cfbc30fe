"""Files and logs: lines with their places, hashes of any size, records that are seen once."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import collection, sampling
from tallyforge.plans import execute
from tallyforge.sources import catalog, files


def test_places_of_lines_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for name in ("a.txt", "b.txt", "empty.txt", "one.txt"):
        n = {"a.txt": 5000, "b.txt": 700, "empty.txt": 0, "one.txt": 1}[name]
        lines = ["" if i and rng.random() < 0.1 else f"{i} " + "x" * rng.randrange(60) for i in range(n)]
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if n % 2 == 0 and n else ""))
        want[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = files.numbered_lines(spark, f"file://{tmp_path}").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, lines in want.items():
        mine = sorted((r.position, r.line) for r in got if r.path.endswith(f"/{name}"))
        assert mine == list(enumerate(lines)), name


def test_hashes_of_small_and_large_files(spark, tmp_path):
    data = {f"f{n}": bytes(random.Random(n).randrange(256) for _ in range(n)) for n in (0, 1, 1000, 5000, 70_000)}
    for name, b in data.items():
        (tmp_path / name).write_bytes(b)
    got = {r.path.rsplit("/", 1)[1]: (r.size, r.sha256) for r in files.file_hashes(spark, f"file://{tmp_path}", whole=4000).collect()}
    assert got == {name: (len(b), hashlib.sha256(b).hexdigest()) for name, b in data.items()}

    def tree(b, chunk=1000, fan=4):
        level = [hashlib.sha256(b[i : i + chunk]).digest() for i in range(0, len(b), chunk)]
        while len(level) > 1:
            level = [hashlib.sha256(b"".join(level[i : i + fan])).digest() for i in range(0, len(level), fan)]
        return level[0].hex() if level else hashlib.sha256().hexdigest()

    got = {r.path.rsplit("/", 1)[1]: (r.size, r.tree_sha256) for r in files.tree_hashes(spark, f"file://{tmp_path}", chunk=1000, fan=4).collect()}
    assert got == {name: (len(b), tree(b)) for name, b in data.items()}


def test_a_log_of_segments(spark, tmp_path):
    folder = f"file://{tmp_path}/log"
    log = files.RecordLog(spark, folder)
    other = files.RecordLog(spark, folder)
    for i in range(120):
        (log if i % 3 else other).append({"b": i, "a": "é" if i % 2 else None})
    seen = lambda: sorted(r.b for r in log.read("a string, b int").collect())
    assert seen() == list(range(120))
    stop, odd = threading.Event(), []

    def read_on():
        while not stop.is_set():
            try:
                got = seen()
            except Exception as e:  # a file that was listed and then went; the next look has all
                assert "FILE_NOT_EXIST" in str(e) or "does not exist" in str(e), e
                continue
            if got != list(range(120)):
                odd.append(got)

    reader = threading.Thread(target=read_on)
    reader.start()
    assert log.compact(keep=20) == 100
    stop.set()
    reader.join()
    assert not odd and seen() == list(range(120)) and len(list((tmp_path / "log").glob("*.jsonl"))) == 21
    log.append({"a": "x", "b": 120}, {"a": "y", "b": 121})
    torn = tmp_path / "log" / f"{500:020d}-{500:020d}.jsonl"
    torn.write_text('{"a":"z","b":122}\n{"a":"z","b":')
    assert seen() == list(range(123))
    again = files.RecordLog(spark, folder)
    assert again.append({"a": "w", "b": 123}) == 501 and again.compact() > 2 and seen() == list(range(124))
    (tmp_path / "log" / f"{3:020d}-{3:020d}.jsonl").write_text('{"a":"old","b":3}\n')  # what a compaction that died left behind
    assert seen() == list(range(124)) and files.RecordLog(spark, folder).next == 502


def test_digest_of_a_multiset(spark):
    rows = spark.range(1000).select((F.col("id") % 700).cast("string").alias("row"))
    of = lambda d, **how: execute.multiset_digest(d, **how).first().digest
    whole = of(rows)
    assert of(rows.repartition(7)) == of(rows.orderBy(F.desc("row"))) == whole
    changed = rows.where("row <> '3'").unionByName(spark.createDataFrame([("x",), ("x",)], "row string"))
    for other in (changed, rows.unionByName(rows.limit(1)), rows.where("row <> '699'"), rows.limit(0)):
        assert of(other) != whole
    assert of(rows, distinct=True) == of(rows.distinct()) == of(rows.unionByName(rows), distinct=True) != whole


def test_keys_of_tables(spark):
    a = spark.createDataFrame([(1, 7, None, "x"), (2, 7, None, "y"), (3, 8, None, "z"), (None, 8, None, "w")], "id long, kind long, nothing long, name string")
    b = spark.createDataFrame([(1, 1, 2), (2, 2, 9), (3, 1, None)], "id int, a_id int, other int")
    got = {tuple(r) for r in catalog.keys({"a": a, "b": b}).collect()}
    assert got == {("a", "id", "unique", None), ("b", "id", "unique", None), ("b", "id", "included", "a.id"), ("a", "id", "included", "b.id"), ("b", "a_id", "included", "a.id"), ("b", "other", "unique", None)}
    assert catalog.keys({"a": a.select("name")}).count() == 0


@pytest.fixture(scope="module")
def plan(spark):
    tasks = spark.range(60).select(F.col("id").alias("task_id"), F.lit("s").alias("split"), F.concat(F.lit("d"), (F.col("id") % 3).cast("string")).alias("db_id"), F.lit("simple").alias("complexity")).cache()
    targets = tasks.groupBy(*sampling.CELL).agg(F.lit(6).cast("long").alias("target")).cache()
    return tasks, targets


def test_a_collection_goes_on_after_every_round(spark, plan, tmp_path):
    attempt = lambda due: due.select("task_id", (F.col("task_id") % 4 != 1).alias("accepted"))
    of = lambda name, **how: collection.Collection(spark, f"file://{tmp_path}/{name}", *plan, attempt, 5, config_hash="c", label="l", **how)
    assert of("whole").run() == "complete"
    while of("killed").run(1) == "rounds":
        pass
    rows = lambda name: sorted((r.task_id, r.accepted, r.round) for r in of(name).log().collect())
    assert rows("whole") == rows("killed") and sum(a for _, a, _ in rows("whole")) == 18
    assert of("few", max_attempts=12).run() == "max_attempts" and len(rows("few")) == 12
    paused = of("paused", pause=lambda log: ["enough"] if log.count() >= 10 else [])
    assert paused.run() == "paused: enough" and len(rows("paused")) == 10


def test_a_collection_ahead_takes_few_rounds(spark, plan, tmp_path):
    """A cell whose tasks are refused, one that needs its last tasks, and one that is soon filled: the log is that of single steps."""
    attempt = lambda due: due.select("task_id", ((F.col("db_id") == "d0") | (F.col("db_id") == "d2") & (F.col("task_id") % 4 == 1)).alias("accepted"))
    logs = {}
    for ahead in (False, True):
        c = collection.Collection(spark, f"file://{tmp_path}/{ahead}", plan[0], plan[1].withColumn("target", F.lit(2).cast("long")), attempt, 5, ahead=ahead)
        assert c.run() == "complete"
        logs[ahead] = c.rounds(), sorted((r.task_id, r.accepted) for r in c.log().collect())
    assert logs[True][1] == logs[False][1] and logs[True][0] <= 6 < logs[False][0]


def test_a_collection_refuses_other_logs(spark, plan, tmp_path):
    attempt = lambda due: due.select("task_id", F.lit(True).alias("accepted"))
    make = lambda **how: collection.Collection(spark, f"file://{tmp_path}/log", *plan, attempt, 5, **how)
    make(config_hash="c", label="l").run(1)
    for how in ({"config_hash": "d", "label": "l"}, {"config_hash": "c", "label": "m"}):
        with pytest.raises(collection.Refused, match="another configuration"):
            make(**how)
    a = make(config_hash="c", label="l")
    a.rounds = lambda: 0  # another collector has committed this round meanwhile
    a.log = lambda: spark.createDataFrame([], collection.LOG)
    with pytest.raises(collection.Refused, match="another collector"):
        a.round()
    log = make(config_hash="c", label="l").log()
    with pytest.raises(collection.Refused, match="come again"):
        collection.resumable(log.unionByName(log.limit(1)), "c", "l")
