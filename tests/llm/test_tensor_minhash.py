import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.llm import tensor_minhash
from tallyforge.llm.tensor_minhash import choose_tensor, half_keys, near_duplicates

from ._oracle import oracle, rows

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text, size=4):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(data):
    sets = [grams(x) for _, x in data]
    by, root = {}, list(range(len(data)))
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for g in s for j in by[g] if j < i).items():
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(data):
        least[top(i)] = min((k, least.get(top(i))), key=lambda v: (v is None, v if v is not None else 0))
    return sorted([(k, len(sets[i]), least[top(i)], k == least[top(i)]) for i, (k, _) in enumerate(data)], key=str)


def got(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()], key=str)


def edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
    return w


def mixed(seed=5):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    data = [(i, " ".join(edited(base, rng.randrange(5), rng))) for i in range(70)]
    chain = [f"c{i}" for i in range(400)]
    data += [(1000 + i, " ".join(chain[4 * i : 4 * i + 60])) for i in range(60)]
    data += [(2000 + i, " ".join(base[:75] + edited(base, i, rng)[75:])) for i in range(30)]
    odd = [None, None, "", " \t\n\r\x0b\x0c ", "one two", "ONE  two", "two one", "one two three four", "é É Ü", "é é ü", "a b c", "...", "x" * 5000, "y " * 5000]
    data += [(5000 + i, x) for i, x in enumerate(odd)] + [(None, "one two"), (None, "none here at all five"), (None, "none here at all five"), (5004, "one two")]
    return data


def test_tensor_reaches_the_recall():
    m, r = choose_tensor(0.8, 0.9999, 96)
    assert (1 - (1 - 0.8**r) ** m) ** 2 >= 0.9999 and 2 * m * r <= 96
    with pytest.raises(ValueError):
        choose_tensor(0.5, 0.999999, 4)


def test_recall_of_table_keys_on_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    m, r = choose_tensor()
    hit = 0
    for _ in range(2000):
        both = rng.integers(0, 2**64, 160, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, 20, dtype=np.uint64)])) for _ in range(2))
        x, y = half_keys(np.concatenate([a, b]), np.array([0, len(a)]), m, r)
        hit += (x[:m] == y[:m]).any() and (x[m:] == y[m:]).any()
    assert hit >= 1997


def test_whole_table_against_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got(near_duplicates(docs)) == want
    assert rows(near_duplicates(docs)) == oracle(tensor_minhash.SQL, documents=docs)


@pytest.mark.parametrize("large", [4096, 8, 1])
def test_groups_chains_and_odd_texts(spark, large):
    """Large components go through leaders, then what is apart by component or by bucket."""
    data = mixed()
    df = spark.createDataFrame([(k, t, "q", 3) for k, t in data], "doc_id long, text string, th string, n int").repartition(5)
    assert got(near_duplicates(df, large=large)) == brute(data)


def test_small_blocks_and_chunks(spark, monkeypatch):
    """What is apart lies over many blocks and chunks."""
    monkeypatch.setattr(tensor_minhash, "BLOCK", 4)
    monkeypatch.setattr(tensor_minhash, "CHUNK", 16)
    monkeypatch.setattr(tensor_minhash, "LEADERS", 1)
    data = mixed(6)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(near_duplicates(df, large=8)) == brute(data)


def test_types_of_ids_and_empty_tables(spark):
    data = [(k, t) for k, t in mixed() if k is not None]
    want = brute(data)
    ints = near_duplicates(spark.createDataFrame(data, "doc_id int, text string"))
    assert dict(ints.dtypes)["component_id"] == "int" and got(ints) == want
    named = near_duplicates(spark.createDataFrame([(f"{k:05d}", t, 1) for k, t in data], "doc_id string, text string, `a.b` int"))
    assert got(named) == sorted([(f"{a:05d}", n, f"{b:05d}", kept) for a, n, b, kept in want], key=str)
    top = 2**63 - 1
    assert got(near_duplicates(spark.createDataFrame([(top, "a b c d e")], "doc_id long, text string"))) == [(top, 2, top, True)]
    empty = spark.createDataFrame([], "doc_id long, text string, kept boolean")
    assert near_duplicates(empty).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert got(near_duplicates(blank)) == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)


def test_dense_group_travels_in_proportion(spark):
    """In a group of near copies, texts that are placed for verification grow with the group, not with its square."""
    placed = {}
    for n in (600, 2400):
        one = spark.range(n).select(F.col("id").alias("node"), F.lit(100).cast("long").alias("n"))
        shared = one.select("node", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("t"))
        shared = shared.select("node", F.xxhash64("t", F.col("node") % (F.col("t") % 3 + 1)).alias("key"), F.lit(0).cast("long").alias("low"), F.lit(True).alias("even"))
        led = tensor_minhash.led(shared, one)
        c = F.when(F.col("node") % 100 == 7, F.col("node")).otherwise(F.lit(0))
        nodes = one.select("node", F.lit(0).cast("long").alias("component"), "n", F.lit(20).cast("long").alias("keys"), c.alias("c"))
        apart = tensor_minhash.apart(shared, nodes).withColumn("x", F.col("blocks") + F.when(F.col("minor"), F.col("chunks") - 1).otherwise(0))
        placed[n] = led.count() + apart.agg(F.sum("x")).first()[0]
    assert placed[2400] < 4.5 * placed[600]


def test_long_chain_goes_by_buckets(spark):
    """20,000 texts that hang together in pairs only: what travels follows the buckets, not the component."""
    n = 20_000
    one = spark.range(n).select(F.col("id").alias("node"), F.lit(60).cast("long").alias("n"))
    keys = F.explode(F.array(F.floor(F.col("node") / 2), n + F.floor((F.col("node") + 1) / 2), 3 * n + F.floor(F.col("node") / 2)))
    shared = one.select("node", keys.alias("key"), F.lit(True).alias("even")).withColumn("low", F.min("node").over(Window.partitionBy("key")))
    nodes = one.select("node", F.lit(0).cast("long").alias("component"), "n", F.lit(3).cast("long").alias("keys"), F.col("node").alias("c"))
    got = tensor_minhash.apart(shared, nodes).groupBy("unit").agg(F.count("*").alias("many"), F.max("blocks").alias("blocks"))
    assert got.agg(F.max("many"), F.max("blocks"), F.sum("many")).first() == (2, 1, 2 * n - 2)


def joined_rows(spark, on, f):
    """Rows that inner joins on one column made while ``f`` ran, by the metrics of Spark's SQL status."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark._jsc.sc().listenerBus()

    def executions():
        bus.waitUntilEmpty()
        found = store.executionsList()
        return [found.apply(i).executionId() for i in range(found.size())]

    before, total = max(executions(), default=-1), 0
    f()
    for k in (k for k in executions() if k > before):
        nodes, values = store.planGraph(k).allNodes(), store.executionMetrics(k)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and re.search(rf"\[{on}#\d+L?\], \[{on}#\d+L?\], Inner", node.desc()):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                of = [m.accumulatorId() for m in metrics if m.name() == "number of output rows"]
                total += sum(int(values.apply(i).replace(",", "")) for i in of if values.contains(i))
    return total


@pytest.mark.parametrize("n", [1200, 2400])
def test_keys_of_a_dear_group_meet_it_as_one_row_a_node(spark, n):
    """A group of long texts that goes by its buckets: joins on the node make a row for each node, not one for each of its 8 table keys and use."""
    one = spark.range(n).select(F.col("id").alias("node"), F.lit(40_000).cast("long").alias("n"))
    keys = F.explode(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda t: F.xxhash64(t, F.floor(F.col("node") / t))))
    shared = one.select("node", keys.alias("key"), F.lit(True).alias("even")).withColumn("low", F.min("node").over(Window.partitionBy("key")))
    nodes = one.select("node", F.lit(0).cast("long").alias("component"), "n", F.lit(8).cast("long").alias("keys"), F.col("node").alias("c"))
    placed = []
    made = joined_rows(spark, "node", lambda: placed.extend(tensor_minhash.apart(shared, nodes).select("unit", "node").collect()))
    by = {}
    for r in placed:
        by.setdefault(r.unit, set()).add(r.node)
    want = {frozenset(range(i, min(i + t, n))) for t in range(2, 9) for i in range(0, n, t) if i + 1 < n}
    assert {frozenset(x) for x in by.values()} == want and len(by) == len(want)
    assert 0 < made <= 2 * n
