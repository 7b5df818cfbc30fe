import random
import re

from pyspark.sql import functions as F

from tallyforge.llm.components import connected_components
from tallyforge.llm.jaccard_join import choose_bands, keep_one, near_duplicates, units

DATA = "/root/testdata/sf0.001"


def grams(text, size=5):
    w = re.findall(r"[A-Za-z0-9_\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, t=0.8):
    sets = [grams(x) for _, x in rows]
    root, n = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= t * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                n[i] += 1
                n[j] += 1
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = top(i)
        least[r] = k if r not in least or least[r] is None else least[r] if k is None else min(k, least[r])
    return sorted([(k, least[top(i)], n[i]) for i, (k, _) in enumerate(rows)], key=str)


def got(df):
    return sorted([(r.doc_id, r.class_id, r.n_links) for r in df.collect()], key=str)


def test_bands_reach_the_recall():
    b, r = choose_bands(0.8, 0.9999, 192)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999 and b * r <= 192
    assert 1 - (1 - 0.8 ** (r + 1)) ** (192 // (r + 1)) < 0.9999


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(100, 200), (300, 200), (7, 7), (500, 500), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 200: 100, 300: 100, 500: 500}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(near_duplicates(docs)) == want
    assert any(w[2] for w in want)


def test_group_over_many_blocks_and_edges(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100, None), (101, None), (102, ""), (103, " .. "), (104, "one two"), (105, "One, two!"), (None, "one two"), (106, "two one"), (104, "one two")]
    df = spark.createDataFrame([(k, t, "q", 3) for k, t in rows], "doc_id long, text string, th string, n int")
    want = brute(rows)
    assert got(near_duplicates(df, block=8)) == want == got(near_duplicates(df))
    kept = keep_one(df)
    assert kept.columns == df.columns
    left = [r.doc_id for r in kept.collect()]
    roots = {(r.class_id) for r in near_duplicates(df).collect() if r.n_links}
    assert sorted(left) == sorted([*roots, 100, 101, 102, 103, 106, *[k for k, c, n in want if n == 0 and k is not None and k < 100]])
    assert near_duplicates(df.limit(0)).count() == 0 and keep_one(df.where(F.lit(False))).count() == 0


def test_classes_of_one_class_id_each_keep_a_row(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(40))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, text("b") + " more"), (1, text("c")), (2, text("c") + " more"), (1, text("d")), (3, text("d") + " more")]
    left = [(r.doc_id, r.text[0]) for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(left, key=str) == [(1, "c"), (1, "d"), (None, "a"), (None, "b")]


def test_chain_and_dense_group_by_buckets(spark):
    """Components beyond a block are verified by their buckets."""
    rng = random.Random(3)
    w, base = [f"c{i}" for i in range(400)], [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 60])) for i in range(60)]
    rows += [(1000 + i, " ".join([*base[:150], *(f"y{rng.randrange(30)}" for _ in range(8)), *base[150:]])) for i in range(40)]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=8)) == brute(rows)


def test_units_of_a_long_chain(spark):
    """One component of 50,000 classes that hang together in pairs only: units grow with the classes, not with their square."""
    n = 50_000
    i = F.col("id")
    cls = spark.range(n).select(i.alias("node"), F.lit(100).cast("long").alias("n"), F.array(F.floor(i / 2), n + F.floor((i + 1) / 2), 3 * n + i, n * 5 + F.floor(i / 2)).alias("bands"))
    got = units(cls, spark.range(n).select(i.alias("node"), F.lit(0).cast("long").alias("component")), 128)
    sizes = got.groupBy("b", "unit").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks")).cache()
    assert sizes.agg(F.max("n"), F.max("blocks")).first() == (2, 1)
    assert {r.b: r["sum(n)"] for r in sizes.groupBy("b").agg(F.sum("n")).collect()} == {0: n, 1: n - 2}  # the last band has the members of the first


def test_rows_of_one_id_and_text(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(1, text, "B", None), (1, text, "A", 2), (2, text + " more", "C", 1)]
    for data in (rows, rows[::-1]):
        df = spark.createDataFrame(data, "doc_id long, text string, `a.b` string, th int").repartition(3)
        assert [tuple(r) for r in keep_one(df).collect()] == [(1, text, "A", 2)]
