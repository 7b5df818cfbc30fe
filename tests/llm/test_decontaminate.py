import re

from tallyforge.llm import decontaminate as D

from ._oracle import oracle, rows

DATA = "/root/testdata/sf0.001"
ITEM = "A train travels from Oslo to Bergen at 80 km per hour and Anna boards it after 3 hours with 80 other people"


def frame(spark, data, key="doc_id"):
    return spark.createDataFrame(data, f"{key} long, text string")


def test_whole_table_against_sql(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    got = D.op6_decontamination(spark, DATA)
    assert rows(got) == oracle(D.SQL, documents=docs, benchmark=bench)
    text = {r.doc_id: " ".join((r.text or "").lower().split()) for r in docs.collect()}
    items = [" ".join(r.text.lower().split()) for r in bench.collect()]
    whole = {k for k, t in text.items() if any(i in t for i in items)}
    bad = {r.doc_id for r in got.collect() if r.contaminated}
    assert whole and whole <= bad and len(bad) < len(text)


START = "Anna has 5 red apples in a basket and gives 2 of them to each of her friends at school"
COUNTS = "compute 12 34 56 78 90 11 13 17 19 23 29 31 37 41"
BENCH = [(1, ITEM), (2, START), (3, "Define entropy"), (4, "What is 5 plus 7"), (5, None), (6, COUNTS), (7, "six words make a short item"), (8, "add 3 4 5 6"), (9, "Mary Ann Smith owes 3 dollars to Tom and Tom owes 3 dollars to a baker")]
#: (doc_id, text, whether it is contaminated).
DOCS = [
    (1, "Intro. " + ITEM.replace("80", "95").replace("Oslo", "Rome").replace("Bergen", "Milan").replace("3", "7.5").replace("Anna", "Peter"), True),
    (2, "x y z " + ITEM.lower(), True),
    (3, ITEM.upper(), True),
    (4, "So it goes. " + START.replace("Anna", "Peter").replace("5", "9"), True),
    (5, "He said.\n DEFINE entropy!\nnow", True),
    (6, "define an entropy", False),
    (7, "what is five plus 7?", False),
    (8, "what is 5 plus 7?\n", True),
    (9, START.replace("red", "green").replace("gives", "sells"), False),
    (10, ITEM.replace("3 hours", "three hours").replace("80", "two"), True),
    (11, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", False),
    (12, "compute 1 2 3 4 5 6 7 8 9 10 11 12 13 14", False),
    (13, "So " + COUNTS, True),
    (14, "add 7 8 9 10", False),
    (15, "now add 3 4 5 6 up", True),
    (16, "we say: six words make a short item indeed", True),
    (17, "John owes 4 dollars to Ann Lee Fox and Ann Lee Fox owes 4 dollars to a baker", True),
    (18, "John owes 4 dollars to Ann and Ann owes 5 dollars to a baker", False),  # the item's equal numbers differ
    (19, "Ann owes 4 dollars to Ann and Ann owes 4 dollars to a baker", False),  # the item's two people are one
    (20, None, False),
    (21, "", False),
    (None, ITEM, True),
    (1, "another row of the same id", False),
    (22, ITEM, True),
    (22, ITEM, True),
]


def test_cases(spark):
    bench, docs = frame(spark, BENCH, "item_id"), frame(spark, [x[:2] for x in DOCS])
    got = D.contaminated(docs, bench)
    assert rows(got) == oracle(D.SQL, documents=docs, benchmark=bench)
    assert sorted(((r.doc_id, r.contaminated) for r in got.collect()), key=str) == sorted(((k, c) for k, _, c in DOCS), key=str)
    kept = D.drop_contaminated(docs, bench)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _, c in DOCS if not c), key=str)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    bench, docs = frame(spark, BENCH, "item_id"), frame(spark, [x[:2] for x in DOCS])
    assert rows(D.contaminated(docs, bench)) == oracle(D.SQL, documents=docs, benchmark=bench)


def test_every_window_holds_a_gram():
    for n in range(D.LEAST, D.WINDOW + 1):
        k, step = D.gram(n)
        assert all(any(s <= p and p + k <= s + n for p in range(0, s + n, step)) for s in range(3 * step))


def test_empty_tables_and_odd_names(spark):
    docs, bench = frame(spark, [(1, ITEM)]), frame(spark, [(1, ITEM)], "item_id")
    assert D.contaminated(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in D.contaminated(docs, bench.limit(0)).collect()] == [False]
    odd = spark.createDataFrame([(1, ITEM, 1, 2), (2, "x", 3, 4)], "doc_id long, text string, `a.b` int, TEXT int")
    assert [tuple(r) for r in D.drop_contaminated(odd, bench).collect()] == [(2, "x", 3, 4)]


def test_readings_share_their_first_steps(spark):
    """Both readings begin alike: those patterns stand in the plan once, and number words are told by their letters."""
    text = "Twenty-one of 3.5 Sixty men, sixteen, seventy seven km; Two Hundred hundreds"
    d = spark.createDataFrame([(1, 1, text), (2, 2, None)], "doc_id long, th long, text string")
    both = D.readings(d, [D.PLAIN, D.NAMED])
    assert both._jdf.queryExecution().optimizedPlan().toString().count("[.,](?=[0-9])") == 1
    plain, named = both.where("doc_id = 1").select("m0", "m1").first()
    assert plain == "\x02twenty one of \x0235 \x02sixty men \x02sixteen \x02seventy \x02seven \x03km \x02two \x02hundred hundreds"
    assert named == "\x01twenty one of \x0235 \x01sixty men \x02sixteen \x02seventy \x02seven \x03km \x01two\x04hundred hundreds"
    assert all(re.fullmatch(D.alternatives(list(D.NUMBERS)), w) for w in D.NUMBERS)
