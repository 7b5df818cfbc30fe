import hashlib
import random

import numpy as np

from tallyforge.llm.suffix import common_prefixes, find, packed, suffix_array
from tallyforge.llm.suffix_dedup import judge, repeated_spans

DATA = "/root/testdata/sf0.001"


def brute(rows, length=100):
    docs = [(k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in sorted(docs, key=lambda x: -(2**63) if x[0] is None else x[0]):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], (k, p))
    out = []
    for k, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] != (k, p):
                gone[p : p + length] = b"\1" * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r)[:5] for r in df.collect()], key=str)


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for trial in range(40):
        b = bytes(rng.choice(b"ab" if trial % 2 else b"abcdefg\0") for _ in range(rng.randint(1, 300))) * rng.choice([1, 3])
        text = np.frombuffer(b, np.uint8)
        sa, rank = suffix_array(text)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        for wanted in (np.ones(len(b), bool), np.array([rng.random() < 0.7 for _ in b])):
            order, lcp = common_prefixes(text, sa, wanted, lanes=3)
            assert order.tolist() == [i for i in sa if wanted[i]]
            for r in range(1, len(order)):
                x, y, c = b[order[r] :], b[order[r - 1] :], 0
                while c < min(len(x), len(y)) and x[c] == y[c]:
                    c += 1
                assert lcp[r] == c


def test_binary_search_merges_shards():
    rng = random.Random(2)
    pool = [bytes(rng.choice(b"xyz") for _ in range(20)) for _ in range(30)]
    a, b = b"".join(sorted(set(pool[:20]))), b"".join(pool[10:])
    heads = np.arange(0, len(a), 20)
    hit = find(packed(np.frombuffer(a, np.uint8)), heads, packed(np.frombuffer(b, np.uint8)), np.arange(0, len(b), 20), 20)
    for i, h in enumerate(hit):
        s = b[20 * i : 20 * i + 20]
        assert (a[20 * h : 20 * h + 20] == s) if h >= 0 else s not in pool[:20]


def test_split_anchor_agrees_with_one_shard():
    rng = random.Random(3)
    core = bytes(rng.choice(b"abcd") for _ in range(60))
    segs = [bytes(rng.choice(b"ab") for _ in range(3)) + core + bytes(rng.choice(b"ab") for _ in range(4)) for _ in range(300)]
    k, lo, n = np.arange(300), np.zeros(300, np.int64), np.array([len(s) - 62 + 1 for s in segs])
    runs = [{(int(x), p) for x, _, a, b in zip(*judge(segs, k, k, lo, n, 62, shard)) for p in range(a, b + 1)} for shard in (1 << 20, 400)]
    assert runs[0] == runs[1] and runs[0]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(repeated_spans(docs)) == want
    assert sum(w[2] for w in want) > 0
    assert got(repeated_spans(docs, hot=2, shard=2000)) == want


def test_edges(spark):
    rng = random.Random(4)
    p = "".join(rng.choice("abc é") for _ in range(150))
    rows = [(5, p), (3, "x" + p + "y" + p), (None, p[:120]), (9, None), (1, ""), (7, "z" * 700), (8, "z" * 99), (11, p + p[:30]), (12, "short")]
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id long, text string, h string, k int")
    assert got(repeated_spans(df)) == brute(rows)
    assert repeated_spans(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(5, p), (5, p), (6, p)], "doc_id long, text string")
    assert [r[2] for r in got(repeated_spans(twice))] == [0, 0, len(p.encode())]


def test_many_texts_without_id(spark):
    """Texts that share an id (or have none) keep their own spans."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    p, q = word(180), word(140)
    rows = [(None, f"{word(90)}{p if i % 3 else q}{word(40)}") for i in range(30)] + [(4, p + word(50)), (4, word(130) + q), (4, q + word(9)), (9, p), (9, p), (2, word(30) + q)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"hot": 2, "shard": 500}):
        assert got(repeated_spans(df, **how)) == brute(rows)
