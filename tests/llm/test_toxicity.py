import binascii
import math
import re

import numpy as np
import pyarrow as pa

from tallyforge.llm._bytes import BASE, U, mix
from tallyforge.llm import toxicity as T

DATA = "/root/testdata/sf0.1"


def test_sentences_cover_the_words():
    rows = ["", "One two. Three!\nFour", " .. ", "no end", "a.b.c"]
    found = []
    for i, n, h, own, row, span in T.sentences(pa.array(rows)):
        for s in range(len(row)):
            found.append((i + int(row[s]), int((own == s).sum()), rows[i + row[s]].encode()[span[s][0] : span[s][1]].decode()))
    assert found == [(1, 2, "One two."), (1, 1, " Three!"), (1, 1, "Four"), (3, 2, "no end"), (4, 1, "a."), (4, 1, "b."), (4, 1, "c")]


def test_gradient_of_the_noisy_or():
    """The fit lowers the likelihood's loss to that of a search over the weight of the only word that matters."""
    rng = np.random.default_rng(2)
    bag = np.repeat(np.arange(200), 5)
    y = (np.arange(200) % 4 == 0).astype(int)
    own, word = np.arange(1000), rng.integers(1, 6, 1000)
    word[np.flatnonzero(y)[:, None][:, 0] * 5 + 2] = 0
    w, b = T.fit(own, word, bag, y, np.ones(200), 6)
    assert w[0] > 3 and w[0] > 3 + w[1:].max()
    p = -np.expm1(-np.bincount(bag, np.logaddexp(0, b + w[word])))
    assert ((p >= 0.5) == (y > 0)).all()


def slow_score(model, text):
    """The noisy-or of a text, word by word in plain Python."""
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    left = 1.0
    for sentence in re.findall(rb"[^.!?\n]*[.!?\n]|[^.!?\n]+", text.lower().encode()):
        found = re.findall(rb"[A-Za-z0-9_\x80-\xff]+", sentence)
        if not found:
            continue
        z = model.bias
        own = lambda w: int(mix(np.array([(sum((b + 1) * pow(BASE, i, 2**64) for i, b in enumerate(w)) + len(w)) % 2**64], U))[0])
        for w in found:
            z += weight.get(own(w), 0.0)
            for n in T.STEMS:
                if len(w) > n:
                    z += weight.get(int(mix(np.array([(own(w[:n]) + n) % 2**64], U))[0]), 0.0)
        left *= 1 / (1 + math.exp(z))
    return 1 - left


INSULT = " You are a worthless idiot, they said to the moron."


def test_held_out(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = T.learn(docs, labels)
    rows = T.op7_toxicity(spark, DATA).join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert (r.n_offending > 0) == (r.predicted == 1)
    for r in rows[::40]:
        assert abs(r.score - slow_score(model, r.text)) < 1e-6
    part = lambda held, toxic: [r for r in rows if r.held_out == held and bool(r.toxic) == toxic]
    share = lambda x: sum(r.predicted for r in x) / len(x)
    found = {h: (share(part(h, True)), share(part(h, False))) for h in (False, True)}
    planted = spark.createDataFrame([(r.doc_id, r.text[: len(r.text) // 2] + "." + INSULT + r.text[len(r.text) // 2 :]) for r in part(True, False)], "doc_id long, text string")
    caught = T.score(planted, model).agg({"predicted": "avg"}).first()[0]
    print("recall and false positives, learned and held out:", found, "planted:", caught)
    assert abs(found[True][0] - found[False][0]) <= 0.1 and found[True][0] >= 0.8
    assert found[True][1] <= 0.01 and caught >= 0.95


def test_penalty_is_chosen_on_a_fold():
    """Labels that no word explains are not learned by heart."""
    rng = np.random.default_rng(4)
    n, words = 600, 300
    y = (np.arange(n) % 3 == 0).astype(int)
    own, word = np.repeat(np.arange(n), 3), rng.integers(1, words, 3 * n)
    word[0 :: 9][: n // 5] = 0
    fold = np.arange(n) // 7 % 5
    parts = own, word, np.arange(n), y, np.ones(n)
    w, b = T.tuned(*parts, words, fold)
    by_heart, b0 = T.fit(*parts, words)
    assert np.abs(w[1:]).mean() < 0.5 * np.abs(by_heart[1:]).mean()
    rows, held = T._part(fold != 0, *parts), T._part(fold == 0, *parts)
    assert len(rows[3]) + len(held[3]) == n and len(rows[0]) + len(held[0]) == len(own)


def test_edges(spark):
    data = [(i, ("kind words here. " * 3) + ("you idiot here. " if i % 2 else "you friend here. ") + "more words.", "z") for i in range(80)]
    data += [(200, None, "z"), (201, "", "z"), (None, "you idiot here.", "z"), (202, "...", "z"), (203, "you idiot here.", "z"), (203, "you idiot here.", "z")]
    df = spark.createDataFrame(data, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, "q") for i in range(80)] + [(None, 1, "q"), (5, None, "q"), (1, 0, "q")], "doc_id long, toxic int, text string")
    model = T.learn(df, labels)
    got = {(r.doc_id, r.score >= 0.5): r for r in T.score(df, model).collect()}
    assert (203, True) in got and (None, True) in got and got[(203, True)].offending == [[0, 15]]
    assert all(got[(k, False)].score < 0.5 for k in (200, 201, 202))
    assert got[(1, True)].offending and got[(1, True)].offending[0][0] > 0
    assert T.score(df.limit(0), model).count() == 0
    assert all(r.predicted == 0 for r in T.score(df, T.learn(df, labels.limit(0))).collect())
