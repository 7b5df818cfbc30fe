import hashlib
import itertools
import random
import tracemalloc

import numpy as np
import pytest

from tallyforge.llm._spark import slabs
from tallyforge.llm.sentencepiece_codec import BLOCK, MODEL, SLAB, Vocabulary, decode, decode_ids, encode, encode_texts, nbest, vocabulary


@pytest.fixture(scope="module")
def tiny():
    letters = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "cab", "ca"]
    pieces = letters + [""] * 256
    scores = np.array([-int(1e6 * (2 + (i * 7 % 5))) for i in range(len(letters))] + [0] * 256)
    return Vocabulary(pieces, scores, np.arange(len(letters), len(pieces)))


def every(vocab, text):
    """All segmentations by enumeration of the cuts."""
    marked = "▁" + text.replace(" ", "▁")
    out = []
    for cuts in itertools.product([0, 1], repeat=len(marked) - 1):
        parts, last = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(marked[last:i])
                last = i
        parts.append(marked[last:])
        total, ok = 0, True
        for p in parts:
            if p in vocab.ids:
                total += int(vocab.scores[vocab.ids[p]])
            elif len(p) == 1:
                total += vocab.byte_score * len(p.encode())
            else:
                ok = False
        if ok:
            out.append(total)
    return sorted(out, reverse=True)


def check_best(vocab, e, row, text):
    """The n best are different segmentations of the text, each with its own score."""
    found = e.best(row)
    assert found[0].tolist() == e.ids[e.at[row] : e.at[row + 1]].tolist()
    assert len({tuple(x.tolist()) for x in found}) == len(found) == len(e.nbest[row])
    of_byte = {int(i): vocab.byte_score for i in vocab.byte_ids}
    for ids, (score, _) in zip(found, e.nbest[row]):
        assert decode(vocab, ids, np.array([0, len(ids)])) == [text.encode()]
        assert sum(of_byte.get(i, int(vocab.scores[i])) for i in ids.tolist()) == score


def test_nbest_against_all_segmentations(tiny):
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice("abc bé\n") for _ in range(rng.randint(1, 9)))
        want = every(tiny, text)
        got = nbest(tiny, text, 6)
        assert [s for s, _ in got] == want[:6]
        assert len({ids for _, ids in got}) == len(got)
        e = encode(tiny, ["", text, "ab"], best=4)
        assert [s for s, _ in e.nbest[1]] == want[:4] and e.nbest[0] == [] == e.best(0) and e.score[1] == want[0]
        ids = e.ids[e.at[1] : e.at[2]]
        assert tuple(ids) in {x for s, x in nbest(tiny, text, 40) if s == want[0]}
        check_best(tiny, e, 1, text)
        assert decode(tiny, e.ids, e.at) == [b"", text.encode(), b"ab"]


def test_round_trip_of_odd_texts():
    v = vocabulary(MODEL)
    rows = ["", " ", "  two  spaces ", "▁literal ▁▁", "tab\tand\nline\r\n", "naïve 日本語 😀 \u0000 \U0010ffff", "x" * 5000, " " * 300, "ab" * 400 + "▁"]
    e = encode(v, rows)
    assert decode(v, e.ids, e.at) == [r.encode() for r in rows]
    for r, got, s in zip(rows, e.nbest, e.score):
        if 0 < len(r) < 40:
            assert [x for x, _ in got] == [x for x, _ in nbest(v, r, 3)] and got[0][0] == s
    for i, r in enumerate(rows):
        if r:
            check_best(v, e, i, r)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coded = encode_texts(docs).cache()
    got = coded.collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    v = vocabulary(MODEL)
    text = {r.doc_id: r.text for r in docs.collect()}
    got.sort(key=lambda r: r.n_ids)
    for r in [*got[::12], got[-1]]:  # short and long ones, by search over the whole lattice
        want = [s / 1e6 for s, _ in nbest(v, text[r.doc_id], 3)]
        assert list(r.nbest) == want and r.score == want[0]
    for r in got:
        assert [hashlib.sha256(np.array(x, np.int32).tobytes()).hexdigest() for x in r.nbest_ids] == r.nbest_sha256 and r.nbest_ids[:1] == ([r.ids] if r.ids else [])
    assert {r.doc_id: r.text for r in decode_ids(coded).collect()} == text


def test_chunks_of_one_hash(tiny, monkeypatch):
    """Chunks whose hashes collide are told apart."""
    from tallyforge.llm import sentencepiece_codec as S

    rows = ["ab ca bc", "cab abc", "ca"]
    want = encode(tiny, rows)
    real = np.unique
    monkeypatch.setattr(S.np, "unique", lambda x, **k: real(x % S.U(3), **k) if x.dtype == S.U else real(x, **k))
    got = encode(tiny, rows)
    assert got.ids.tolist() == want.ids.tolist() and got.score.tolist() == want.score.tolist()


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 2), (None, "", 3), (5, "hé " * 3, 4), (5, "hé " * 3, 4)], "doc_id long, text string, n_ids int")
    rows = encode_texts(df).collect()
    assert sorted((r.n_ids > 0 for r in rows)) == [False, False, True, True] and all(r.round_trip for r in rows)
    assert encode_texts(df.limit(0)).count() == 0


def test_memory_of_a_slab_is_bounded(monkeypatch):
    """A worker keeps what a slab takes beside the executor's heap; the block's size changes no result."""
    r = random.Random(5)
    rows = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randrange(3, 12))) for _ in range(300)) for _ in range(1000)]
    vocab = vocabulary()
    tracemalloc.start()
    got = [encode(vocab, rows[i:j]) for i, j in slabs([len(x) for x in rows], SLAB)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    monkeypatch.setattr("tallyforge.llm.sentencepiece_codec.BLOCK", 4 * BLOCK)
    other = encode(vocab, rows)
    assert np.concatenate([x.ids for x in got]).tolist() == other.ids.tolist()
    assert [x for g in got for x in g.nbest] == other.nbest
