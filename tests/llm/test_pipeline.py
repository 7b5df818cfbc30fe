import re

import corpus_pipeline as P
from tallyforge.llm.secret_scan import base_spans
from tallyforge.llm.sentencepiece_codec import MODEL, decode, vocabulary

from .test_jaccard_join import brute

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    plain = next(r.text for r in docs.orderBy("doc_id").collect() if 300 < len(r.text) < 900)
    odd = plain.replace(" ", " api_key: 0123456789abcdef ", 1) + " unlike the other text by some words of its own here and there, so it is no copy of it " * 2
    docs = docs.unionByName(spark.createDataFrame([(900001, odd, "en", "srcX", len(odd)), (900002, None, None, None, None)], docs.schema))
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    seen = [docs]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, seen[-1], DATA)
        assert out.columns == docs.columns, name
        seen.append(out.cache())
    text = [{r.doc_id: r.text for r in d.collect()} for d in seen]
    lost = set(text[0]) - set(text[1])
    assert len(lost) < 0.05 * len(text[0])
    want = {c for _, c, _ in brute(list(text[1].items()))}
    assert set(text[2]) == want and len(want) < len(text[1])
    words = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    leaks = {k for k, t in text[2].items() if any(words(b) in words(t) for b in bench)}
    gone = set(text[2]) - set(text[3])
    assert leaks and leaks <= gone
    assert set(text[4]) == set(text[3])
    changed = {k for k in text[3] if text[3][k] != text[4][k]}
    assert changed == {k for k, t in text[3].items() if base_spans(t)} and changed
    assert all(not base_spans(t) and r.n_chars == len(t) for r in seen[4].collect() for t in [r.text])
    v = vocabulary(MODEL)
    import numpy as np

    for r in P.STAGES[-1][1](spark, seen[-1], DATA).collect():
        ids = np.array(r.ids, np.int32)
        assert decode(v, ids, np.array([0, len(ids)])) == [text[4][r.doc_id].encode()] and r.round_trip


def test_run_and_empty(spark, tmp_path):
    got = P.run(spark, DATA)
    assert 0 < got.count() < 200
    for t in ("documents", "benchmark"):
        df = spark.read.parquet(f"{DATA}/{t}.parquet")
        df.limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_any_columns(spark):
    """Names with dots, and names that stages use themselves; the session keeps its settings."""
    text = lambda x: " ".join(f"the {x} house and the garden of the {x}{i}" for i in range(12))
    rows = [(i, text(f"w{i}"), "en", "s", 1, "MINE", 0.5, i) for i in range(20)] + [(50, text("w3"), "en", "s", 1, "MINE", 0.5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score double, `a.b` int")
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    got = docs
    for name, stage in P.STAGES[:-1]:
        got = stage(spark, got, DATA)
        assert got.columns == docs.columns, name
    assert sorted((r.doc_id, r.lang_pred, r["a.b"]) for r in got.collect()) == [(i, "MINE", i) for i in range(20)]
    after = {r.key: r.value for r in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if k != "spark.checkpoint.dir"} == {k: v for k, v in before.items() if k != "spark.checkpoint.dir"}
