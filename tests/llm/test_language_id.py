import binascii

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyforge.llm.language_id import Filters, grams, identify, learn, op3_language_id

DATA = "/root/testdata/sf0.01"


def slow_grams(text):
    """4-byte n-grams of a text in Python."""
    t = f" {text} ".lower().encode()
    t = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in t)
    out = bytearray()
    for b in t:
        if not (b == 32 and out[-1:] == b" "):
            out.append(b)
    return [int.from_bytes(out[i : i + 4], "big") for i in range(len(out) - 3)]


def test_grams_against_python():
    rows = ["", "a", "Hello,  World!", "é--É 42x", " .. ", "abc" * 50, "\n\n"]
    for i, n, g, first in grams(pa.array(rows)):
        assert [g[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [slow_grams(r) for r in rows[i : i + n]]


def test_one_lookup_answers_for_all_languages():
    rng = np.random.default_rng(1)
    sets = {f"l{k:02d}": set(rng.integers(0, 2**32, 500).tolist()) for k in range(70)}
    shared = int(rng.integers(0, 2**32))
    for k in ("l03", "l66"):
        sets[k].add(shared)
    f = Filters.build([(k, g) for k, s in sets.items() for g in s], "l00")
    assert f.planes.shape[0] == 2
    first = np.array([0, 1])
    got = f.counts(np.array([shared], np.uint32), first)[0]
    assert got[f.langs.index("l03")] == got[f.langs.index("l66")] == 1
    for k in ("l00", "l69"):
        g = np.array(sorted(sets[k]), np.uint32)
        c = f.counts(g, np.array([0, len(g)]))[0]
        assert c[f.langs.index(k)] == len(g) and np.median(c) < 20


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = op3_language_id(spark, DATA).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_edges(spark):
    base = [(i, t * 20, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("le chat et le chien ", "fr")] * 12)]
    odd = [(100, None, "en", "y"), (101, "", "en", "y"), (102, "12 !? 34", "fr", "y"), (None, "the cat and the dog", None, "y"), (104, "жук", None, "y"), (0, "the cat and the dog ", "en", "x")]
    df = spark.createDataFrame(base + odd, "doc_id long, text string, lang string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred) for r in identify(df, learn(df)).where("doc_id is null or doc_id >= 100").collect()), key=str)
    assert got == [(100, "und"), (101, "und"), (102, "und"), (104, "en"), (None, "en")] or got[3][1] in ("en", "fr")
    assert identify(df.limit(0), learn(df)).count() == 0
    none = identify(df, learn(df.withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_predictions_against_exact_sets(spark):
    """The filters answer as exact sets of n-grams do, but for texts whose two best languages are as good as even."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    filters = learn(docs)
    seen = {}
    keep = Filters.build
    try:
        Filters.build = classmethod(lambda cls, found, common: seen.update(found=found) or keep(found, common))
        learn(docs)
    finally:
        Filters.build = keep
    sets = {lang: {g for x, g in seen["found"] if x == lang} for lang in filters.langs}
    rows = docs.select("text").collect()[::7]
    names, scores = filters.predict(pa.array([r.text or "" for r in rows]))
    for r, name, score in zip(rows, names, scores):
        g = slow_grams(r.text or "")
        if not any(c.isalpha() for c in r.text or ""):
            assert name == "und" and score == 0
            continue
        share = {lang: sum(x in s for x in g) / max(len(g), 1) for lang, s in sets.items()}
        best = max(sorted(share), key=lambda x: share[x])
        assert abs(share[best] - score) < 0.02
        assert name == best or share[best] - share[name] < 0.02


def test_columns_stay(spark):
    from tallyforge.llm.language_id import of_known_language

    base = [(i, t * 20, lang, "MINE", i) for i, (t, lang) in enumerate([("the cat and the dog ", "en"), ("le chat et le chien ", "fr")] * 12)] + [(99, "12 34", None, "MINE", 1)]
    df = spark.createDataFrame(base, "doc_id long, text string, lang string, lang_pred string, `a.b` int")
    got = of_known_language(df, learn(df), 0.3)
    assert got.columns == df.columns and got.count() == 24 and {r.lang_pred for r in got.collect()} == {"MINE"}
    assert identify(df, learn(df)).columns == ["doc_id", "text", "lang", "a.b", "lang_pred", "lang_score"]
