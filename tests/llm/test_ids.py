"""Ids of every type: what an operator returns for whole numbers, small ones and texts is the same."""

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import jaccard_join, language_id, license_scan, quality_rules, secret_scan, sentencepiece_codec, suffix_dedup, tensor_minhash, toxicity

DATA = "/root/testdata/sf0.001"
KINDS = {"int": lambda c: c.cast("int"), "string": lambda c: F.lpad(c.cast("string"), 9, "0")}


def scored(docs):
    rows = docs.select("doc_id", F.pmod(F.octet_length("text"), F.lit(3)).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.learn(docs, rows)).select("doc_id", F.col("predicted").isNotNull().alias("judged"))  # the fit's folds follow the ids


OPERATORS = {
    "op1": lambda d: license_scan.scan(d),
    "op2": lambda d: sentencepiece_codec.encode_texts(d, keep_ids=False),
    "op2 back": lambda d: sentencepiece_codec.decode_ids(sentencepiece_codec.encode_texts(d)),
    "op3": lambda d: language_id.identify(d, language_id.learn(d)).select("doc_id", "lang_pred"),
    "op5": lambda d: jaccard_join.near_duplicates(d),
    "op5 kept": lambda d: jaccard_join.keep_one(d).select("doc_id", "text"),
    "op7": scored,
    "op8": lambda d: suffix_dedup.repeated_spans(d),
    "op9": lambda d: quality_rules.judge(d).select("doc_id", "n_words", "kept"),
    "op10": lambda d: secret_scan.scan(d),
    "op13": lambda d: tensor_minhash.near_duplicates(d),
}


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 30").select("doc_id", "text", "lang")
    again = d.where("doc_id < 8").withColumn("doc_id", F.col("doc_id") + 1000)
    return d.unionByName(again).cache()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_types_of_ids(docs, name):
    f = OPERATORS[name]
    plain = lambda df: sorted([[str(r[c] if c not in ids else int(r[c])) for c in sorted(df.columns)] for r in df.collect()])
    first = f(docs)
    ids = [c for c in ("doc_id", "class_id", "component_id") if c in first.columns]
    want = plain(first)
    for kind, cast in KINDS.items():
        got = f(docs.withColumn("doc_id", cast(F.col("doc_id"))))
        assert {dict(got.dtypes)[c] for c in ids} == {kind}
        assert plain(got) == want


def test_the_largest_id_stays(spark):
    top = 2**63 - 1
    df = spark.createDataFrame([(top, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l")], "doc_id long, text string")
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.near_duplicates(df).collect()], key=str)
    assert got == sorted([(top, top, 1), (None, top, 1), (None, None, 0)], key=str)
    assert sorted([(r.doc_id, r.text) for r in jaccard_join.keep_one(df).collect()], key=str) == sorted([(top, "a b c d e f"), (None, "g h i j k l")], key=str)
