"""All operators on very long texts, repeated rows, nulls in every column, and further columns with clashing names."""

import random

import pytest

import corpus_pipeline
from tallyforge.llm import registry

NAMES = [n for n in registry.QUERIES]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    long = [
        " ".join(word() for _ in range(150_000)),
        "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(400_000)),
        "the same words again. " * 20_000,
        " " * 200_000 + "x",
        "\n" * 50_000 + "token = abcdefgh12345\n" * 50,
        "日本語の文章。" * 20_000,
        "a" * 60_000,
    ]
    rows = [(i, f"some words of row {i} and the others of it are here. " * 3, "en", f"s{i % 3}", 9) for i in range(40)]
    rows += [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(long)]
    rows += [(None, None, None, None, None), (None, "no id here", None, None, None), (7, rows[7][1], "en", "s1", 9), (200, None, "en", None, 1), (201, "", None, "s", None)]
    path = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, `class` boolean")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "a passage of the benchmark that no document has in it", 0), (None, None, None)], "item_id long, text string, doc_id int").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(40)] + [(None, None, None, None)], "doc_id long, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "http://a.example.com/" + "x" * 100_000, "h", "p"), (None, None, None, None), (1, "http://" + "h" * 100_000, "", "")], "page_id long, url string, host string, path string").write.parquet(f"{path}/pages.parquet")
    vectors = [(i, [float(i % 5)] * 64, i % 2, "x") for i in range(50)] + [(None, [1.0] * 64, None, None), (7, [2.0] * 64, 1, "x"), (8, None, 1, "x"), (9, [None] * 64, 1, "x"), (10, [float("nan")] * 64, 1, "x"), (11, [], 1, "x")]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int, code string").write.parquet(f"{path}/embeddings.parquet")
    return str(path), len(rows)


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, name):
    path, n = odd
    got = registry.QUERIES[name](spark, path).collect()
    assert len(got) == (3 if name.startswith("op4_") else 52 if name.startswith(("op11_", "op12_")) else n)


def test_pipeline_on_odd_tables(spark, odd):
    path, n = odd
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert 0 < corpus_pipeline.run(spark, path).count() < n
