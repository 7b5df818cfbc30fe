import random
import re
from collections import Counter

from tallyforge.llm import quality_rules as Q

from ._oracle import oracle, rows

DATA = "/root/testdata/sf0.001"


def slow(text):
    """The base in Python."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def base(df):
    return [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect()]


def test_whole_table_against_python_and_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = Q.judge(docs)
    want = {r.doc_id: slow(r.text) for r in docs.collect()}
    assert dict(base(got)) == want
    assert rows(got) == oracle(Q.SQL, documents=docs)
    assert 0.5 < sum(r.kept for r in got.collect()) / len(want) < 1


def test_edges(spark):
    texts = [None, "", "   ", "a b c d e " * 3, "a\nb\na\n \n a\n", "é ü x", "one two three four five one two three four five six", "x " * 9, "#*$%&|<>" * 20 + " w" * 60]
    data = [(i if i else None, t, lang, 1) for i, (t, lang) in enumerate(zip(texts, ["en", None, "xx", "en", "de", "fr", "en", "es", "en"]))]
    data += [data[3], (3, "other text", "en", 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, n_words int")
    assert sorted(base(Q.judge(df)), key=str) == sorted([(k, slow(t)) for k, t, _, _ in data], key=str)
    assert Q.judge(df.limit(0)).count() == 0


def test_strange_characters_are_rejected(spark):
    plain = "the cat of the house and that dog is in the garden by a tree with milk for it " * 1
    data = [(i, " ".join(f"{w}x{j}" if j % 3 == 0 else w for j, w in enumerate(plain.split() * 4)) + f" n{i}", "en") for i in range(30)]
    words = [" ".join(f"word{a}" for a in range(60))]
    data += [(100, " ".join(f"@~^={a}" for a in range(80)), "en"), (101, words[0], "xx")]
    got = {r.doc_id: r for r in Q.judge(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not got[100].kept and got[101].kept and got[101].char_js is None


def test_word_salad_and_wrong_language_are_rejected(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdefglmnoprstu") for _ in range(rng.randint(3, 8)))
    text = lambda common: " ".join(rng.choice(common) if rng.random() < 0.25 else word() for _ in range(160))
    data = [(i, text(Q.COMMON[lang]), lang) for i, lang in enumerate(["en", "de"] * 40)]
    data += [(100, " ".join(word() for _ in range(160)), "en"), (101, text(Q.COMMON["de"][:2]), "en"), (102, " ".join(word() for _ in range(40)), "en")]
    got = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert not got[100] and not got[101] and got[102] and all(got[i] for i in range(80))
