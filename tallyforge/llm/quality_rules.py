"""Quality rules: base counts, and divergence from language references (operator 9). DataFrame functions only.

Each text gets two histograms: of character classes, and of its language's most common words (with one bin for all
others). The reference of a language is the sum of the histograms of all its documents that the base keeps. A document is
rejected if the base fails it, or if it has at least ``MIN_WORDS`` words and the Jensen-Shannon distance (base 2)
of either histogram from its language's reference is beyond the limit. The limit of the words is set by the reference: a share
of the distance that a text without any common word has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut, only, table

#: The commonest words of each language.
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "ein"),
    "en": ("the", "of", "and", "to", "in", "is", "that", "by", "for", "with", "are", "it"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "por", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "du"),
}
BINS = 12
CHARS = ("c_lower", "c_upper", "c_digit", "c_space", "n_symbols", "c_wide", "c_other")
WORDS = tuple(f"w_{i}" for i in range(BINS)) + ("w_rest",)
MIN_WORDS = 50
CHAR_LIMIT = 0.27
WORD_LIMIT = 0.9
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body).getItem(0)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 5-word window found twice or more."""

    def flagged(s: Column) -> Column:
        twin = lambda e, k: e["h"].eqNullSafe(F.get(s, k - 1)["h"]) | e["h"].eqNullSafe(F.get(s, k + 1)["h"])
        at = F.sort_array(F.transform(F.filter(s, twin), lambda e: e["i"]))
        covered = lambda r: F.aggregate(F.transform(r, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(r, k + 1) - p, F.lit(5)))), F.lit(0), lambda a, b: a + b)
        return let(at, covered)

    def counted(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, flagged))

    window = F.transform(words, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, 5)]))
    return F.when(F.size(words) < 6, F.lit(0)).otherwise(let(F.slice(window, 1, F.greatest(F.size(words) - 4, F.lit(0))), counted))


def left_length(text: Column, pattern: str) -> Column:
    """Code points that stay when the pattern's matches go."""
    return F.length(F.regexp_replace(text, pattern, ""))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base's counts and both histograms of every row."""
    t = F.coalesce(F.col("text"), F.lit(""))
    every = sorted({w for x in COMMON.values() for w in x})

    def of_words(w: Column) -> Column:
        hits = F.concat(F.lit(" "), F.array_join(F.filter(w, lambda x: x.isin(*every)), "  "), F.lit(" "))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
            hits.alias("hits"),
        )

    d = only(docs, "doc_id", "text", "lang").select("doc_id", "lang", t.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "doc_id",
        "lang",
        let(F.filter(F.split("t", GAP), lambda x: x != ""), of_words).alias("f"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        left_length(F.col("t"), r"[^#*$%&|<>]+").cast("long").alias("n_symbols"),
        left_length(F.col("t"), "[^a-z]+").cast("long").alias("c_lower"),
        left_length(F.col("t"), "[^A-Z]+").cast("long").alias("c_upper"),
        left_length(F.col("t"), "[^0-9]+").cast("long").alias("c_digit"),
        left_length(F.col("t"), r"[\x00-\x7F]+").cast("long").alias("c_wide"),
        F.length("t").cast("long").alias("n_all"),
    )
    d = d.select("*", "f.n_words", "f.word_chars", "f.n_repeat_words", "f.hits").drop("f")
    d = d.withColumn("c_space", F.col("n_all") - F.col("word_chars"))
    d = d.withColumn("c_other", F.col("n_all") - reduce(lambda a, b: a + b, [F.col(c) for c in CHARS if c != "c_other"]))
    lists = F.create_map(*[x for lang in COMMON for x in (F.lit(lang), F.array(*[F.lit(f" {w} ") for w in COMMON[lang]]))])
    none = F.array_repeat(F.lit(0).cast("long"), BINS)
    bins = F.transform(F.try_element_at(lists, F.col("lang")), lambda w: ((F.length("hits") - F.length(F.replace(F.col("hits"), w, F.lit("")))) / F.length(w)).cast("long"))
    d = d.withColumn("bins", F.coalesce(bins, none))
    d = d.select("*", *[F.col("bins")[i].alias(f"w_{i}") for i in range(BINS)])
    d = d.withColumn("w_rest", F.col("n_words") - reduce(lambda a, b: a + b, [F.col(f"w_{i}") for i in range(BINS)]))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("hits", "n_all", "bins")


def distance(columns: tuple[str, ...]) -> Column:
    """Jensen-Shannon distance of counts from the reference sums ``r_...``; null where either is empty."""
    total, ref = (reduce(lambda a, b: a + b, [F.col(p + c) for c in columns]) for p in ("", "r_"))

    def pair(p: Column, q: Column) -> Column:
        half = lambda x: F.when(x > 0, 0.5 * x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
        return half(p) + half(q)

    shares = lambda prefix, t: let(t, lambda t: F.transform(F.array(*[F.col(prefix + c) for c in columns]), lambda x: x / t))
    parts = F.zip_with(shares("", total), shares("r_", ref), pair)
    found = F.round(F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))), 9)
    return F.when((total > 0) & (ref > 0), found)


def without_common_words() -> Column:
    """The distance of a text without a common word from the reference, in which they have the share s."""
    ref = reduce(lambda a, b: a + b, [F.col("r_" + c) for c in WORDS])

    def of(s: Column) -> Column:
        rest = 1 - s
        return F.sqrt(0.5 * (F.log2(2 / (1 + rest)) + s + F.when(rest > 0, rest * F.log2(2 * rest / (1 + rest))).otherwise(0.0)))

    return F.when(ref > 0, let(1 - F.col("r_w_rest") / ref, of))


def judge(docs: DataFrame, min_words: int = MIN_WORDS, char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_js, word_js of every row.

    ``char_limit`` is a distance, ``word_limit`` a share of the distance of a text without common words.
    Null text is empty: 0 words, so the base fails it. A row whose lang is null or has no list of common words has
    null distances and is judged by the base alone, as are rows under ``min_words`` words. Repeated rows get equal
    results. An empty table gives no rows.
    """
    f = cut(features(docs))
    fit = f.where(~F.col("base_failed") & F.col("lang").isin(*COMMON))
    ref = fit.groupBy(F.col("lang").alias("r_lang")).agg(*[F.sum(c).alias(f"r_{c}") for c in CHARS + WORDS])
    d = f.join(F.broadcast(ref), f["lang"] == ref["r_lang"], "left")  # a row for each language of COMMON at most
    d = d.withColumn("char_js", distance(CHARS)).withColumn("word_js", distance(WORDS)).withColumn("most", word_limit * without_common_words())
    strange = (F.col("n_words") >= min_words) & (F.coalesce(F.col("char_js") > char_limit, F.lit(False)) | F.coalesce(F.col("word_js") > F.col("most"), F.lit(False)))
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~strange).alias("kept"), F.round("char_js", 6).alias("char_js"), F.round("word_js", 6).alias("word_js")
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Operator 9 over all documents."""
    return judge(table(spark, sf_dir, "documents"))


def _sql() -> str:
    space = r"[\x20\x09-\x0D]"
    case = lambda i: "CASE lang " + " ".join(f"WHEN '{x}' THEN '{COMMON[x][i]}'" for x in COMMON) + " END"
    bins = ", ".join(f"coalesce(len(list_filter(words, lambda w: w = {case(i)})), 0)::BIGINT AS w_{i}" for i in range(BINS))
    rest = " - ".join(["n_words", *(f"w_{i}" for i in range(BINS))])
    other = " - ".join(["length(t)", *(c for c in CHARS if c != "c_other")])

    def js(columns: tuple[str, ...]) -> str:
        total, ref = "(" + " + ".join(columns) + ")", "(" + " + ".join(f"r_{c}" for c in columns) + ")"
        out = []
        for c in columns:
            p, q = f"({c}::DOUBLE / {total})", f"(r_{c}::DOUBLE / {ref})"
            half = lambda x, p=p, q=q: f"(CASE WHEN {x} > 0 THEN 0.5 * {x} * log2(2 * {x} / ({p} + {q})) ELSE 0.0 END)"
            out.append(f"({half(p)} + {half(q)})")
        return f"CASE WHEN {total} > 0 AND {ref} > 0 THEN round(sqrt(greatest({' + '.join(out)}, 0.0)), 9) END"

    total = "(" + " + ".join(f"r_{c}" for c in WORDS) + ")"
    none = "sqrt(0.5 * (log2(2 / (2 - s)) + s + CASE WHEN s < 1 THEN (1 - s) * log2(2 * (1 - s) / (2 - s)) ELSE 0 END))"
    sums = ", ".join(f"sum({c})::DOUBLE AS r_{c}" for c in CHARS + WORDS)
    gone = lambda p: f"length(regexp_replace(t, '{p}', '', 'g'))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
twin AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + j) AS n FROM twin, unnest(range(0, 5)) AS v(j) GROUP BY rid),
f AS (SELECT rid, doc_id, lang, t, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    {gone('[^#*$%&|<>]+')} AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, {gone('[^a-z]+')} AS c_lower, {gone('[^A-Z]+')} AS c_upper,
    {gone('[^0-9]+')} AS c_digit, {gone('[\\x00-\\x7F]+')} AS c_wide, {bins} FROM w LEFT JOIN rep USING (rid)),
g AS (SELECT *, length(t) - word_chars AS c_space, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {rest} AS w_rest FROM f),
h AS (SELECT *, {other} AS c_other FROM g),
r AS (SELECT lang AS r_lang, {sums} FROM h WHERE NOT base_failed AND lang IN ({", ".join(f"'{x}'" for x in COMMON)}) GROUP BY lang),
j AS (SELECT h.*, {js(CHARS)} AS char_js, {js(WORDS)} AS word_js, CASE WHEN {total} > 0 THEN 1 - r_w_rest / {total} END AS s FROM h LEFT JOIN r ON h.lang = r.r_lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND (coalesce(char_js, 0) > {CHAR_LIMIT} OR coalesce(word_js > {WORD_LIMIT} * {none}, false))) AS kept,
    round(char_js, 6) AS char_js, round(word_js, 6) AS word_js
FROM j
"""


SQL = _sql()
