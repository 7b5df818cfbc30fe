r"""Benchmark decontamination by template windows (operator 6). DataFrame functions only.

A text is read twice as a list of lower-case words with typed slots: as ``PLAIN``, numbers (digits and number words) and
units (the word after a number) are slots, so that letter case does not matter; as ``NAMED``, each run of capitalised words is a slot
too. A window is ``WINDOW`` words; its template has each slot's type in place of its word. A window of under ``LITERAL``
words besides its slots says too little: there the slots count as the words they are.

1. Any window holds one of the k-grams that start at every ``stride``-th word, so only those are hashed for a document, and
   joined with all k-grams of the benchmark.
2. Around each hit the windows are cut out and joined with the benchmark's by hash, then compared word by word.
3. Slot consistency is checked over a whole item: the hits of a document and an item that lie on one diagonal fill the
   item's slots. If one value of the item stands for two in the document, or the other way round, only windows without slots count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import numbered, only, place, table

WINDOW = 13
#: Shorter items are searched as one window of all their words; items under this many words only as whole lines.
LEAST = 5
#: Words besides slots that a window needs for its slots to be open.
LITERAL = 4
#: Benchmark k-grams, and windows, up to which they are broadcast (about 20 and 200 bytes each).
BROADCAST_ROWS = 200_000
#: Words that are units after a number.
UNITS = (
    "kilometers kilometer kilograms kilogram centimeters millimeters milliliters minutes minute seconds second meters meter miles mile "
    "grams gram liters liter hours hour days day weeks week months month years year dollars dollar euros euro percent pounds pound "
    "inches inch feet foot degrees km kg cm mm ml mg m g l s h"
).split()
#: Number words, and what they stand for.
NUMBERS = {
    w: str(n)
    for w, n in zip(
        "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split(),
        [*range(2, 21), *range(30, 100, 10), 100, 1000, 10**6],
    )
}
PLAIN, NAMED = 0, 1
_NAME, _NUMBER, _UNIT, _AND, _END = "\x01", "\x02", "\x03", "\x04", "\x05"


def gram(n: int) -> tuple[int, int]:
    """(words, stride) of the k-grams that find windows of ``n`` words: each window holds one that starts at a multiple of the stride."""
    k = n // 2 + 2
    return k, n - k + 1


def alternatives(words: list[str]) -> str:
    """A pattern of these words by their first letters, so that another word costs a few looks and not one for each of them."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    return "|".join(c + ("" if rest == [""] else f"(?:{alternatives(rest)})") for c, rest in by.items())


def _cleaned(text: Column) -> Column:
    """What both readings begin with: a text without marks, its digits marked as numbers."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x01-\x05]", " ")
    t = F.regexp_replace(t, r"([0-9])[.,](?=[0-9])", "$1")
    return F.regexp_replace(t, r"([0-9]+)", f" {_NUMBER}$1 ")


def _read(t: Column, reading: int) -> Column:
    if reading == NAMED:
        t = F.regexp_replace(t, r"(?=\p{Lu})(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", f"{_NAME}$1{_END}")
        t = F.replace(F.replace(t, F.lit(f"{_END} {_NAME}"), F.lit(_AND)), F.lit(_END), F.lit(""))
    t = F.concat(F.lit(" "), F.regexp_replace(F.lower(t), r"[^a-z0-9\x01-\x04\p{L}\p{N}]+", " "), F.lit(" "))
    t = F.regexp_replace(t, rf" ({alternatives(list(NUMBERS))})(?= )", f" {_NUMBER}$1")
    t = F.regexp_replace(t, rf"({_NUMBER}[\p{{L}}0-9]+) +({'|'.join(UNITS)})(?= )", f"$1 {_UNIT}$2")
    return F.trim(t)


def marked(text: Column, reading: int) -> Column:
    """The words of a reading, joined by spaces; a slot is its type's mark and its value.

    Each pattern begins with what is rare, so that most letters cost one look.
    """
    return _read(_cleaned(text), reading)


def readings(d: DataFrame, read: list[int]) -> DataFrame:
    """doc_id, th, and m0 and m1 for the readings that are asked for; what they have in common is done once."""
    return d.select("doc_id", "th", _cleaned(F.col("text")).alias("t")).select("doc_id", "th", *[_read(F.col("t"), r).alias(f"m{r}") for r in read])


def _open(words: Column) -> Column:
    """A joined list of words with slots as their types."""
    return F.split(F.regexp_replace(words, r"([\x01-\x03])[\p{L}\p{N}\x04]+", "$1"), " ")


def _slot(w: Column) -> Column:
    return w < "\x04"


def template(words: Column) -> Column:
    """A window's template."""
    return F.when(
        F.size(F.filter(words, lambda w: ~_slot(w))) >= LITERAL, F.transform(words, lambda w: F.when(_slot(w), F.substring(w, 1, 1)).otherwise(w))
    ).otherwise(words)


def _spots(size: Column, n: int, step: int = 1) -> Column:
    """0, step, ... as far as ``n`` words fit."""
    return F.when(size >= n, F.sequence(F.lit(0), size - n, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _grams(words: Column, reading: int, n: int, step: int) -> Column:
    """(reading, size, hash, place) of the k-grams for windows of ``n`` words, at every ``step``-th word."""
    k, _ = gram(n)
    one = lambda p: F.struct(F.lit(reading).alias("r"), F.lit(n).alias("n"), F.xxhash64(F.slice(words, p + 1, F.lit(k))).alias("g"), p.alias("p"))
    return F.transform(_spots(F.size(words), k, step), one)


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, text_hash: bool = False) -> DataFrame:
    """doc_id, n_windows, n_items, contaminated for every row of ``docs``, against all of ``benchmark`` (item_id, text).

    n_windows counts the places in the document where a window of the benchmark begins, in the reading that has more of them,
    and lines that are items of fewer than ``least`` words; n_items counts the items they are from; a document is contaminated if
    there is one. An item of fewer than ``window`` words is one window of all its words. Null and empty texts have none.
    Rows of equal doc_id and text get equal results. Empty tables: of documents no rows, of the benchmark no hits.
    With ``text_hash``, also th, the text's xxhash64.
    """
    d = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("th"), "text")
    items = only(benchmark, "item_id", "text").where("text is not null").distinct()
    sides, sizes = [], {}
    for r in (PLAIN, NAMED):
        mine = items.select("item_id", marked(F.col("text"), r).alias("m")).where("m <> ''")
        mine = mine.select("item_id", "m", F.size(F.split("m", " ")).alias("size")).where(F.col("size") >= least)
        sizes[r] = sorted(x.size for x in mine.select(F.least("size", F.lit(window)).alias("size")).distinct().collect())  # ``window`` numbers at most
        for n in sizes[r]:
            of = mine.where(F.col("size") >= n if n == window else F.col("size") == n).select("item_id", "m", F.split("m", " ").alias("w"))
            grams = of.select(F.explode(_grams(_open(F.col("m")), r, n, 1)).alias("x")).select("x.r", "x.n", "x.g")
            wins = of.select("item_id", F.explode(_spots(F.size("w"), n)).alias("iat"), "w")
            sides.append((grams, wins.select(F.lit(r).alias("br"), F.lit(n).alias("bn"), "item_id", "iat", F.slice("w", F.col("iat") + 1, F.lit(n)).alias("bw"))))
    found = None
    if sides:
        grams = _union([x for x, _ in sides]).distinct()
        wins = _union([x for _, x in sides]).withColumn("bt", template(F.col("bw"))).withColumn("h", F.xxhash64("br", "bt"))
        read = [r for r in sizes if sizes[r]]
        rows = readings(d, read).select("*", *[_open(F.col(f"m{r}")).alias(f"t{r}") for r in read])
        every = F.concat(*[_grams(F.col(f"t{r}"), r, n, gram(n)[1]) for r in read for n in sizes[r]])
        rows = rows.select("doc_id", "th", *[f"m{r}" for r in read], F.explode(every).alias("x")).select("*", "x.*").drop("x")
        step = F.create_map(*[F.lit(x) for n in sorted({n for r in read for n in sizes[r]}) for x in (n, gram(n)[1])])

        def around(q: DataFrame) -> DataFrame:
            """The words of all windows that a k-gram may lie in first."""
            m = F.coalesce(*[F.when(F.col("r") == r, F.col(f"m{r}")) for r in read])
            q = q.withColumn("from", F.greatest(F.col("p") - step[F.col("n")] + 1, F.lit(0)))
            return q.withColumn("w", F.slice(F.split(m, " "), F.col("from") + 1, F.col("p") - F.col("from") + F.col("n"))).drop(*[f"m{r}" for r in read])

        # with a broadcast the words are cut out for hits alone, else before they travel
        hits = around(rows.join(F.broadcast(grams), ["r", "n", "g"])) if grams.count() <= BROADCAST_ROWS else around(rows).join(grams, ["r", "n", "g"])
        hits = hits.select("doc_id", "th", "r", "n", "from", "w", F.explode(F.sequence(F.lit(0), F.col("p") - F.col("from"))).alias("o"))
        hits = hits.where(F.size("w") >= F.col("o") + F.col("n")).select("doc_id", "th", "r", "n", (F.col("from") + F.col("o")).alias("at"), F.slice("w", F.col("o") + 1, F.col("n")).alias("w"))
        hits = hits.withColumn("t", template(F.col("w"))).withColumn("h", F.xxhash64("r", "t"))
        hits = hits.join(_small(wins), "h").where((F.col("r") == F.col("br")) & (F.col("n") == F.col("bn")) & (F.col("t") == F.col("bt")))
        found = hits.select("doc_id", "th", "r", "n", "at", "item_id", "iat", _filled(F.col("bw"), F.col("w")).alias("slots"))
    got = []
    if found is not None:
        item = found.groupBy("doc_id", "th", "r", "n", "item_id", (F.col("at") - F.col("iat")).alias("diagonal"))  # an item's words bound its slots and places
        item = item.agg(F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"), F.collect_set(F.struct("at", (F.size("slots") == 0).alias("bare"))).alias("places"))
        side = lambda x: F.size(F.array_distinct(F.transform("slots", lambda s: F.struct(s["t"], s[x]))))
        same = (side("b") == F.size("slots")) & (side("d") == F.size("slots"))
        places = F.when(same, F.col("places")).otherwise(F.filter("places", lambda x: x["bare"]))
        got.append(item.select("doc_id", "th", "r", "item_id", F.explode(places).alias("x")).select("doc_id", "th", "r", F.col("x.at").alias("at"), "item_id"))
    line = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))
    tiny = items.select("item_id", line(F.col("text")).alias("line")).where((F.col("line") != "") & (F.size(F.split("line", " ")) < least))
    if not tiny.isEmpty():
        lines = d.select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("i", "line")).select("doc_id", "th", "i", line(F.col("line")).alias("line"))
        got.append(lines.join(_small(tiny), "line").select("doc_id", "th", F.lit(PLAIN).alias("r"), (-1 - F.col("i")).alias("at"), "item_id"))
    out = d.select("doc_id", "th")
    if not got:
        out = out.select("doc_id", "th", F.lit(0).cast("long").alias("n_windows"), F.lit(0).cast("long").alias("n_items"))
    else:
        per = [F.count_distinct(F.when(F.col("r") == r, F.col("at"))) for r in (PLAIN, NAMED)]
        sums = _union(got).groupBy("doc_id", "th").agg(F.greatest(*per).alias("n_windows"), F.count_distinct("item_id").alias("n_items"))
        sums = sums.select(F.col("doc_id").alias("gk"), F.col("th").alias("gt"), "n_windows", "n_items")
        out = out.join(sums, F.col("doc_id").eqNullSafe(F.col("gk")) & (F.col("th") == F.col("gt")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("doc_id", zero("n_windows"), zero("n_items"), (zero("n_windows") > 0).alias("contaminated"), *(["th"] if text_hash else []))


def _filled(item: Column, doc: Column) -> Column:
    """(type, the item's value, the document's value) of a window's open slots; number words count as their digits."""
    digits = F.create_map(*[F.lit(_NUMBER + x) for w in NUMBERS.items() for x in w])
    value = lambda w: F.coalesce(F.try_element_at(digits, w), w)
    pairs = F.zip_with(item, doc, lambda b, x: F.struct(F.substring(b, 1, 1).alias("t"), value(b).alias("b"), value(x).alias("d")))
    return F.filter(pairs, lambda s: s["t"] < "\x04")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the contaminated ones."""
    bad = contaminated(docs, benchmark, text_hash=True, **how).where("contaminated").select(F.col("doc_id").alias("bk"), F.col("th").alias("bt")).distinct()
    plain = numbered(docs)
    key, text = (F.col(f"c{place(docs, c)}") for c in ("doc_id", "text"))
    return plain.join(bad, key.eqNullSafe(F.col("bk")) & (F.xxhash64(text) == F.col("bt")), "left_anti").toDF(*docs.columns)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Operator 6: a verdict for each document, against the whole benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    words = lambda x: "(" + ", ".join(f"'{w}'" for w in x) + ")"

    def tokens(source: str, key: str) -> str:
        """(key, r, i, w): words of both readings, slots with their mark."""
        t = "translate(coalesce(text, ''), chr(1) || chr(2) || chr(3) || chr(4) || chr(5), '     ')"
        for _ in range(2):  # neighbours need another turn
            t = rf"regexp_replace({t}, '([0-9])[.,]([0-9])', '\1\2', 'g')"
        t = f"regexp_replace({t}, '([0-9]+)', ' \\1 ', 'g')"
        return rf"""
{source}_t AS (SELECT {key}, r, unnest(w) AS w, unnest(s) AS s, generate_subscripts(w, 1) AS i FROM (
    SELECT {key}, regexp_extract_all(t, '[\p{{L}}\p{{N}}]+') AS w, regexp_extract_all(t, '([^\p{{L}}\p{{N}}]*)[\p{{L}}\p{{N}}]+', 1) AS s
    FROM (SELECT {key}, {t} AS t FROM {source})), (VALUES (0), (1)) AS v(r)),
{source}_n AS (SELECT *, r = 1 AND regexp_full_match(w, '\p{{Lu}}\p{{Ll}}+') AS name FROM {source}_t),
{source}_r AS (SELECT *, CASE WHEN name AND s = ' ' AND lag(name) OVER o THEN 0 ELSE 1 END AS fresh,
    NOT name AND (regexp_full_match(w, '[0-9]+') OR lower(w) IN {words(NUMBERS)}) AS number FROM {source}_n WINDOW o AS (PARTITION BY {key}, r ORDER BY i)),
{source}_u AS (SELECT *, sum(fresh) OVER o AS pos, NOT name AND lower(w) IN {words(UNITS)} AND lag(number) OVER o AS unit
    FROM {source}_r WINDOW o AS (PARTITION BY {key}, r ORDER BY i)),
{source}_w AS (SELECT {key}, r, list(w ORDER BY pos) AS w FROM (
    SELECT {key}, r, pos, max(CASE WHEN name THEN chr(1) WHEN number THEN chr(2) WHEN unit THEN chr(3) ELSE '' END) || string_agg(lower(w), chr(4) ORDER BY i) AS w
    FROM {source}_u GROUP BY {key}, r, pos) GROUP BY {key}, r)"""

    def wins(source: str, key: str, more: str = "") -> str:
        part = "w[i:i + z.n - 1]"
        return f"""SELECT {key}, {source}.r, i, z.n, {part} AS p, CASE WHEN len(list_filter({part}, lambda x: x >= chr(4))) >= {LITERAL}
    THEN list_transform({part}, lambda x: CASE WHEN x < chr(4) THEN x[1:1] ELSE x END) ELSE {part} END AS tpl
    FROM {source} JOIN z ON z.r = {source}.r, unnest(range(1, len(w) - z.n + 2)) AS u(i) {more}"""

    digit = "CASE x[2:] " + " ".join(f"WHEN '{w}' THEN chr(2) || '{n}'" for w, n in NUMBERS.items()) + " ELSE x END"
    line = lambda x: f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"""
WITH documents_k AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
benchmark_k AS (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL),
{tokens("documents_k", "rid")},
{tokens("benchmark_k", "item_id")},
z AS (SELECT DISTINCT r, least(len(w), {WINDOW})::INTEGER AS n FROM benchmark_k_w WHERE len(w) >= {LEAST}),
bw AS ({wins("benchmark_k_w", "item_id", f"WHERE z.n = {WINDOW} OR len(w) = z.n")}),
dw AS ({wins("documents_k_w", "rid")}),
hit AS (SELECT rid, item_id, dw.r, dw.n, dw.i AS pos, dw.i - bw.i AS diagonal, dw.p AS d, bw.p AS b
    FROM dw JOIN bw ON dw.r = bw.r AND dw.n = bw.n AND dw.tpl = bw.tpl),
slot AS (SELECT rid, item_id, r, n, pos, diagonal, x[1:1] AS t, {digit} AS b, {digit.replace("x[2:]", "y[2:]").replace("ELSE x", "ELSE y")} AS d
    FROM (SELECT rid, item_id, r, n, pos, diagonal, unnest(b) AS x, unnest(d) AS y FROM hit) WHERE x < chr(4)),
odd AS (SELECT rid, item_id, r, n, diagonal FROM slot GROUP BY ALL
    HAVING count(DISTINCT (t, b, d)) <> count(DISTINCT (t, b)) OR count(DISTINCT (t, b, d)) <> count(DISTINCT (t, d))),
good AS (SELECT rid, item_id, r, pos FROM hit WHERE NOT EXISTS (SELECT 1 FROM odd WHERE odd.rid = hit.rid AND odd.item_id IS NOT DISTINCT FROM hit.item_id
        AND odd.r = hit.r AND odd.n = hit.n AND odd.diagonal = hit.diagonal)
    OR len(list_filter(b, lambda x: x < chr(4))) = 0),
tiny AS (SELECT item_id, {line("text")} AS line FROM benchmark_k WHERE {line("text")} <> '' AND len(string_split({line("text")}, ' ')) < {LEAST}),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents_k),
every AS (SELECT * FROM good UNION ALL SELECT rid, item_id, 0, -i FROM lines JOIN tiny ON {line("lines.line")} = tiny.line),
sums AS (SELECT rid, greatest(count(DISTINCT CASE WHEN r = 0 THEN pos END), count(DISTINCT CASE WHEN r = 1 THEN pos END)) AS n_windows, count(DISTINCT item_id) AS n_items
    FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_windows, 0)::BIGINT AS n_windows, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(n_windows, 0) > 0 AS contaminated
FROM documents_k LEFT JOIN sums USING (rid)
"""


SQL = _sql()
