"""License scans by canonical digests (operator 1). DataFrame functions only.

A text is brought into canonical form: lower case; lines that state a copyright, a first line that is the licence's name, and the
marks of list items go; spellings that licences use for the same word become one; what is no letter or digit is a space. Its SHA-256 is joined with the digests of known
licences, so only whole texts match. Each line that may be a notice (it has ``licen``) is a whole text of its own,
joined with the digests of known notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import only, table
from .license_texts import DIGESTS, NOTICES, TEXTS

#: Spellings that count as the same.
SAME = (
    ("licence", "license"),
    ("sub-license", "sublicense"),
    ("non-commercial", "noncommercial"),
    ("non-infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("acknowledgement", "acknowledgment"),
    ("organisation", "organization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("https://", "http://"),
    ("http://www.", "http://"),
    ("&", " and "),
)
COPYRIGHT = r"(?m)^[ \t/*#;-]*(copyright|\(c\)|©)[ \t:]*(\(c\)|©|[0-9]{4}|<|\[)[^\n]*$"
RIGHTS = r"(?m)^[ \t/*#;-]*all rights reserved[ \t.]*$"
TITLE = r"^\s*[^\n.]{0,60}licen[cs]e[^\n.]{0,40}\n"
ITEM = r"(?m)^[ \t]*([0-9]{1,2}[.)]|\([a-z0-9]\)|[a-z]\)|[*•-])[ \t]+"
REST = r"[^\p{L}\p{N}]+"
#: Known texts are broadcast; their number may not pass this.
MOST = 10_000


def canonical(text: Column) -> Column:
    """The canonical form of a text; null stays null."""
    t = F.lower(text)
    for pattern in (TITLE, COPYRIGHT, RIGHTS, ITEM):
        t = F.regexp_replace(t, pattern, " ")
    for a, b in SAME:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, REST, " "))


def known(spark, texts, digests=()) -> DataFrame:
    """(known_digest, known_license) of lists of (licence, text) and (licence, digest); of equal digests the first licence by name."""
    if len(texts) + len(digests) > MOST:
        raise ValueError("too many known texts to broadcast")
    df = spark.createDataFrame([(x, t, None) for x, t in texts] + [(x, None, d) for x, d in digests], "license string, t string, d string")
    return F.broadcast(df.groupBy(F.coalesce("d", F.sha2(canonical(F.col("t")), 256)).alias("known_digest")).agg(F.min("license").alias("known_license")))


def scan(docs: DataFrame, texts=TEXTS, notices=NOTICES, digests=DIGESTS) -> DataFrame:
    """doc_id, license (of the whole text, else null), notices (distinct licences of its notice lines by name, joined by commas),
    n_notice_lines, digest, for every row of ``docs``.

    Null text is empty, and matches nothing. Rows of equal doc_id and text get equal results. An empty table gives no rows.
    """
    spark = docs.sparkSession
    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("th", F.xxhash64("t"))
    lines = d.select("doc_id", "th", F.explode(F.filter(F.split(F.lower("t"), "\n"), lambda x: x.contains("licen"))).alias("line"))
    lines = lines.select("doc_id", "th", F.sha2(canonical(F.col("line")), 256).alias("d"))
    lines = lines.join(known(spark, notices), F.col("d") == F.col("known_digest"))
    # a row that is repeated has its lines once for each copy
    rows = d.groupBy("doc_id", "th").agg(F.count("*").alias("copies")).where("copies > 1")
    found = lines.groupBy("doc_id", "th").agg(F.array_join(F.sort_array(F.collect_set("known_license")), ",").alias("notices"), F.count("*").alias("n"))
    rows = rows.select(F.col("doc_id").alias("ck"), F.col("th").alias("ct"), "copies")
    found = found.join(rows, F.col("doc_id").eqNullSafe(F.col("ck")) & (F.col("th") == F.col("ct")), "left")
    found = found.select(F.col("doc_id").alias("k"), F.col("th").alias("h"), "notices", (F.col("n") / F.coalesce("copies", F.lit(1))).cast("long").alias("n"))
    out = d.select("doc_id", "th", F.sha2(canonical(F.col("t")), 256).alias("digest"))
    out = out.join(known(spark, texts, digests), F.col("digest") == F.col("known_digest"), "left")
    out = out.join(found, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("h")), "left")
    return out.select("doc_id", F.col("known_license").alias("license"), F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n", F.lit(0)).alias("n_notice_lines"), "digest")


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Operator 1 over all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(t: str) -> str:
        t = f"lower({t})"
        for pattern in (TITLE, COPYRIGHT, RIGHTS, ITEM):
            t = f"regexp_replace({t}, {quote(pattern)}, ' ', 'g')"
        for a, b in SAME:
            t = f"replace({t}, {quote(a)}, {quote(b)})"
        return f"sha256(trim(regexp_replace({t}, {quote(REST)}, ' ', 'g')))"

    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    return f"""
WITH kt AS (SELECT h, min(l) AS license FROM (SELECT {form("t")} AS h, l FROM (VALUES {values(TEXTS)}) AS v(l, t) UNION ALL VALUES {", ".join(f"({quote(d)}, {quote(x)})" for x, d in DIGESTS)}) GROUP BY 1),
kn AS (SELECT {form("t")} AS h, min(l) AS license FROM (VALUES {values(NOTICES)}) AS v(l, t) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
line AS (SELECT rid, unnest(list_filter(string_split(lower(t), chr(10)), lambda x: contains(x, 'licen'))) AS x FROM d),
hit AS (SELECT rid, license FROM (SELECT rid, {form("x")} AS h FROM line) JOIN kn USING (h)),
n AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(*) AS n FROM hit GROUP BY rid),
w AS (SELECT *, {form("t")} AS digest FROM d)
SELECT doc_id, kt.license, coalesce(notices, '') AS notices, coalesce(n, 0)::BIGINT AS n_notice_lines, digest
FROM w LEFT JOIN kt ON w.digest = kt.h LEFT JOIN n USING (rid)
"""


SQL = _sql()
