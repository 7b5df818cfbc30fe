"""Column expressions that operators share."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: 97.5 % point of the normal distribution; bytes of size classes; rewards; ratio steps.
Z = 1.959963984540054
MIB = 1024 * 1024
REWARD = {"infrastructure_error": None, "unsafe_sql": -1.0, "loop": -0.4, "max_actions": -0.4}
EXECUTION_ERROR, MATCH, MISMATCH = -0.2, 1.0, 0.0
RATIO_STEPS = ((2.0, 1.25), (1.0, 1.0), (0.5, 0.75), (0.25, 0.5))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where a lambda inside uses it again and again."""
    return F.transform(F.array(value), body).getItem(0)


def seeded(key: Column, seed: int = 42) -> Column:
    """A hash that orders keys at random, the same way each time."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where whole is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def wilson_upper(successes: Column, total: Column) -> Column:
    """Upper end of the 95 % Wilson interval; 1 without trials."""
    n = total.cast("double")
    rate = successes / n
    middle = rate + Z * Z / (2 * n)
    half = Z * F.sqrt(rate * (1 - rate) / n + Z * Z / (4 * n * n))
    return F.when(total <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (middle + half) / (1 + Z * Z / n)))


def stable_json(*columns: str) -> Column:
    """Compact JSON of columns with sorted keys; nulls are kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def fingerprint(*columns: str) -> Column:
    """SHA-256 of ``stable_json``."""
    return F.sha2(stable_json(*columns), 256)


@F.pandas_udf(T.StringType())
def compatible(text: pd.Series) -> pd.Series:
    """NFKC form with full case folding; null stays null."""
    return text.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def normalized(text: Column) -> Column:
    """Question text for comparison: compatibility form, case folded, punctuation to spaces, single spaces.

    ASCII texts need no more than lower case, so only the others go to Python.
    """
    wide = text.rlike(r"[^\x00-\x7F]")
    folded = F.when(wide, compatible(F.when(wide, text))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def features(text: Column, size: int = 3) -> Column:
    """Word n-grams of a normalised text; its words if it has fewer."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))
    return let(F.filter(F.split(text, " "), lambda x: x != ""), lambda w: F.when(F.size(w) < size, w).otherwise(grams(w)))


def size_class(size: Column) -> Column:
    """Size class of a database in bytes."""
    return F.when(size < 10 * MIB, "small_lt_10_mib").when(size < 100 * MIB, "medium_lt_100_mib").otherwise("large_ge_100_mib")


def complexity_class(score: Column) -> Column:
    """Complexity class of a score."""
    return F.when(score <= 1, "simple").when(score <= 3, "moderate").otherwise("challenging")


def ratio_reward(value: Column) -> Column:
    """Stepwise reward of a time ratio."""
    out = F.when(value <= 0, F.lit(0.0))
    for step, reward in RATIO_STEPS:
        out = out.when(value >= step, F.lit(reward))
    return out.otherwise(F.lit(0.25))


def terminal_reward(terminal: Column, gold_status: Column, gold_digest: Column, status: Column, digest: Column) -> Column:
    """(reward, valid, reason) of an episode's end."""
    answer = lambda reward, valid, reason: F.struct(F.lit(reward).cast("double").alias("reward"), F.lit(valid).alias("valid"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    out = F.when(terminal == "infrastructure_error", answer(None, False, "infrastructure_error"))
    out = out.when(terminal == "unsafe_sql", answer(-1.0, True, "unsafe_sql"))
    out = out.when(terminal.isin("loop", "max_actions"), answer(-0.4, True, terminal))
    bad = lambda s, d: F.coalesce(s != "passed", F.lit(True)) | d.isNull()
    out = out.when(bad(gold_status, gold_digest), answer(None, False, "invalid_gold"))
    out = out.when(status == "infrastructure_error", answer(None, False, "prediction_infrastructure_error"))
    out = out.when(status == "unsafe_sql", answer(-1.0, True, "unsafe_sql"))
    out = out.when(bad(status, digest), answer(EXECUTION_ERROR, True, "submission_execution_error"))
    return out.when(digest == gold_digest, answer(MATCH, True, "execution_match")).otherwise(answer(MISMATCH, True, "execution_mismatch"))


def canonical_value(column: Column, kind: str) -> Column:
    """A value as an array of type tag and text, so that 1 and 1.0 differ."""
    text = column.cast("string")
    if kind in ("tinyint", "smallint", "int", "bigint", "boolean"):
        tag, text = "int", (column.cast("int") if kind == "boolean" else column).cast("string")
    elif kind in ("float", "double"):
        d = column.cast("double")
        tag, text = "float", F.when(F.isnan(d), "nan").when(d == float("inf"), "+inf").when(d == float("-inf"), "-inf").otherwise(F.hex(F.encode(text, "utf-8")))
    elif kind == "binary":
        tag, text = "bytes", F.base64(column)
    else:
        tag = "str"
    return F.when(column.isNull(), F.array(F.lit("null"), F.lit(None).cast("string"))).otherwise(F.array(F.lit(tag), text))


def canonical_row(dtypes: list[tuple[str, str]], columns: list[Column]) -> Column:
    """A row as compact JSON of its tagged values; names do not count, order does."""
    return F.to_json(F.array(*[canonical_value(c, kind) for c, (_, kind) in zip(columns, dtypes)]))


def content_hash(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, content_hash) of rows with a digest f, in whatever order: SHA-256 by the digests' first four letters, then over those parts."""
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)
    parts = df.groupBy(*keys, F.substring("f", 1, 4).alias("p")).agg(joined("f").alias("h"))
    return parts.groupBy(*keys).agg(joined(F.concat("p", "h")).alias("content_hash"))


def ranked(df: DataFrame, column: str, keys: list[str], times: Column | None = None, **shares: float) -> DataFrame:
    """Nearest-rank percentiles of a column by ``keys`` (null counts as a key), each named as its share is; ranks are rounded half to even.

    Values are counted first (a row counts ``times``). Counts then go through two levels: a key's values lie in ranges, 256 for each power of e; the ranges'
    sums say which range holds a rank, and only that range's values are gone through. So no task sees all distinct values of a key unless they lie in one range.
    """
    c = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).cast("double").alias("value")).agg((F.count("*") if times is None else F.sum(times)).alias("many"))
    c = c.withColumn("range", F.when(F.isnan("value"), 2**63 - 1).otherwise(F.floor(F.signum("value") * F.log1p(F.abs("value")) * 256)))
    sums = c.groupBy(*keys, "range").agg(F.sum("many").alias("inside"))
    w = Window.partitionBy(*keys)
    sums = sums.withColumn("before", F.sum("inside").over(w.orderBy("range")) - F.col("inside")).withColumn("all", F.sum("inside").over(w))
    place = lambda p: F.bround((F.col("all") - 1) * F.lit(float(p)), 0)
    holds = lambda p: (F.col("before") <= place(p)) & (place(p) < F.col("before") + F.col("inside"))
    wanted = sums.withColumn("which", F.explode(F.array_compact(F.array(*[F.when(holds(p), F.lit(name)) for name, p in shares.items()]))))
    at = F.create_map(*[x for name, p in shares.items() for x in (F.lit(name), place(p))])
    wanted = wanted.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("range").alias("_range"), "before", "which", at[F.col("which")].alias("place"))
    same = F.col("range") == F.col("_range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inner = c.join(wanted, same).select(*keys, "value", "many", "before", "which", "place")
    upto = F.sum("many").over(Window.partitionBy(*keys, "which").orderBy("value")) + F.col("before")
    found = inner.withColumn("upto", upto).where(F.col("upto") > F.col("place"))
    return found.groupBy(*keys).agg(*[F.min(F.when(F.col("which") == name, F.col("value"))).alias(name) for name in shares])


def pad(values: Column, width: Column, fill: int) -> Column:
    """An array filled up on the right."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0))))


def add_maps(a: Column, b: Column) -> Column:
    """Maps of numbers added key by key."""
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    return F.map_zip_with(a, b, lambda _, x, y: zero(x) + zero(y))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost of tokens at prices for a million."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000
