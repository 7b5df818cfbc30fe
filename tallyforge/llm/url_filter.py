"""URL filters: logistic regression on hashed character n-grams of host and path, under rules (operator 4).

The model learns from the labelled URLs of ``url_table``. Its bias is fixed at ``PRIOR``, so a URL whose n-grams tell
nothing has that score and is allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bytes import U, buffers, mix
from ._spark import map_arrow, only, slabs, table, texts
from .url_table import UNWANTED, WANTED, urls

#: Fixed values: (verdict, host and path) of the rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
BUCKETS = 1 << 15
SIZES = (3, 4, 5)
#: Score of a URL of which nothing is known.
PRIOR = 0.25
STEPS, RATE, DECAY = 2000, 8.0, 1e-4


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case (A-Z); then up to
    ``?``, ``#`` or the end. Null and what has no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    pattern = r"(?s)^([^/?#]*)([^?#]*)"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, pattern, 1), upper, upper.lower())
    path = F.regexp_extract(rest, pattern, 2)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (host and path in one string) and its verdict; null if none does.

    A rule's host fits itself and all its subdomains. Of rules of equal length the first in the alphabet wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1]), reverse=True):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def buckets(col: pa.Array, tag: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of bytes of ``^text$`` and their rows."""
    raw, at = buffers(pa.compute.binary_join_element_wise("^", col, "$", ""))
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found, rows = [], []
    for n in SIZES:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.full(m, tag * 16 + n, U)
        for j in range(n):
            h = h * U(0x9E3779B97F4A7C15) + raw[j : j + m].astype(U) + U(1)
        inside = own[:m] == own[n - 1 :]
        found.append((mix(h[inside]) & U(BUCKETS - 1)).astype(np.int64))
        rows.append(own[:m][inside])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(rows)


@dataclass
class Model:
    """Weights of the buckets, and the bias."""

    weights: np.ndarray
    bias: float

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability that each is unwanted; n-grams of a host, and of a path, share a weight of 1 over the root of their number."""
        z = np.full(len(host), self.bias)
        for tag, part in ((1, host), (2, path)):
            b, r = buckets(part, tag)
            z += np.bincount(r, self.weights[b], minlength=len(host)) / np.sqrt(np.maximum(np.bincount(r, minlength=len(host)), 1))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def split(url: str) -> tuple[str, str]:
    """``parts`` of one URL, in Python."""
    _, mark, rest = url.partition("://")
    host = rest[: min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))] if mark else ""
    path = rest[len(host) :] if mark else ""
    path = path[: min((i for i in map(path.find, "?#") if i >= 0), default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def train(unwanted: list[str], wanted: list[str], prior: float = PRIOR) -> Model:
    """Logistic regression by gradient descent with L2 decay, from labelled URLs; both classes weigh the same, and the bias stays."""
    pairs = [split(u) for u in [*unwanted, *wanted]]
    y = np.array([1.0] * len(unwanted) + [0.0] * len(wanted))
    x = np.zeros((len(pairs), BUCKETS))
    for tag in (1, 2):
        part = np.zeros_like(x)
        b, r = buckets(pa.array([u[tag - 1] for u in pairs], pa.string()), tag)
        np.add.at(part, (r, b), 1)
        x += part / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
    share = np.where(y > 0, 0.5 / len(unwanted), 0.5 / len(wanted))
    inner = x @ x.T  # the weights are a sum of the URLs' features, so the descent runs on the sum's factors
    factor, bias = np.zeros(len(pairs)), math.log(prior / (1 - prior))
    for _ in range(STEPS):
        d = (1 / (1 + np.exp(-np.clip(inner @ factor + bias, -40, 40))) - y) * share
        factor -= RATE * (d + DECAY * factor)
    return Model(x.T @ factor, bias)


def judge(pages: DataFrame, model: Model | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages`` (page_id, url).

    ``score`` is the model's probability that the URL is unwanted, and decides (block from 0.5) where no rule fits. A null
    or unusable URL has an empty host and path, so it fits no rule. An empty table gives no rows.
    """
    model = model or train(urls(UNWANTED), urls(WANTED))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    host, path = parts(F.col("url"))
    d = only(pages, "page_id", "url").select("page_id", host.alias("host"), path.alias("path"))

    def f(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        host, path = texts(batch, "host"), texts(batch, "path")
        size = np.diff(buffers(host)[1]) + np.diff(buffers(path)[1])
        p = [shared.value.score(host.slice(i, j - i), path.slice(i, j - i)) for i, j in slabs(size.tolist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(p))], names=[*batch.schema.names, "score"])

    kind = pages.schema["page_id"].dataType.simpleString()
    got = map_arrow(d, f"page_id {kind}, host string, path string, score double", f)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return got.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Operator 4 over all pages."""
    return judge(table(spark, sf_dir, "pages"))
