"""Vector code compression (operator 11): product codes, whose entries are found by the filter of a VA-file.

Vectors become integers and are cut into parts; every part position has a codebook. The nearest entry of a part is found in two steps:

1. ``Cells`` quantises each coordinate of the entries to a few bits: an entry is approximated by one cell a dimension.
   For a query, two lookup tables hold, for each dimension and cell, the least and the greatest squared difference to any number of
   the cell. Their sums over the dimensions bound the distance of each entry from below and above.
2. Only entries whose lower bound does not exceed the least upper bound can be nearest. These are refined with exact integer
   distances; the nearest entry, and any that ties with it, are always among them.

Codebooks are refined by a fixed number of rounds. A round reads the vectors once; each task adds up its own parts, so one row for each
entry is shuffled. Codebooks have a fixed size (parts x entries) and go with the job.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, table
from ._vectors import first_rows, mapped, schema_of, summed, vectors

DIMS, PARTS, ENTRIES, ROUNDS, BITS = 64, 16, 64, 2, 4


class Cells:
    """The entries of one codebook (entries x width), approximated by cells of equal width."""

    def __init__(self, book: np.ndarray, bits: int = BITS) -> None:
        self.book = book
        low, high = book.min(axis=0), book.max(axis=0)
        many = 1 << bits
        step = (high - low) // many + 1
        self.cell = (book - low) // step  # entries x width
        self.low = (low + np.arange(many)[:, None] * step).T  # width x cells: least and greatest number of each
        self.high = self.low + step[:, None] - 1

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances (entries x queries) of queries (width x queries)."""
        below, above = self.low[:, :, None] - q[:, None, :], q[:, None, :] - self.high[:, :, None]
        least = np.maximum(np.maximum(below, above), 0)
        most = np.maximum(np.abs(below), np.abs(above))
        least *= least
        most *= most
        lower, upper = least[0][self.cell[:, 0]], most[0][self.cell[:, 0]]
        for d in range(1, len(q)):
            lower += least[d][self.cell[:, d]]
            upper += most[d][self.cell[:, d]]
        return lower, upper

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest entry (ties: the lower index) and squared distance of each query (queries x width), and how many distances were taken."""
        lower, upper = self.bounds(np.ascontiguousarray(x.T))
        entry, query = np.nonzero(lower <= upper.min(axis=0))
        diff = x[query] - self.book[entry]
        dist = np.full(lower.shape, np.iinfo(lower.dtype).max, lower.dtype)
        dist[entry, query] = np.einsum("ij,ij->i", diff, diff)
        best = dist.argmin(axis=0)
        return best, dist[best, np.arange(len(x))], len(entry)


def assigned(x: np.ndarray, books: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, int]:
    """For vectors (rows x dims) and codebooks (parts x entries x width): entry and distance of each part, and distances taken.

    Where all numbers are small enough for it, 32-bit integers do the work.
    """
    parts, _, width = books.shape
    peak = max(int(np.abs(x).max(initial=0)), int(np.abs(books).max(initial=0)))
    if (4 * peak + 2) ** 2 * width < 2**31:
        x, books = x.astype(np.int32), books.astype(np.int32)
    code, dist, taken = np.empty((len(x), parts), np.int64), np.empty((len(x), parts), np.int64), 0
    for p in range(parts):
        code[:, p], dist[:, p], n = Cells(books[p], bits).nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]))
        taken += n
    return code, dist, taken


def train(df: DataFrame, dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> np.ndarray | None:
    """Codebooks (parts x entries x width) of ``vectors``; None where no vector is kept.

    They start as the parts of the vectors of the smallest vec_ids (null last; of equal ids, the smaller integers first); fewer vectors give fewer entries.
    A round gives each part to its nearest entry and moves each used entry to the floor of its parts' mean.
    """
    first = first_rows(df, dims, entries, F.asc_nulls_last("vec_id"))
    if not len(first):
        return None
    width = dims // parts
    books = np.ascontiguousarray(first.reshape(len(first), parts, width).transpose(1, 0, 2))
    many = books.shape[1]
    for _ in range(rounds):

        def of(x: np.ndarray, books: np.ndarray = books):
            code, _, _ = assigned(x, books, bits)
            for p in range(parts):
                yield code[:, p] + p * many, x[:, p * width : (p + 1) * width]

        count, total = summed(df, dims, parts * many, width, of)
        used = count > 0
        flat = books.reshape(parts * many, width).copy()
        flat[used] = total[used] // count[used, None]
        books = flat.reshape(parts, many, width)
    return books


def encode(df: DataFrame, books: np.ndarray, bits: int = BITS) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over the parts) of every kept vector."""
    parts, many, width = books.shape
    if many > 256:
        raise ValueError("a code has two hex digits a part: 256 entries at most")
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(256)).encode(), "S2")

    def coded(rows: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        code, dist, _ = assigned(x, books, bits)
        text = np.ascontiguousarray(digits[code]).view(f"S{2 * parts}").ravel().astype(str)
        return pa.record_batch([rows.column(0), rows.column(1), pa.array(text, pa.string()), pa.array(dist.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return mapped(df, schema_of(df, ["vec_id", "label"], "code string, error long"), parts * width, coded)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all integer components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, dims: int = DIMS, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, bits: int = BITS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept row of ``embeddings`` (vec_id of any type, embedding, label of any type).

    Rows are left out whose vector is null, has another number of components than ``dims``, or a null or non-finite one. A component x
    counts as floor(256 * x), and one beyond 2**27 (either sign) as that. Of equal distances the lower entry is taken. Repeated rows count as often as
    they come, and all are returned. Null labels are one label; a sum of errors beyond a long is null. No kept vector: no rows. Other columns are ignored.
    """
    if dims % parts:
        raise ValueError("parts must divide the number of components")
    df = vectors(embeddings, "vec_id", "label")
    books = train(df, dims, parts, entries, rounds, bits)
    sha = digest(books) if books is not None else ""
    books = books if books is not None else np.zeros((parts, 1, dims // parts), np.int64)
    rows = cut(encode(df, books, bits))
    sums = rows.groupBy(F.col("label").alias("l")).agg(F.try_sum("error").alias("label_error"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("l"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with approx, the entries' components one after another (array of long)."""
    parts = books.shape[0]
    entry = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(parts)]
    tables = [F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in e]) for e in book]) for book in books]
    return codes.withColumn("approx", F.concat(*[t[e] for t, e in zip(tables, entry)]))


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Operator 11 over all embeddings: 16 parts, 64 entries, 2 rounds."""
    return compress(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    width = DIMS // PARTS
    d = " + ".join(f"(p.q[{i}] - b.q[{i}]) * (p.q[{i}] - b.q[{i}])" for i in range(1, width + 1))
    near = "SELECT p.rid, p.part, min({{'d': {d}, 'e': b.entry}}) AS m FROM p JOIN {b} b ON b.part = p.part GROUP BY p.rid, p.part".format
    floor = lambda s, n: f"(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"
    steps = []
    for r in range(ROUNDS):
        means = ", ".join(f"({floor(f'sum(p.q[{i}])', 'count(*)')})::BIGINT" for i in range(1, width + 1))
        steps.append(f"a{r} AS MATERIALIZED ({near(d=d, b=f'b{r}')})")
        steps.append(f"m{r} AS (SELECT a.part, a.m.e AS entry, [{means}] AS q FROM a{r} a JOIN p ON p.rid = a.rid AND p.part = a.part GROUP BY 1, 2)")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.q, b.q) AS q FROM b{r} b LEFT JOIN m{r} m ON m.part = b.part AND m.entry = b.entry)")
    return f"""
WITH k AS (SELECT vec_id, label, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS rid, vec_id, label, e FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM k)),
p AS MATERIALIZED (SELECT rid, part, e[part * {width} + 1:part * {width} + {width}] AS q FROM v, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, q FROM p WHERE rid <= {ENTRIES}),
{', '.join(steps)},
f AS MATERIALIZED ({near(d=d, b=f'b{ROUNDS}')}),
r AS (SELECT rid, string_agg(printf('%02x', m.e::INT), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM f GROUP BY rid),
s AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY part, entry)) AS sha FROM b{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM r JOIN v USING (rid), s
"""


SQL = _sql()
