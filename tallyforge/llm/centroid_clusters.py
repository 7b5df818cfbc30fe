"""Centroid clustering (operator 12) with partial-distance search.

Squared differences are added up over a few dimensions at a time, those of high variance first. The centroid that leads after the first
dimensions gives a current best: its whole distance. Every other centroid is abandoned as soon as its sum is strictly
above the best; survivors finish all dimensions, and of equal distances the smaller number wins. A slab of vectors goes through in lock step: what is
left is a list of (vector, centroid) pairs.

Rounds read the vectors; each task adds up its own vectors by centroid, so one row a centroid is shuffled. Centroids have a fixed size and go with
the job.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import cut, table
from ._vectors import first_rows, mapped, numbered, schema_of, summed, vectors, integers

DIMS, CENTROIDS, ROUNDS, STEP = 64, 40, 5, 8


def nearest(x: np.ndarray, centroids: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid and squared distance of each vector, and how many (vector, centroid) pairs finished; dimensions come in their order."""
    diff = x[:, None, :step] - centroids[None, :, :step]
    begun = np.einsum("ijk,ijk->ij", diff, diff)
    lead = begun.argmin(axis=1)
    diff = x - centroids[lead]
    best = np.einsum("ij,ij->i", diff, diff)
    row, c = np.nonzero(begun <= best[:, None])
    dist = begun[row, c]
    for at in range(step, x.shape[1], step):
        diff = x[row, at : at + step] - centroids[c, at : at + step]
        dist += np.einsum("ij,ij->i", diff, diff)
        stay = dist <= best[row]
        row, c, dist = row[stay], c[stay], dist[stay]
    first = np.flatnonzero(np.diff(row, prepend=-1))  # each vector's lead survives, so each has a row
    least = np.minimum.reduceat(dist, first) if len(first) else dist
    hit = np.flatnonzero(dist == least[row])
    hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return c[hit], dist[hit], len(row)


def by_variance(df: DataFrame, dims: int) -> np.ndarray:
    """Dimensions by falling variance over all kept vectors. Only the order of the work depends on it."""
    names = df.columns

    def run(batches):
        n, s, q = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            _, x = integers(batch.rename_columns(names), dims)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x.astype(float) ** 2).sum(axis=0)
        yield pa.record_batch({"d": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "s": s, "q": q})

    sums = numbered(df).mapInArrow(run, "d int, n long, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = np.zeros(dims)
    for r in sums.collect():  # one row a dimension
        spread[r.d] = r.q / r.n - (r.s / r.n) ** 2 if r.n else 0
    return np.argsort(-spread, kind="stable")


def train(df: DataFrame, dims: int = DIMS, many: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2") -> tuple[np.ndarray, np.ndarray]:
    """Centroids (many x dims) of ``vectors``, and the order of the dimensions.

    They start as the vectors whose ``seed``:vec_id has the smallest SHA-256 (null ids last; ties: the smaller integers first); fewer vectors give
    fewer centroids. A round gives every vector to its nearest centroid and moves each centroid that has vectors to the floor of their mean.
    """
    centroids = first_rows(df, dims, many, F.asc_nulls_last(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)))
    order = by_variance(df, dims) if len(centroids) else np.arange(dims)
    for _ in range(rounds if len(centroids) else 0):

        def of(x: np.ndarray, c: np.ndarray = centroids[:, order]):
            yield nearest(x[:, order], c)[0], x

        count, total = summed(df, dims, len(centroids), dims, of)
        used = count > 0
        centroids = centroids.copy()
        centroids[used] = total[used] // count[used, None]
    return centroids, order


def assign(df: DataFrame, centroids: np.ndarray, order: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every kept vector; an empty set of centroids gives no rows."""
    ordered = np.ascontiguousarray(centroids[:, order])

    def of(rows: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        c, dist, _ = nearest(np.ascontiguousarray(x[:, order]), ordered)
        return pa.record_batch([rows.column(0), pa.array(c.astype(np.int32)), pa.array(dist)], names=["vec_id", "cluster", "distance"])

    return mapped(df, schema_of(df, ["vec_id"], "cluster int, distance long"), centroids.shape[1], of)


def cluster(embeddings: DataFrame, dims: int = DIMS, many: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every kept row of ``embeddings`` (vec_id of any type, embedding).

    Rows are left out whose vector is null, has another number of components than ``dims``, or a null or non-finite one. A component x
    counts as floor(256 * x), and one beyond 2**27 (either sign) as that. Of equal distances the smaller number is taken. Repeated rows count
    as often as they come, and all are returned. An inertia beyond a long is null. No kept vector: no rows. Other columns are ignored.
    """
    df = vectors(embeddings, "vec_id")
    centroids, order = train(df, dims, many, rounds, seed)
    rows = cut(assign(df, centroids, order))
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # one row a cluster
    total = sum(sums.values()) if None not in sums.values() else 2**63
    inertia = F.lit(total if total < 2**63 else None).cast("long")
    of = F.array(*[F.lit(sums.get(i)).cast("long") for i in range(max(1, len(centroids)))])
    sha = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids.tolist()] or [F.lit("")])
    return rows.select("vec_id", "cluster", "distance", of[F.col("cluster")].alias("cluster_inertia"), inertia.alias("inertia"), sha[F.col("cluster")].alias("centroid_sha256"))


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    """Operator 12 over all embeddings: 40 centroids of 64 components, 5 rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    near = """SELECT v.rid, min({{'d': list_sum(list_transform(range(1, {n}), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT, 'c': c.c}}) AS m FROM v, {c} c GROUP BY v.rid""".format
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({near(n=DIMS + 1, c=f'c{r}')})")
        steps.append(f"u{r} AS (SELECT a.m.c AS c, i, sum(v.e[i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid), (SELECT unnest(range(1, {DIMS + 1})) AS i) GROUP BY 1, 2)")
        steps.append(f"m{r} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS e FROM u{r} GROUP BY c)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)")
    return f"""
WITH k AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, e) AS rid, vec_id, e FROM (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM k)),
c0 AS MATERIALIZED (SELECT (rid - 1)::INT AS c, e FROM v WHERE rid <= {CENTROIDS}),
{', '.join(steps)},
f AS MATERIALIZED ({near(n=DIMS + 1, c=f'c{ROUNDS}')})
SELECT vec_id, m.c AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM f JOIN v USING (rid) JOIN c{ROUNDS} c ON c.c = m.c
"""


SQL = _sql()
