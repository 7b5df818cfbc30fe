"""Operators 11 and 12 against brute force and SQL."""

import hashlib
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from tallyforge.llm import centroid_clusters, vector_codes
from tallyforge.llm._vectors import MOST, vectors

from ._oracle import oracle, rows

DATA = "/root/testdata/sf0.001"


def table(spark, data, kind="vec_id long, embedding array<double>, label int"):
    return spark.createDataFrame(data, kind).repartition(3)


def crowd(n=400, dims=64, spread=12, seed=1):
    """Few values, so that there are ties, repeated vectors and repeated ids."""
    rng = random.Random(seed)
    out = [(rng.randrange(2 * n), [(rng.randrange(-spread, spread) + 0.5) / 256 for _ in range(dims)], rng.choice([None, 1, 1, 1, 2])) for _ in range(n)]
    out += out[:40] + [(None, out[3][1], 2), (None, out[3][1], None), (5, [0.0] * dims, 9), (6, [-0.0] * dims, 9)]
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None] + [0.5] * (dims - 1), [math.nan] + [0.5] * (dims - 1), [0.5] * (dims - 1) + [math.inf], [-math.inf] * dims]
    return out + [(-i, b, 3) for i, b in enumerate(bad)]


def whole(x):
    return x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x)


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def last(x):
    return (x is None, x or 0)


def moved(points, book):
    """(nearest entry of each point, book after one round), in plain Python."""
    near = [min(range(len(book)), key=lambda i: (square(p, book[i]), i)) for p in points]
    out = []
    for i, old in enumerate(book):
        own = [p for p, n in zip(points, near) if n == i]
        out.append([sum(c) // len(own) for c in zip(*own)] if own else old)
    return near, out


def test_codes_against_brute_force(spark):
    data = crowd()
    ints = [(k, [math.floor(256 * v) for v in x], lab) for k, x, lab in data if whole(x)]
    seeds = [x for _, x in sorted(((k, x) for k, x, _ in ints), key=lambda r: (last(r[0]), r[1]))[:64]]
    codes, errors, books = [[] for _ in ints], [0] * len(ints), []
    for p in range(0, 64, 4):
        points, book = [x[p : p + 4] for _, x, _ in ints], [s[p : p + 4] for s in seeds]
        for _ in range(2):
            _, book = moved(points, book)
        near, _ = moved(points, book)
        books += [v for e in book for v in e]
        for i, n in enumerate(near):
            codes[i].append(f"{n:02x}")
            errors[i] += square(points[i], book[n])
    by = {}
    for (_, _, lab), e in zip(ints, errors):
        by[lab] = by.get(lab, 0) + e
    sha = hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()
    want = sorted([(k, "".join(c), e, by[lab], sha) for (k, _, lab), c, e in zip(ints, codes, errors)], key=str)
    got = sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(table(spark, data)).collect()], key=str)
    assert got == want


def test_clusters_against_brute_force(spark):
    data = crowd(300, seed=2)
    ints = [(k, [math.floor(256 * v) for v in x]) for k, x, _ in data if whole(x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    book = [x for _, x in sorted(ints, key=key)[:40]]
    points = [x for _, x in ints]
    for _ in range(5):
        _, book = moved(points, book)
    near, _ = moved(points, book)
    dist = [square(p, book[n]) for p, n in zip(points, near)]
    own = {n: sum(d for d, m in zip(dist, near) if m == n) for n in near}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in book]
    want = sorted([(k, n, d, own[n], sum(dist), sha[n]) for (k, _), n, d in zip(ints, near, dist)], key=str)
    got = sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in centroid_clusters.cluster(table(spark, data)).collect()], key=str)
    assert got == want


@pytest.mark.parametrize("module, f", [(vector_codes, vector_codes.compress), (centroid_clusters, centroid_clusters.cluster)])
def test_against_sql_and_odd_tables(spark, module, f):
    data = [r for r in crowd(200, seed=3)]
    df = table(spark, data)
    assert rows(f(df)) == oracle(module.SQL, embeddings=df)
    # fewer vectors than entries, one vector, none
    for n in (30, 1):
        few = table(spark, [r for r in data if whole(r[1])][:n])
        got = rows(f(few))
        assert got == oracle(module.SQL, embeddings=few) and len(got[1]) == n
    for none in (df.limit(0), df.where("label = 3")):
        got = f(none)
        assert got.count() == 0 and sorted(got.columns) == oracle(module.SQL, embeddings=none)[0]
    # other types of ids, labels and numbers; names that clash
    base = [r for r in data if whole(r[1]) and r[0] is not None]
    as_text = spark.createDataFrame([(f"v{k:05d}", [Decimal(str(v)) for v in x], str(lab), 1, "s") for k, x, lab in base], "vec_id string, embedding array<decimal(12,9)>, label string, code int, `a.b` string")
    as_int = spark.createDataFrame([(k, x, lab, 2.0) for k, x, lab in base], "vec_id int, embedding array<float>, label int, distance double")
    for other, kind in ((as_text, "string"), (as_int, "int")):
        out = f(other)
        assert dict(out.dtypes)["vec_id"] == kind and out.count() == len(base)
    assert rows(f(as_int)) == oracle(module.SQL, embeddings=as_int)


def test_huge_components_are_taken_as_the_largest(spark):
    huge = [(1, [1e300] * 64, 1), (2, [-1e300] * 64, 1), (3, [MOST / 256.0] * 64, 1), (4, [0.0] * 64, None)]
    got = {r.vec_id: r for r in vector_codes.compress(table(spark, huge)).collect()}
    assert got[1].code == got[3].code and {r.error for r in got.values()} == {0}
    got = {r.vec_id: r for r in centroid_clusters.cluster(table(spark, huge), many=1).collect()}
    assert len({r.distance for r in got.values()}) >= 2 and all(r.distance >= 0 for r in got.values())


def test_cells_bound_every_distance():
    rng = np.random.default_rng(0)
    for bits in (1, 2, 4, 6):
        book, q = rng.integers(-300, 300, (64, 4)), rng.integers(-900, 900, (500, 4))
        cells = vector_codes.Cells(book, bits)
        lower, upper = cells.bounds(q.T.copy())
        exact = ((book[:, None] - q[None]) ** 2).sum(2)
        assert (lower <= exact).all() and (exact <= upper).all()
        best, dist, taken = cells.nearest(q)
        assert (best == exact.argmin(0)).all() and (dist == exact.min(0)).all()
        assert taken < exact.size if bits > 2 else taken <= exact.size


def test_partial_distances_abandon_and_stay_exact():
    rng = np.random.default_rng(0)
    c = rng.integers(-200, 200, (40, 64))
    x = c[rng.integers(0, 40, 700)] + rng.integers(-20, 20, (700, 64))
    x[:50] = (c[7] + c[3]) // 2
    exact = ((x[:, None] - c[None]) ** 2).sum(2)
    for step in (1, 8, 64):
        best, dist, finished = centroid_clusters.nearest(x, c, step)
        assert (best == exact.argmin(1)).all() and (dist == exact.min(1)).all()
    assert centroid_clusters.nearest(x, c, 8)[2] < 2000 < exact.size


def test_codes_decode_to_their_entries(spark):
    df = vectors(spark.read.parquet(f"{DATA}/embeddings.parquet"), "vec_id", "label")
    books = vector_codes.train(df)
    codes = vector_codes.encode(df, books)
    got = vector_codes.decode(codes, books).join(df, "vec_id").collect()
    for r in got:
        assert sum((math.floor(256 * v) - a) ** 2 for v, a in zip(r.embedding, r.approx)) == r.error
    assert len(got) == df.count()
