"""Embeddings as integer vectors, and sums over groups of them, for the operators on vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import numbered, only

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Larger integers (either sign) are taken as this one, so that a squared distance over 64 components fits a long.
MOST = 1 << 27
#: Vectors worked on at a time.
SLAB = 2048


def vectors(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns beside ``embedding``, as an array of doubles, whatever numbers it holds."""
    return only(df, *columns, "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """The types of some columns of ``df``, and more."""
    return T.StructType([T.StructField(c, df.schema[c].dataType) for c in columns] + T.StructType.fromDDL(more).fields)


def integers(batch: pa.RecordBatch, dims: int) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows of a batch whose vector has ``dims`` components, none null or not finite, and their integers."""
    col = batch.column(batch.schema.get_field_index("embedding"))
    fits = pc.fill_null(pc.equal(pc.list_value_length(col), dims), False)
    batch = batch.filter(fits)
    col = batch.column(batch.schema.get_field_index("embedding"))
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dims)
    finite = np.isfinite(x).all(axis=1)
    if not finite.all():
        batch, x = batch.filter(pa.array(finite)), x[finite]
    with np.errstate(over="ignore"):
        return batch, np.clip(np.floor(x * SCALE), -MOST, MOST).astype(np.int64)


def mapped(df: DataFrame, schema: "str | T.StructType", dims: int, f: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """``f`` of slabs of kept rows and their integers."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = integers(batch.rename_columns(names), dims)
            for at in range(0, len(x), SLAB):
                yield f(rows.slice(at, SLAB), x[at : at + SLAB])

    return numbered(df).mapInArrow(run, schema)


def summed(df: DataFrame, dims: int, groups: int, width: int, f: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and componentwise sums of the vectors of each group below ``groups``, over all rows.

    ``f`` gives (group of each row, rows of ``width`` integers) for a slab. Each task adds up its own rows first, so what is shuffled
    and what reaches the driver is one row a group (and task).
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
        for batch in batches:
            _, x = integers(batch.rename_columns(names), dims)
            for at in range(0, len(x), SLAB):
                for g, rows in f(x[at : at + SLAB]):
                    count += np.bincount(g, minlength=groups)
                    order = np.argsort(g, kind="stable")
                    first = np.flatnonzero(np.diff(g[order], prepend=-1))
                    if len(first):
                        total[g[order][first]] += np.add.reduceat(rows[order], first, axis=0)
        got = np.flatnonzero(count)
        lists = pa.ListArray.from_arrays(np.arange(0, len(got) * width + 1, width, dtype=np.int32), total[got].ravel())
        yield pa.record_batch({"g": got.astype(np.int32), "n": count[got], "s": lists})

    parts = numbered(df).mapInArrow(run, "g int, n long, s array<long>")
    sums = parts.groupBy("g").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)])
    count, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
    for row in sums.collect():  # one row a group
        count[row[0]], total[row[0]] = row[1], row[2:]
    return count, total


def first_rows(df: DataFrame, dims: int, many: int, *order: F.Column) -> np.ndarray:
    """The integers of the first ``many`` kept rows in that order; ties go by the integers themselves."""
    kept = mapped(
        df,
        schema_of(df, ["vec_id"], "x array<long>"),
        dims,
        lambda rows, x: pa.record_batch({"vec_id": rows.column(rows.schema.get_field_index("vec_id")), "x": pa.ListArray.from_arrays(np.arange(0, x.size + 1, dims, dtype=np.int32), x.ravel())}),
    )
    got = [r.x for r in kept.orderBy(*order, "x").limit(many).collect()]
    return np.array(got, np.int64).reshape(len(got), dims)
