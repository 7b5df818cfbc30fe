"""Guarded execution of a query: caps on rows, bytes and time, a set digest, and statuses for failures."""

from __future__ import annotations

import hashlib
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import guard

MAX_ROWS, MAX_BYTES, TIMEOUT = 100_000, 64 * 1024 * 1024, 10.0
#: Error conditions of the engine and their statuses, first match first.
CONDITIONS = (
    ("timeout", r"SPARK_JOB_CANCELLED|cancelled|RECURSION_LEVEL_LIMIT|RECURSION_ROW_LIMIT"),
    ("unsupported_function", r"UNRESOLVED_ROUTINE|UNRESOLVABLE_TABLE_VALUED_FUNCTION"),
    ("missing_table_or_column", r"TABLE_OR_VIEW_NOT_FOUND|UNRESOLVED_COLUMN|UNRESOLVED_FIELD|FIELD_NOT_FOUND|SCHEMA_NOT_FOUND"),
    ("syntax_error", r"PARSE_SYNTAX_ERROR|PARSE_EMPTY_STATEMENT"),
)


@dataclass
class Execution:
    """Outcome of one execution."""

    status: str
    digest: str | None = None
    row_count: int = 0
    unique_row_count: int = 0
    result_bytes: int = 0
    elapsed_ms: float = 0.0
    empty_result: bool = False
    result_too_large: bool = False
    error: str | None = None
    columns: list[str] = field(default_factory=list)
    preview: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)


def classify_failure(message: str, timed_out: bool = False) -> str:
    """Status of an engine error."""
    if timed_out:
        return "timeout"
    for status, pattern in CONDITIONS:
        if re.search(pattern, message):
            return status
    return "engine_error"


def canonical(df: DataFrame) -> DataFrame:
    """Canonical rows."""
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.select(X.canonical_row(named.dtypes, [F.col(c) for c in named.columns]).alias("row"))


def digest_of(rows: DataFrame) -> DataFrame:
    """One row: digest, row_count, unique_row_count, result_bytes of canonical rows.

    A digest is one stream over sorted rows, so one task reads them all; they are sorted before, on disk where needed, and only counters stay in memory.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, last, n, unique, size = hashlib.sha256(), None, 0, 0, 0
        for batch in batches:
            for r in batch.column(0).to_pylist():
                b = r.encode()
                n, size = n + 1, size + len(b)
                if b != last:
                    unique, last = unique + 1, b
                    h.update(len(b).to_bytes(8, "big") + b)
        yield pa.record_batch({"digest": [h.hexdigest()], "row_count": [n], "unique_row_count": [unique], "result_bytes": [size]})

    one = rows.repartition(1).sortWithinPartitions("row").mapInArrow(hashed, "digest string, row_count long, unique_row_count long, result_bytes long")
    count = lambda c: F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c)
    return one.agg(F.coalesce(F.max("digest"), F.lit(hashlib.sha256().hexdigest())).alias("digest"), count("row_count"), count("unique_row_count"), count("result_bytes"))


def multiset_digest(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """One row: digest, row_count of canonical rows as a multiset (or as a set), in whatever order and partitions.

    Each row's SHA-256 is taken as four 64-bit numbers, which are summed; the digest is the SHA-256 of the sums and the count. So every task sums its own rows, and
    a row that is changed, added, lost or repeated changes the digest (repeated ones count once with ``distinct``).
    """
    r = rows.distinct() if distinct else rows
    h = r.select(F.sha2(F.col("row"), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"s{i}") for i in range(4)]
    sums = h.agg(F.count("*").alias("row_count"), *parts)
    text = F.concat_ws(":", F.col("row_count").cast("string"), *[F.coalesce(F.col(f"s{i}").cast("string"), F.lit("0")) for i in range(4)])
    return sums.select(F.sha2(text, 256).alias("digest"), "row_count")


#: Inner joins without equal keys as cartesian products whose rows lie in Spark's sorter, which looks at each row whether its task was stopped; a loop over a broadcast never looks.
STOPPABLE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.cartesianProductExec.buffer.in.memory.threshold": "1",
}
#: Seconds between two attempts to stop what a late statement has started since.
AGAIN = 0.2


def _stoppable(spark: SparkSession, df: DataFrame, again: Callable[[SparkSession], DataFrame]) -> DataFrame:
    """``df``, or what ``again`` makes in a copy of the session whose joins end when they are cancelled, if it has others. The session's own settings stay, since other threads use it."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan:
        return df
    copy = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in STOPPABLE.items():
        copy.conf.set(k, v)
    return again(copy)


def run_sql(spark: SparkSession, sql: str, timeout: float = TIMEOUT, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, preview: int = 0, keep_rows: bool = False) -> Execution:
    """Guard, run and digest one query over the session's views.

    A result beyond the caps still passes, with ``result_too_large``; its digest covers what was read, the
    row that broke the cap included. Rows are streamed to the driver in order, up to the caps.
    """
    began = time.perf_counter()
    try:
        guard.validate(spark, sql)
    except guard.UnsafeSQL as e:
        return Execution("unsafe_sql", error=str(e))
    except guard.BadSyntax as e:
        return Execution("syntax_error", error=str(e))
    group, late, done = uuid.uuid4().hex, threading.Event(), threading.Event()
    sc = spark.sparkContext

    def stop() -> None:
        late.set()
        sc._jsc.sc().cancelJobGroupAndFutureJobs(group)  # a statement that is still planned has no job yet
        while not done.wait(AGAIN):
            sc.cancelJobGroup(group)

    timer = threading.Timer(timeout, stop)
    out = Execution("passed")
    sc.setJobGroup(group, "guarded query", interruptOnCancel=True)
    timer.start()
    try:
        df = spark.sql(guard.statements(sql)[0])
        out.columns = df.columns

        def pick(df: DataFrame) -> DataFrame:
            named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
            row = X.canonical_row(named.dtypes, [F.col(c) for c in named.columns]) if named.columns else F.lit("[]")
            return named.limit(max_rows + 1).select(row.alias("row"), *(named.columns if keep_rows else []))

        picked = _stoppable(spark, pick(df), lambda copy: pick(copy.sql(guard.statements(sql)[0])))
        if late.is_set():
            raise TimeoutError("SPARK_JOB_CANCELLED")
        seen: set[str] = set()
        for r in picked.toLocalIterator():
            out.row_count += 1
            out.result_bytes += len(r["row"].encode())
            seen.add(r["row"])
            if keep_rows:
                out.rows.append(tuple(r[1:]))
            if len(out.preview) < preview:
                out.preview.append(r["row"])
            if out.row_count > max_rows or out.result_bytes > max_bytes:
                out.result_too_large = True
                break
            if late.is_set():
                raise TimeoutError("SPARK_JOB_CANCELLED")
        out.unique_row_count = len(seen)
        out.digest = python_digest(seen)
        out.empty_result = out.row_count == 0
    except Exception as e:  # the engine's errors have many classes; the message names the condition
        out = Execution(classify_failure(str(e), late.is_set()), error=str(e)[:2000])
    finally:
        timer.cancel()
        done.set()
        sc.setLocalProperty("spark.jobGroup.id", None)
    out.elapsed_ms = (time.perf_counter() - began) * 1000
    return out


def python_digest(rows: set[str]) -> str:
    """SHA-256 of a set of texts: each one, sorted, after its length in 8 bytes."""
    h = hashlib.sha256()
    for r in sorted(rows, key=str.encode):
        b = r.encode()
        h.update(len(b).to_bytes(8, "big"))
        h.update(b)
    return h.hexdigest()
