"""Folds over a stream: each micro-batch turns small tables of state into new ones, and writes what it has to say.

Batch N reads the state that batch N - 1 left and writes its results and its own state under its number, so a batch that is run again after a failure
replaces itself. What a batch decides depends on the rows so far and never on how files were dealt to batches, if its step keeps to that.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Tables = dict[str, DataFrame]
Step = Callable[[DataFrame, Tables, int], tuple[Tables, Tables, bool]]


class Fold:
    """A fold whose results are under ``base``/out/<name>/batch=N and whose state is under ``base``/state/<name>/batch=N.

    ``state`` and ``out`` give the schemas (DDL) of its tables. ``step`` takes a batch, the state and the number, and returns results, the new state, and whether
    all is done; then the query is stopped, and batches that have begun meanwhile leave everything as it is.
    """

    def __init__(self, spark: SparkSession, base: str, state: dict[str, str], out: dict[str, str], step: Step) -> None:
        self.spark, self.base, self.kinds, self.outs, self.step = spark, base.rstrip("/"), state, out, step

    def _at(self, what: str, name: str, number: int) -> str:
        return f"{self.base}/{what}/{name}/batch={number}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def held(self, number: int) -> Tables:
        """The state after batch ``number``; empty tables before the first."""
        got = {}
        for name, kind in self.kinds.items():
            path = self._at("state", name, number)
            got[name] = self.spark.read.schema(kind).parquet(path) if number >= 0 else self.spark.createDataFrame([], kind)
        return got

    def last(self) -> int:
        """The number of the last batch that left its whole state; -1 before the first."""
        path = f"{self.base}/state/last"
        if not self._exists(path):
            return -1
        return max(r.batch for r in self.spark.read.schema("batch long").parquet(path).collect())

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def take(self, df: DataFrame, number: int) -> bool:
        """Fold one batch in; True if all is done."""
        out, state, done = self.step(df, self.held(number - 1), number)
        for name in self.outs:
            self._write(out[name], self._at("out", name, number))
        for name in self.kinds:
            self._write(state[name], self._at("state", name, number))
        self._write(self.spark.createDataFrame([(number,)], "batch long").coalesce(1), f"{self.base}/state/last/of={number}")
        return done

    def drain(self, stream: DataFrame, until_done: bool = True) -> None:
        """Fold in what is there now and not yet taken; stops before the end if all is done."""
        done = threading.Event()

        def batch(df: DataFrame, number: int) -> None:
            if self.take(df, number):
                done.set()

        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start()
        while q.isActive and not q.awaitTermination(1):
            if done.is_set() and until_done:
                q.stop()
        if q.exception():
            raise q.exception()

    def results(self, name: str) -> DataFrame:
        """All results of that name, with batch."""
        path = f"{self.base}/out/{name}"
        kind = f"{self.outs[name]}, batch long"
        return self.spark.read.schema(kind).parquet(path) if self._exists(path) else self.spark.createDataFrame([], kind)
