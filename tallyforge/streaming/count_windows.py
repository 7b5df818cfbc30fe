"""Windows by count on a stream of attempts: each closes at its hundredth attempt and is judged; the open one is judged from 20 attempts on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diagnostics as D
from .fold import Fold, Tables

CELL = ("split", "db_id", "complexity")
_SUMS = ", ".join(f"{c} long" for c in D.TALLIES)
OPEN = f"window long, {_SUMS}"
CELLS = "window long, split string, db_id string, complexity string, execute_calls long, execute_timeouts long"
WINDOW = "window long, attempts long, accepted long, partial boolean"
REASON = "window long, attempts long, reason string"


class CountWindows:
    """Windows of ``size`` attempts in the order in which they come, and by ``order`` in a batch.

    Attempts are numbered by ranges and the number of those before; each batch adds its own sums to those of the open window. The state is one row of sums
    and one row for each cell of the open window.
    """

    def __init__(self, spark: SparkSession, base: str, order: str, size: int = 100, target: float = 0.75, **spending) -> None:
        self.size, self.order, self.target, self.spending = size, order, target, spending
        self.fold = Fold(spark, base, {"open": OPEN, "cells": CELLS, "seen": "seen long"}, {"windows": WINDOW, "reasons": REASON}, self.step)

    def step(self, df: DataFrame, state: Tables, number: int) -> tuple[Tables, Tables, bool]:
        """One micro-batch of attempts (as ``diagnostics.totals`` takes them)."""
        row = state["seen"].first()
        before = row.seen if row else 0
        a = D.sequence(df, self.order)
        at = F.col("seq") + before - 1
        a = a.withColumn("window", F.floor(at / self.size)).withColumn("seq", at % self.size + 1)
        sums = D.tallies(a, "window").unionByName(state["open"])
        sums = sums.groupBy("window").agg(*[F.sum(c).alias(c) for c in D.TALLIES]).persist()  # a row for each window of a batch
        cells = D.cell_tallies(a, "window").unionByName(state["cells"]).groupBy("window", *CELL).agg(*[F.sum(c).alias(c) for c in ("execute_calls", "execute_timeouts")])
        seen = before + df.count()
        reasons = D.pause_reasons_by(sums, cells, "window", self.target, **self.spending).where((F.col("attempts") >= D.READY) | (F.col("attempts") == self.size))
        still = F.col("window") == seen // self.size
        windows = sums.where(~still).select("window", F.col("n").alias("attempts"), "accepted", F.lit(False).alias("partial"))
        state = {"open": sums.where(still).select("window", *D.TALLIES), "cells": cells.where(still), "seen": df.sparkSession.createDataFrame([(seen,)], "seen long")}
        return {"windows": windows, "reasons": reasons.select("window", "attempts", "reason")}, state, False

    def windows(self) -> DataFrame:
        """All windows so far; the open one, if it has attempts, is partial."""
        held = self.fold.held(self.fold.last())["open"].select("window", F.col("n").alias("attempts"), "accepted", F.lit(True).alias("partial"))
        return self.fold.results("windows").drop("batch").unionByName(held)

    def reasons(self, closed: bool = True) -> DataFrame:
        """(window, reason) of closed windows, or (window, attempts, reason) whenever a rule held while one was open."""
        r = self.fold.results("reasons").drop("batch")
        return r.where(F.col("attempts") == self.size).select("window", "reason") if closed else r.where(F.col("attempts") < self.size)
