"""Collection in rounds: tasks are handed out by the schedule, their results are committed, and the log alone says where to go on."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored
from . import sampling

LOG = "task_id long, accepted boolean, config_hash string, label string, round long"


class Refused(ValueError):
    """A log that must not be gone on with."""


def resumable(log: DataFrame, config_hash: str, label: str) -> None:
    """Refuse a log with results of another configuration or label, or with a task that comes again."""
    other = log.where(~F.col("config_hash").eqNullSafe(config_hash) | ~F.col("label").eqNullSafe(label)).select("task_id").limit(5).collect()
    if other:
        raise Refused(f"results of another configuration or label: {[r.task_id for r in other]}")
    again = log.groupBy("task_id").agg(F.count("*").alias("n")).where("n > 1").select("task_id").limit(5).collect()
    if again:
        raise Refused(f"tasks come again: {[r.task_id for r in again]}")


class Collection:
    """Rounds of attempts at tasks until the targets of all cells are reached, or nothing more can or may be done.

    ``attempt`` makes (task_id, accepted) of a round's tasks. ``pause`` looks at the log after a round and names reasons to stop. A round is committed by a
    rename of its whole folder to its number: it is there or not. A collector that dies before loses its round only, and another one hands out the same tasks again.

    A cell whose tasks are refused would take as many rounds as it has tasks. With ``ahead`` a round may be as long as all rounds before it together, and a cell gets what
    its target needs at its rate of acceptance up to now, so rounds grow with the logarithm of the tasks. Of its results those after the one that fills the cell are
    not committed, so the log is that of a collection without ``ahead``, but for rounds; what is not committed does not count for ``max_attempts``.
    """

    def __init__(
        self, spark: SparkSession, base: str, tasks: DataFrame, targets: DataFrame, attempt: Callable[[DataFrame], DataFrame], per_round: int,
        max_attempts: int | None = None, config_hash: str = "", label: str = "", pause: Callable[[DataFrame], list[str]] | None = None, seed: int = 42, ahead: bool = False,
    ) -> None:
        self.spark, self.base, self.tasks, self.targets, self.attempt = spark, base.rstrip("/"), tasks, targets, attempt
        self.per_round, self.max_attempts, self.config_hash, self.label, self.pause, self.seed, self.ahead = per_round, max_attempts, config_hash, label, pause, seed, ahead
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path, self._fs = path, path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path(f"{self.base}/log"))
        resumable(self.log(), config_hash, label)

    def rounds(self) -> int:
        """Rounds that are committed."""
        return sum(f.getPath().getName().startswith("round=") for f in self._fs.listStatus(self._path(f"{self.base}/log")))

    def log(self) -> DataFrame:
        """All committed results."""
        return self.spark.read.schema(LOG).parquet(f"{self.base}/log") if self.rounds() else self.spark.createDataFrame([], LOG)

    def round(self) -> str | None:
        """Hand out, attempt and commit once; a reason if the collection is at its end."""
        number, log = self.rounds(), self.log()
        done = log.count() if self.ahead or self.max_attempts is not None else 0
        room = max(self.per_round, done) if self.ahead else self.per_round
        room = room if self.max_attempts is None else min(room, self.max_attempts - done)
        if room <= 0:
            return "max_attempts"
        due = sampling.handed_out(self.tasks, self.targets, log.select("task_id", "accepted"), room, self.seed, self.ahead)
        if self.ahead:
            due = stored(due)
            before = F.coalesce(F.count_if("accepted").over(Window.partitionBy(*sampling.CELL).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            got = self.attempt(due.drop("lack")).select("task_id", "accepted").join(due, "task_id").withColumn("before", before).where("before < lack")
        else:
            got = self.attempt(due)
        results = got.select(F.col("task_id").cast("long").alias("task_id"), "accepted", F.lit(self.config_hash).alias("config_hash"), F.lit(self.label).alias("label"))
        part = f"{self.base}/open-{uuid.uuid4().hex}"
        results.write.parquet(part)
        if not self.spark.read.parquet(part).limit(1).count():
            self._fs.delete(self._path(part), True)
            return "complete"
        target = self._path(f"{self.base}/log/round={number}")
        if self._fs.exists(target) or not self._fs.rename(self._path(part), target):
            raise Refused(f"another collector has committed round {number}")
        reasons = self.pause(self.log()) if self.pause else []
        return "paused: " + ", ".join(sorted(set(reasons))) if reasons else None

    def run(self, most: int | None = None) -> str:
        """Rounds until the end, or ``most`` of them; why it stopped."""
        done = 0
        while most is None or done < most:
            why = self.round()
            if why:
                return why
            done += 1
        return "rounds"
