"""Groups of rollouts filtered as they come: whole groups are judged, and updates are filled with diverse ones up to a target.

Rollouts come in any number of files. A generation (a batch of the trainer) is taken when all its rollouts are there and all generations before it are taken, so
updates do not depend on how files arrive. The state is the groups of generations that are not taken yet, the uids of the update that is being
filled, and one row of counters; nothing is kept of finished updates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import COUNTERS
from .fold import Fold, Tables

GROUPS = "gen long, uid long, size long, first long, low double, high double, invalid long"
FILLING = "next long, update long, batches long, groups long, mixed long, flat long, ended boolean"
UPDATE = "update long, " + ", ".join(f"{c} {'string' if c == 'status' else 'double' if c == 'effective_group_rate' else 'long'}" for c in COUNTERS)
DECISION = "gen long, uid long, first long, update long, state string"
JUDGED = "uid long, gen long, size long, first long, uniform boolean, invalid long"


def gathered(rollouts: DataFrame) -> DataFrame:
    """Partial groups (``GROUPS``) of rollouts (gen, uid, idx, reward); a reward that is no finite number is counted as invalid."""
    odd = F.col("reward").isNull() | F.isnan("reward") | (F.abs("reward") == float("inf"))
    low, high = F.min("reward").alias("low"), F.max("reward").alias("high")
    return rollouts.groupBy("gen", "uid").agg(F.count("*").alias("size"), F.min("idx").alias("first"), low, high, F.count_if(odd).alias("invalid"))


def merged(*parts: DataFrame) -> DataFrame:
    """Partial groups put together."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    sums = [F.sum("size").alias("size"), F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("invalid").alias("invalid")]
    return both.groupBy("gen", "uid").agg(*sums)


class Filter:
    """Updates of ``target`` diverse groups of ``size`` rollouts from generations of ``generation`` rollouts.

    After ``most`` generations in vain, or ``wanted`` updates, all ends. ``strict`` refuses groups with rewards that are no finite numbers; else only groups
    without any reward are left out.
    """

    def __init__(self, spark: SparkSession, base: str, target: int, size: int, generation: int, most: int = 10**6, wanted: int | None = None, strict: bool = False) -> None:
        self.target, self.size, self.generation, self.most, self.wanted, self.strict = target, size, generation, most, wanted, strict
        self.spark = spark
        self.fold = Fold(spark, base, {"groups": GROUPS, "seen": "uid long", "filling": FILLING}, {"updates": UPDATE, "decisions": DECISION, "judged": JUDGED}, self.step)

    def _summary(self, f: dict, status: str) -> tuple:
        kept = self.target if f["mixed"] >= self.target else 0
        held = min(f["mixed"], self.target)
        counts = (f["batches"], f["groups"], f["groups"] * self.size, f["mixed"], held, kept, kept * self.size, f["flat"], f["mixed"] - held)
        rate = kept / f["groups"] if f["groups"] else 0.0
        return (f["update"], status, *counts, rate, max(0, (f["groups"] - kept) * self.size))

    def _walk(self, tallies: list, f: dict) -> tuple[list, list]:
        """Take generations in their order: updates that end, and (gen, update, groups wanted yet) of each one taken."""
        ended, taken = [], []
        for t in tallies:
            if f["ended"]:
                break
            taken.append((t.gen, f["update"], max(0, self.target - f["mixed"])))
            f.update(next=t.gen + 1, batches=f["batches"] + 1, groups=f["groups"] + t.groups, mixed=f["mixed"] + t.mixed, flat=f["flat"] + t.flat)
            status = "updated" if f["mixed"] >= self.target else "max_batches_exceeded" if f["batches"] >= self.most else None
            if status:
                ended.append(self._summary(f, status))
                f["ended"] = status != "updated" or f["update"] == self.wanted
                f.update(update=f["update"] + 1, batches=0, groups=0, mixed=0, flat=0)
        return ended, taken

    def step(self, df: DataFrame, state: Tables, number: int) -> tuple[Tables, Tables, bool]:
        """One micro-batch of rollouts (gen, uid, idx, reward)."""
        return self._taken(merged(state["groups"], gathered(df)), state, False)

    def _taken(self, groups: DataFrame, state: Tables, all_of_them: bool) -> tuple[Tables, Tables, bool]:
        spark = self.spark
        row = state["filling"].first()
        f = row.asDict() if row else {"next": 0, "update": 1, "batches": 0, "groups": 0, "mixed": 0, "flat": 0, "ended": False}
        none = lambda kind: spark.createDataFrame([], kind)
        if f["ended"]:
            return {"updates": none(UPDATE), "decisions": none(DECISION), "judged": none(JUDGED)}, {"groups": state["groups"], "seen": state["seen"], "filling": state["filling"]}, True
        groups = groups.persist()  # one batch's groups and those that wait
        mixed, there = F.col("low") != F.col("high"), F.col("low").isNotNull()
        sums = [F.count_if(there).alias("groups"), F.count_if(mixed).alias("mixed"), F.count_if(F.col("low") == F.col("high")).alias("flat"), F.sum("size").alias("rollouts")]
        tallies = sorted(groups.groupBy("gen").agg(*sums, F.max("size").alias("largest"), F.sum("invalid").alias("invalid"), F.count_if(F.col("uid").isNull()).alias("nameless")).collect())  # a row for each generation that waits
        for t in tallies:
            if t.largest > self.size or t.rollouts > self.generation or t.nameless or t.gen < f["next"] or (self.strict and t.invalid):
                raise ValueError(f"generation {t.gen}: groups of a wrong size, without a uid, late, or with a reward that is no finite number")
        ready = []
        for t in tallies:
            if not all_of_them and (t.rollouts < self.generation or t.gen != f["next"] + len(ready)):
                break
            ready.append(t)
        ended, taken = self._walk(ready, f)
        of = spark.createDataFrame(taken, "gen long, update long, room long")
        now = groups.join(F.broadcast(of), "gen").where(there)  # as many rows as generations are taken
        again = now.join(state["seen"].select("uid", F.lit(True).alias("before")), "uid", "left").groupBy("update", "uid").agg(F.count("*").alias("n"), F.bool_or("before").alias("before"))
        first_update = min((u for _, u, _ in taken), default=0)
        twice = again.where((F.col("n") > 1) | (F.col("before") & (F.col("update") == first_update))).select("uid").limit(5).collect()
        if twice:
            raise ValueError(f"groups come again in an update: {[r.uid for r in twice]}")
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("gen", mixed).orderBy("first"))  # a generation's groups
        chosen = F.when(~mixed, "uniform").when(place <= F.col("room"), "selected").otherwise("surplus")
        decisions = now.select("gen", "uid", "first", "update", chosen.alias("state"))
        judged = groups.where(F.col("size") == self.size).join(F.broadcast(of), "gen").select("uid", "gen", "size", "first", (F.col("low") == F.col("high")).alias("uniform"), "invalid")
        seen = now.where(F.col("update") == f["update"]).select("uid")
        if first_update in (0, f["update"]):
            seen = seen.unionByName(state["seen"])
        waiting = groups.join(F.broadcast(of.select("gen")), "gen", "left_anti")
        out = {"updates": spark.createDataFrame(ended, UPDATE), "decisions": decisions, "judged": judged}
        kept = {"groups": waiting.select(*[c.split()[0] for c in GROUPS.split(", ")]), "seen": seen, "filling": spark.createDataFrame([tuple(f[c.split()[0]] for c in FILLING.split(", "))], FILLING)}
        return out, kept, f["ended"]

    def finish(self) -> DataFrame:
        """All updates, once no more rollouts come: what waits is taken as it is, and an update that stays short is ``data_exhausted``."""
        number = self.fold.last() + 1
        state = self.fold.held(number - 1)
        out, kept, _ = self._taken(state["groups"], state, True)
        f = kept["filling"].first().asDict()
        updates = self.fold.results("updates").drop("batch").unionByName(out["updates"])
        if not f["ended"] and f["batches"]:
            updates = updates.unionByName(self.spark.createDataFrame([self._summary(f, "data_exhausted")], UPDATE))
        self.rest = {name: out[name] for name in ("decisions", "judged")}
        return updates

    def decisions(self, name: str = "decisions") -> DataFrame:
        """What was decided on each group (or judged, under that name), after ``finish``."""
        return self.fold.results(name).drop("batch").unionByName(self.rest[name])


def ledger(stream: DataFrame, key: str, amount: str) -> DataFrame:
    """Running totals of each account after each batch (key, n, total), as updates."""
    return stream.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias("total"))
