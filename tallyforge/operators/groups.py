"""Groups of rollouts: uniform and diverse ones, selection under a quota, and advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def analyze(rollouts: DataFrame) -> DataFrame:
    """One row a group (uid, idx, reward): size, first index, and whether all rewards are equal."""
    return rollouts.groupBy("uid").agg(
        F.count("*").alias("size"), F.min("idx").alias("first"), F.min("reward").alias("low"), F.max("reward").alias("high"), (F.min("reward") == F.max("reward")).alias("uniform"),
        F.count_if(F.col("reward").isNull() | F.isnan("reward") | (F.abs("reward") == float("inf"))).alias("invalid"),
    )


def problems(groups: DataFrame, size: int) -> DataFrame:
    """(uid, problem) of groups of a wrong size or with a reward that is no finite number."""
    p = F.when(F.col("uid").isNull(), "no uid").when(F.col("size") != size, "wrong size").when(F.col("invalid") > 0, "reward is not finite")
    return groups.select("uid", p.alias("problem")).where("problem is not null")


def select_diverse(groups: DataFrame, quota: int) -> DataFrame:
    """Diverse groups in order of their first index: the first ``quota`` are selected, the others surplus.

    The quota is small; only its place in the order is looked for, by a top-k, and no task sees all groups.
    """
    d = groups.where(~F.col("uniform"))
    edge = d.select("first").orderBy("first").limit(quota).agg(F.max("first").alias("edge"))
    return d.join(F.broadcast(edge)).select("uid", "first", F.when(F.col("first") <= F.col("edge"), "selected").otherwise("surplus").alias("state"))  # edge is one row


def selected_rows(rollouts: DataFrame, selection: DataFrame) -> DataFrame:
    """Rollouts of the selected groups."""
    return rollouts.join(selection.where("state = 'selected'").select("uid"), "uid", "left_semi")


def advantages(rollouts: DataFrame) -> DataFrame:
    """Rewards standardised in their group by the population's deviation; null stays null, equal rewards give 0."""
    w = Window.partitionBy("uid")
    r = rollouts.withColumn("m", F.avg("reward").over(w)).withColumn("s", F.stddev_pop("reward").over(w))
    flat = F.min("reward").over(w) == F.max("reward").over(w)
    a = F.when(F.col("reward").isNull(), F.lit(None)).when(flat, F.lit(0.0)).otherwise((F.col("reward") - F.col("m")) / F.col("s"))
    return r.withColumn("advantage", a).drop("m", "s")


def positional(rewards: DataFrame, size: int) -> DataFrame:
    """Rewards (idx, reward) with uid: every ``size`` neighbours are a group; the number of rows must divide."""
    return rewards.withColumn("uid", F.floor(F.col("idx") / size))


def short_number(value: Column) -> Column:
    """A number with 12 significant digits and no more zeros than it needs; exponents from 1e-5 down and 1e12 up."""
    text = F.format_string("%.11e", value)
    power = F.regexp_extract(text, "e([+-][0-9]+)$", 1).cast("int")
    digits = F.regexp_extract(text, "^-?([0-9.]+)e", 1)
    sign = F.when(text.startswith("-"), "-").otherwise("")
    trimmed = lambda t: F.regexp_replace(F.regexp_replace(t, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = F.concat(F.replace(digits, F.lit(".")), F.repeat(F.lit("0"), F.greatest(power - 11, F.lit(0))))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), plain)
    large = F.concat(F.substr(plain, F.lit(1), power + 1), F.lit("."), F.substr(plain, power + 2))
    tail = F.concat(F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    number = F.when((power < -4) | (power >= 12), F.concat(trimmed(digits), tail)).when(power < 0, trimmed(small)).otherwise(trimmed(large))
    return F.when(value == 0, "0").otherwise(F.concat(sign, number))


def reward_buckets(groups: DataFrame) -> DataFrame:
    """(reward, groups) of uniform groups, the reward as plain text."""
    return groups.where("uniform").groupBy(short_number(F.col("low")).alias("reward")).agg(F.count("*").alias("groups"))


def repeated_groups(rollouts: DataFrame) -> DataFrame:
    """uid of groups that come in more than one batch (batch, uid)."""
    return rollouts.groupBy("uid").agg(F.min("batch").alias("a"), F.max("batch").alias("b")).where("a <> b").select("uid")


def batch_counts(groups: DataFrame) -> DataFrame:
    """(batch, groups, mixed, flat) of judged groups (batch, uid, uniform): diverse and uniform ones."""
    return groups.groupBy("batch").agg(F.count("*").alias("groups"), F.count_if(~F.col("uniform")).alias("mixed"), F.count_if("uniform").alias("flat"))


def assigned(counts: list[tuple[int, int]], target: int, most: int) -> list[tuple[int, int]]:
    """(batch, update) of batches (batch, diverse groups): an update takes batches until it has ``target`` diverse groups; after ``most`` batches in vain all ends."""
    out, update, have, used = [], 1, 0, 0
    for batch, mixed in sorted(counts):
        if have >= target:
            update, have, used = update + 1, 0, 0
        elif used == most:
            break
        out.append((batch, update))
        have, used = have + mixed, used + 1
    return out


#: The names of an update's counters.
COUNTERS = (
    "status generation_batches generated_groups generated_rollouts diverse_groups_seen buffered_diverse_groups retained_groups retained_rollouts "
    "discarded_uniform_groups discarded_surplus_diverse_groups effective_group_rate extra_rollouts"
).split()


def updates(groups: DataFrame, target: int, size: int, most: int) -> DataFrame:
    """One row an update, of judged groups (batch, uid, uniform): its counters (``COUNTERS``), and sums over all updates so far.

    Batches are few and walked through on the driver; everything about groups is one aggregation. An update keeps ``target`` groups of ``size``
    rollouts, or none if the batches allowed (``most``) or the data end before.
    """
    spark = groups.sparkSession
    per = batch_counts(groups)
    walk = assigned([(r.batch, r.mixed) for r in per.select("batch", "mixed").collect()], target, most)
    own = per.join(F.broadcast(spark.createDataFrame(walk, "batch long, update long")), "batch").groupBy("update")
    u = own.agg(F.count("*").alias("generation_batches"), *[F.sum(c).alias(c) for c in ("groups", "mixed", "flat")])
    whole = F.col("mixed") >= target
    kept = F.when(whole, F.lit(target)).otherwise(0).cast("long")
    held = F.least(F.col("mixed"), F.lit(target).cast("long"))
    u = u.select(
        "update",
        F.when(whole, "updated").when(F.col("generation_batches") >= most, "max_batches_exceeded").otherwise("data_exhausted").alias("status"),
        "generation_batches",
        F.col("groups").alias("generated_groups"),
        (F.col("groups") * size).alias("generated_rollouts"),
        F.col("mixed").alias("diverse_groups_seen"),
        held.alias("buffered_diverse_groups"),
        kept.alias("retained_groups"),
        (kept * size).alias("retained_rollouts"),
        F.col("flat").alias("discarded_uniform_groups"),
        (F.col("mixed") - held).alias("discarded_surplus_diverse_groups"),
        (kept / F.col("groups")).alias("effective_group_rate"),
        F.greatest((F.col("groups") - kept) * size, F.lit(0)).alias("extra_rollouts"),
    )
    so_far = Window.orderBy("update").rowsBetween(Window.unboundedPreceding, 0)  # updates are no more than batches
    total = [F.sum(c).over(so_far).alias(f"total_{c}") for c in ("generation_batches", "generated_groups", "retained_groups", "discarded_uniform_groups")]
    return u.select("*", *total)
