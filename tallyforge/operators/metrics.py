"""Scores of predicted results: execution match, soft F1, relative efficiency, and their summary.

Results are rows in long form: pair_id, position, and the row's values as an array of text (numbers in one form, so that
1 and 1.0 are equal and 0.0 and -0.0 too).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def execution_match(predicted: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, ex): 1.0 where the sets of rows are equal; order and repetition do not count."""
    p = predicted.select("pair_id", "row").distinct().withColumn("p", F.lit(1))
    g = gold.select("pair_id", "row").distinct().withColumn("g", F.lit(1))
    odd = p.join(g, ["pair_id", "row"], "full").where("p is null or g is null").select("pair_id").distinct().withColumn("odd", F.lit(True))
    return pairs.select("pair_id").join(odd, "pair_id", "left").select("pair_id", F.when(F.col("odd").isNull(), 1.0).otherwise(0.0).alias("ex"))


def first_seen(rows: DataFrame) -> DataFrame:
    """Distinct rows of each pair by first place, numbered from 1."""
    d = rows.groupBy("pair_id", "row").agg(F.min("position").alias("position"))
    return d.withColumn("at", F.row_number().over(Window.partitionBy("pair_id").orderBy("position"))).select("pair_id", "at", "row")


def soft_f1(predicted: DataFrame, gold: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, soft_f1): distinct rows are aligned by place; a row scores the values it shares with its partner."""
    p, g = first_seen(predicted).withColumnRenamed("row", "p"), first_seen(gold).withColumnRenamed("row", "g")
    both = p.join(g, ["pair_id", "at"], "full")
    share = lambda a, b, keep: F.size(F.filter(a, lambda v: F.exists(b, lambda u: u.eqNullSafe(v)) if keep else ~F.exists(b, lambda u: u.eqNullSafe(v))))
    width = F.size("g")
    part = lambda x: F.when(width == 0, F.lit(0.0)).otherwise(x / width)
    scored = both.select(
        "pair_id",
        F.when(F.col("p").isNull() | F.col("g").isNull(), F.lit(0.0)).otherwise(part(share(F.col("p"), F.col("g"), True))).alias("tp"),
        F.when(F.col("g").isNull(), F.lit(1.0)).when(F.col("p").isNull(), F.lit(0.0)).otherwise(part(share(F.col("p"), F.col("g"), False))).alias("fp"),
        F.when(F.col("p").isNull(), F.lit(1.0)).when(F.col("g").isNull(), F.lit(0.0)).otherwise(part(share(F.col("g"), F.col("p"), False))).alias("fn"),
    )
    s = scored.groupBy("pair_id").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    s = s.withColumn("precision", X.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", X.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    f1 = X.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return pairs.select("pair_id").join(s.withColumn("f1", f1), "pair_id", "left").select("pair_id", F.coalesce("f1", F.lit(1.0)).alias("soft_f1"))


def clean(timings: DataFrame, key: str, value: str) -> DataFrame:
    """Timings within three standard deviations of their group's mean; all of them where none is, or they do not vary."""
    w = Window.partitionBy(key)
    t = timings.withColumn("m", F.avg(value).over(w)).withColumn("s", F.stddev_pop(value).over(w))
    t = t.withColumn("fits", (F.col("s") == 0) | ((F.col(value) > F.col("m") - 3 * F.col("s")) & (F.col(value) < F.col("m") + 3 * F.col("s"))))
    return t.withColumn("some", F.bool_or("fits").over(w)).where("fits or not some").drop("m", "s", "fits", "some")


def efficiency(ratios: DataFrame, key: str = "pair_id", value: str = "ratio") -> DataFrame:
    """(key, r_ves): 100 times the root of the stepwise reward of the mean cleaned ratio."""
    return clean(ratios, key, value).groupBy(key).agg((F.sqrt(X.ratio_reward(F.avg(value))) * 100).alias("r_ves"))


def summarize(records: DataFrame) -> DataFrame:
    """One row: all records, those with a score, means over these, and what is missing."""
    r = records.withColumn("scored", F.col("ex").isNotNull())
    mean = lambda c: F.round(F.avg(F.when(F.col("scored"), F.col(c))), 6).alias(c)
    n = F.count_if("scored")
    return r.agg(F.count("*").alias("official_n"), n.alias("final_n"), (F.count("*") - n).alias("excluded"), mean("ex"), mean("soft_f1"), mean("r_ves"))


def score_records(tasks: DataFrame, answers: DataFrame, predictions: DataFrame) -> DataFrame:
    """Tasks with their answers (all must be there) and predictions (null where there is none)."""
    return tasks.join(answers, "task_id", "inner").join(predictions, "task_id", "left")
