"""Markdown reports of one run and of several, from aggregated rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .metrics import summarize


def percent(value: float | None) -> str:
    """A share as text."""
    return "n/a" if value is None else f"{100 * value:.2f}%"


def _means() -> list[Column]:
    """Aggregates of the scored records of a run."""
    scored = F.col("ex").isNotNull()
    mean = lambda c: F.round(F.avg(F.when(scored, F.col(c))), 6).alias(c)
    return [F.count("*").alias("tasks"), F.count_if(scored).alias("scored"), mean("ex"), mean("soft_f1"), mean("r_ves")]


def by_run(records: DataFrame, base: str = "base") -> DataFrame:
    """(label, complexity, tasks, scored, ex, soft_f1, r_ves, delta_ex) of runs, as a whole (complexity null) and by complexity.

    delta_ex is the difference from the run ``base`` over the same tasks. ``records``: label, task_id, complexity, ex, soft_f1, r_ves.
    """
    g = records.groupingSets([[F.col("label")], [F.col("label"), F.col("complexity")]], F.col("label"), F.col("complexity")).agg(F.grouping("complexity").alias("whole"), *_means())
    b = g.where(F.col("label") == base).select(F.col("whole").alias("w"), F.col("complexity").alias("c"), F.col("ex").alias("b"))
    j = g.join(b, (F.col("whole") == F.col("w")) & F.col("complexity").eqNullSafe(F.col("c")), "left")
    return j.select("label", F.when(F.col("whole") == 0, F.coalesce("complexity", F.lit("unknown"))).alias("complexity"), "tasks", "scored", "ex", "soft_f1", "r_ves", F.round(F.col("ex") - F.col("b"), 6).alias("delta_ex"))


def error_counts(records: DataFrame) -> DataFrame:
    """(label, error_type, tasks) of records with an error."""
    return records.where("error_type is not null").groupBy("label", "error_type").agg(F.count("*").alias("tasks"))


def comparison_problems(records: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(problem, label) that forbid a comparison: a run is missing, a task comes twice, runs have other tasks, or a task has no score."""
    spark = records.sparkSession
    wanted = spark.createDataFrame([(x,) for x in labels], "label string")
    missing = wanted.join(records.select("label").distinct(), "label", "left_anti").select(F.lit("run is missing").alias("problem"), "label")
    per = records.groupBy("label", "task_id").agg(F.count("*").alias("n"), F.count_if(F.col("ex").isNull()).alias("unscored"))
    twice = per.where("n > 1").select(F.lit("task comes twice").alias("problem"), "label").distinct()
    unscored = per.where("unscored > 0").select(F.lit("task has no score").alias("problem"), "label").distinct()
    every = per.select("task_id").distinct().join(wanted)  # a row for each run, of which there are a few
    other = every.join(per.select("label", "task_id"), ["label", "task_id"], "left_anti").select(F.lit("task is missing").alias("problem"), "label").distinct()
    return missing.unionByName(twice).unionByName(unscored).unionByName(other.join(missing.select("label"), "label", "left_anti"))


def _table(head: str, rows: list[tuple]) -> list[str]:
    """A Markdown table; nothing for no rows."""
    names = head.split(",")
    return ["", "| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(map(str, r)) + " |" for r in rows)] if rows else []


def _number(value: float | None) -> str:
    return "n/a" if value is None else f"{value:.2f}"


def _errors(records: DataFrame) -> list[tuple]:
    return [(r.label, r.error_type, r.tasks) for r in error_counts(records).orderBy("label", F.desc("tasks"), "error_type").collect()]


def run_report(records: DataFrame, label: str, behaviour: Row | None = None, source: dict[str, str] | None = None) -> str:
    """One run: totals, means, difficulties, errors by kind, the agent's behaviour (a row of ``episodes.behavior``), and what it was made from."""
    r = records.withColumn("label", F.lit(label))
    r = r if "complexity" in r.columns else r.withColumn("complexity", F.lit(None).cast("string"))
    s = summarize(records).first()
    lines = [f"# {label}", "", f"Tasks: {s.official_n}; scored: {s.final_n}; excluded: {s.excluded}"]
    lines += _table("Metric,Value", [("EX", percent(s.ex)), ("Soft F1", percent(s.soft_f1)), ("R-VES", _number(s.r_ves))])
    levels = by_run(r, label).where("complexity is not null").orderBy("complexity").collect()
    lines += _table("Difficulty,Tasks,EX,Soft F1,R-VES", [(x.complexity, x.tasks, percent(x.ex), percent(x.soft_f1), _number(x.r_ves)) for x in levels])
    lines += _table("Error,Tasks", [x[1:] for x in _errors(r)])
    lines += _table("Behaviour,Value", list(behaviour.asDict().items()) if behaviour else [])
    return "\n".join(lines + _table("Made from,Value", sorted((source or {}).items()))) + "\n"


def compare_report(records: DataFrame, labels: tuple[str, ...] = ("base", "sft", "grpo"), conditions: dict[str, str] | None = None) -> str:
    """Several runs side by side over the same tasks; ``records`` has a label. Runs that cannot be compared are an error.

    ``conditions`` are digests of what each run was made under, which must agree.
    """
    if conditions is not None and (set(conditions) != set(labels) or len(set(conditions.values())) != 1):
        raise ValueError("the runs' conditions differ")
    found = comparison_problems(records, labels).orderBy("problem", "label").collect()
    if found:
        raise ValueError("; ".join(f"{r.label}: {r.problem}" for r in found))
    r = records if "complexity" in records.columns else records.withColumn("complexity", F.lit(None).cast("string"))
    r = r if "error_type" in r.columns else r.withColumn("error_type", F.lit(None).cast("string"))
    rows = by_run(r, labels[0]).collect()
    place = {x: i for i, x in enumerate(labels)}
    rows.sort(key=lambda x: (x.complexity or "", place[x.label]))
    points = lambda v: "n/a" if v is None else f"{100 * v:+.2f}"
    shown = lambda x: (x.label, x.tasks, percent(x.ex), percent(x.soft_f1), _number(x.r_ves), points(x.delta_ex))
    lines = ["# " + " / ".join(labels)]
    lines += _table(f"Run,Tasks,EX,Soft F1,R-VES,EX against {labels[0]} (points)", [shown(x) for x in rows if x.complexity is None])
    levels = [x for x in rows if x.complexity is not None]
    lines += _table("Difficulty,Run,Tasks,EX,Soft F1,R-VES,Points", [(x.complexity, *shown(x)) for x in levels] if any(x.complexity != "unknown" for x in levels) else [])
    lines += _table("Run,Error,Tasks", _errors(r))
    return "\n".join(lines + _table("Run,Condition", sorted((conditions or {}).items()))) + "\n"
