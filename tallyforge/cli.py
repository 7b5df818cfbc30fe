"""Commands over tables and JSON lines: python -m tallyforge COMMAND --help."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import agent, schemas
from .config import CONFIG, load, problems
from .operators import audit, checks, collection, diagnostics, groups, ledger, metrics, report, sampling, split, training
from .session import local_session
from .sources import files, jsonl

VERSION = "0.1"


def _read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table, or JSON lines."""
    if path.endswith((".jsonl", ".json")):
        return jsonl.read_jsonl(spark, path, schema) if schema else spark.read.json(path)
    return spark.read.parquet(path)


def _views(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        name, _, path = p.partition("=")
        spark.read.parquet(path).createOrReplaceTempView(name)


def _show(value: object) -> None:
    print(value if isinstance(value, str) else json.dumps(value, sort_keys=True, indent=1, default=str))


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def inventory(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tasks and size of each database."""
    t = _read(spark, a.tasks)
    _show(_rows(audit.inventory(t.select(F.col("db_id").alias("name"), F.length("question").alias("size"))).orderBy("name")))


def run_audit(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run a workload of statements twice and write its records."""
    _views(spark, a.table)
    examples = _rows(_read(spark, a.examples).select("task_id", "db_id", "sql"))
    records = audit.run(spark, [{**e, "source_index": i} for i, e in enumerate(examples)], a.workers, timeout=a.timeout)
    jsonl.write_jsonl(records, a.out)
    _show(_rows(audit.summary(jsonl.read_jsonl(spark, a.out, schemas.AUDIT)).orderBy("status")))


def make_split(spark: SparkSession, a: argparse.Namespace) -> None:
    """Split tasks by database, and say what leaks."""
    t = _read(spark, a.tasks)
    out = split.assign(t, split.validation_groups(split.group_counts(t), a.seed))
    out.write.mode("overwrite").parquet(a.out)
    s = spark.read.parquet(a.out)
    train, dev = s.where("split = 'train'"), s.where("split = 'validation'")
    _show({"counts": _rows(s.groupBy("split").count()), "exact": split.exact_overlap(train, dev).count(), "near": split.near_pairs(train, dev).count(), "shared": _rows(split.overlaps(train, dev, ["db_id"]))})


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    """Summarise evaluation records."""
    _show(_rows(metrics.summarize(_read(spark, a.records, schemas.EVALUATION)))[0])


def make_report(spark: SparkSession, a: argparse.Namespace) -> None:
    """One run's report."""
    _show(report.run_report(_read(spark, a.records, schemas.EVALUATION), a.label))


def compare(spark: SparkSession, a: argparse.Namespace) -> None:
    """A report of several runs (LABEL=PATH)."""
    runs = None
    for part in a.runs:
        label, _, path = part.partition("=")
        one = _read(spark, path, schemas.EVALUATION).withColumn("label", F.lit(label))
        runs = one if runs is None else runs.unionByName(one)
    _show(report.compare_report(runs, tuple(p.partition("=")[0] for p in a.runs)))


def plan(spark: SparkSession, a: argparse.Namespace) -> None:
    """Targets of a stratified sample."""
    t = _read(spark, a.tasks).select("task_id", "split", "db_id", "complexity")
    cells = sampling.plan(t, json.loads(a.targets), seed=a.seed)
    _show({"cells": {":".join(k): n for k, n in sorted(cells.items()) if n}, "hash": sampling.plan_hash(t, cells, a.seed)})


def diagnose(spark: SparkSession, a: argparse.Namespace) -> None:
    """Which rules pause a collection, of attempts with their counters."""
    t = _read(spark, a.attempts)
    _show({"pause_reasons": [r["reason"] for r in _rows(diagnostics.pause_reasons(diagnostics.totals(t)))]})


def next_tasks(spark: SparkSession, a: argparse.Namespace) -> None:
    """Tasks to try next, by a plan's cells (split, db_id, complexity, target) and the log of attempts (task_id, accepted)."""
    out = sampling.handed_out(_read(spark, a.tasks), _read(spark, a.cells), _read(spark, a.log), a.limit, a.seed)
    _show([r.asDict() for r in out.orderBy("place").collect()])


def tools(spark: SparkSession | None, a: argparse.Namespace) -> None:
    """The agent's tools and its system prompt."""
    _show({"tools": agent.tool_specs(), "system_prompt": agent.system_prompt()})


def sft(spark: SparkSession, a: argparse.Namespace) -> None:
    """Token ids and labels of conversations (conv_id, turn, role, text)."""
    training.action_only(training.conversations(_read(spark, a.messages)), max_length=CONFIG.max_context_tokens).write.mode("overwrite").parquet(a.out)


def filter_groups(spark: SparkSession, a: argparse.Namespace) -> None:
    """Select diverse groups of rollouts (uid, idx, reward)."""
    r = _read(spark, a.rollouts)
    groups.selected_rows(r, groups.select_diverse(groups.analyze(r), a.quota)).write.mode("overwrite").parquet(a.out)


def run_agent(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run a scripted episode: a JSON file of answers."""
    _views(spark, a.table)
    with open(a.answers, encoding="utf-8") as f:
        answers = json.load(f)
    _show(agent.run_episode(agent.scripted(answers), agent.Toolbox(spark), {"question": a.question}, a.gold))


def replay(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run a recorded episode again and compare."""
    _views(spark, a.table)
    with open(a.episode, encoding="utf-8") as f:
        episode = json.load(f)
    _show(agent.replay(episode, agent.Toolbox(spark), {"question": a.question}, a.gold))


def clean_dev(spark: SparkSession, a: argparse.Namespace) -> None:
    """Examples (task_id, ...) that their audit records let into the evaluation."""
    kept = audit.final_filter(_read(spark, a.records, schemas.AUDIT)).select("task_id")
    examples = _read(spark, a.examples)
    jsonl.write_jsonl(examples.join(kept, "task_id", "left_semi"), a.out)
    _show({"examples": examples.count(), "kept": jsonl.read_jsonl(spark, a.out, examples.schema.simpleString()[7:-1].replace(":", " ")).count()})


def rollout(spark: SparkSession, a: argparse.Namespace) -> None:
    """Run an episode for each task (task_id, question, db_id, gold_sql, answers: what a policy says in turn) that the log lacks, and append it.

    A log of another configuration or label, or with a task twice, is refused.
    """
    _views(spark, a.table)
    log = files.RecordLog(spark, a.log)
    kind = "task_id string, config_hash string, label string, terminal_reason string, reward double"
    done = log.read(kind)
    collection.resumable(done, a.config_hash, a.label)
    tasks = _read(spark, a.tasks).withColumn("task_id", F.col("task_id").cast("string"))
    for r in ledger.pending(tasks, done, ["task_id"]).orderBy("task_id").toLocalIterator():
        task = {k: str(r[k]) for k in ("task_id", "question", "db_id") if k in r}
        episode = agent.run_episode(agent.scripted(r["answers"]), agent.Toolbox(spark), task, r["gold_sql"], f"{a.label}:{r['task_id']}")
        log.append({**episode, "config_hash": a.config_hash, "label": a.label})
    _show(_rows(log.read(kind).groupBy("terminal_reason").agg(F.count("*").alias("n"), F.avg("reward").alias("reward")).orderBy("terminal_reason")))


def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    """What a judge is shown of episodes, written to OUT; or, with scores, those whose citations do not hold."""
    episodes = _read(spark, a.episodes)
    if a.scores is None:
        jsonl.write_jsonl(episodes.select("episode_id", checks.blind(episodes.columns).alias("payload")), a.out)
        return _show({"episodes": episodes.count()})
    events = episodes.select("episode_id", F.explode("events.event_id").alias("event_name"))
    _show(_rows(checks.cited(_read(spark, a.scores), events).orderBy("episode_id")))


def collect(spark: SparkSession, a: argparse.Namespace) -> None:
    """Rounds of a collection: tasks are handed out by cells (split, db_id, complexity, target), and take their results (task_id, accepted) from a table."""
    results = _read(spark, a.results).select("task_id", "accepted")
    attempt = lambda due: due.select("task_id").join(results, "task_id")
    c = collection.Collection(spark, a.base, _read(spark, a.tasks), _read(spark, a.cells), attempt, a.per_round, a.max_attempts, a.config_hash, a.label, seed=a.seed)
    why = c.run(a.rounds)
    _show({"stopped": why, "rounds": c.rounds(), "attempts": c.log().count(), "accepted": c.log().where("accepted").count()})


def hash_files(spark: SparkSession, a: argparse.Namespace) -> None:
    """SHA-256 of files of any size, or their tree hashes."""
    found = files.tree_hashes(spark, a.path) if a.tree else files.file_hashes(spark, a.path)
    _show(_rows(found.orderBy("path")))


def compact(spark: SparkSession, a: argparse.Namespace) -> None:
    """Put the segments of a log together."""
    _show({"segments": files.RecordLog(spark, a.log).compact(a.keep)})


def show_config(spark: SparkSession | None, a: argparse.Namespace) -> None:
    """Settings and the rules they break."""
    c = load(a.path) if a.path else CONFIG
    _show({**vars(c), "problems": problems(c)})


COMMANDS = {
    "inventory": (inventory, [("tasks", {})]),
    "audit": (run_audit, [("examples", {}), ("out", {}), ("--table", {"action": "append", "default": []}), ("--workers", {"type": int, "default": 4}), ("--timeout", {"type": float, "default": 10.0})]),
    "split": (make_split, [("tasks", {}), ("out", {}), ("--seed", {"type": int, "default": 42})]),
    "score": (score, [("records", {})]),
    "report": (make_report, [("records", {}), ("--label", {"default": "run"})]),
    "compare": (compare, [("runs", {"nargs": "+"})]),
    "plan": (plan, [("tasks", {}), ("targets", {}), ("--seed", {"type": int, "default": 42})]),
    "diagnose": (diagnose, [("attempts", {})]),
    "next": (next_tasks, [("tasks", {}), ("cells", {}), ("log", {}), ("--limit", {"type": int, "default": 20}), ("--seed", {"type": int, "default": 42})]),
    "tools": (tools, []),
    "sft": (sft, [("messages", {}), ("out", {})]),
    "groups": (filter_groups, [("rollouts", {}), ("out", {}), ("--quota", {"type": int, "default": 2})]),
    "run": (run_agent, [("answers", {}), ("gold", {}), ("--question", {"default": ""}), ("--table", {"action": "append", "default": []})]),
    "replay": (replay, [("episode", {}), ("gold", {}), ("--question", {"default": ""}), ("--table", {"action": "append", "default": []})]),
    "clean-dev": (clean_dev, [("records", {}), ("examples", {}), ("out", {})]),
    "rollout": (rollout, [("tasks", {}), ("log", {}), ("--config-hash", {"default": ""}), ("--label", {"default": "run"}), ("--table", {"action": "append", "default": []})]),
    "judge": (judge, [("episodes", {}), ("--out", {"default": None}), ("--scores", {"default": None})]),
    "collect": (
        collect,
        [("tasks", {}), ("cells", {}), ("results", {}), ("base", {}), ("--per-round", {"type": int, "default": 20}), ("--max-attempts", {"type": int, "default": None}), ("--rounds", {"type": int, "default": None}), ("--config-hash", {"default": ""}), ("--label", {"default": "run"}), ("--seed", {"type": int, "default": 42})],
    ),
    "hash": (hash_files, [("path", {}), ("--tree", {"action": "store_true"})]),
    "compact": (compact, [("log", {}), ("--keep", {"type": int, "default": 0})]),
    "config": (show_config, [("--path", {"default": None})]),
}


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Run one command."""
    parser = argparse.ArgumentParser(prog="tallyforge", description=__doc__)
    parser.add_argument("--version", action="version", version=VERSION)
    sub = parser.add_subparsers(required=True)
    for name, (f, options) in COMMANDS.items():
        p = sub.add_parser(name, help=f.__doc__)
        for flag, how in options:
            p.add_argument(flag, **how)
        p.set_defaults(run=f)
    got = parser.parse_args(sys.argv[1:] if args is None else args)
    got.run(spark or (None if got.run in (show_config, tools) else local_session()), got)
