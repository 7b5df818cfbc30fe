"""Settings of a campaign and its training, and the rules they must keep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Quotas, weights and limits."""

    target_total: int = 1000
    split_targets: dict[str, int] = field(default_factory=lambda: {"train": 900, "validation": 100})
    weights: dict[str, float] = field(default_factory=lambda: {"simple": 0.3, "moderate": 0.5, "challenging": 0.2})
    max_attempts: int = 1500
    max_episode_actions: int = 10
    max_action_tokens: int = 512
    max_context_tokens: int = 16_384
    max_observation_bytes: int = 8192
    timeout_seconds: float = 10.0
    group_size: int = 4
    groups_per_update: int = 2
    updates: int = 100
    max_generation_batches: int = 10
    seed: int = 42


CONFIG = Config()


def problems(c: Config) -> list[str]:
    """Names of broken rules."""
    out = []
    if sum(c.split_targets.values()) != c.target_total or c.max_attempts < c.target_total:
        out.append("quota")
    if abs(sum(c.weights.values()) - 1) > 1e-9 or min(c.weights.values()) < 0:
        out.append("weights")
    if c.group_size < 2 or c.groups_per_update < 1 or c.max_generation_batches < 1:
        out.append("group_size")
    return out


def broken_rules(configs: DataFrame) -> DataFrame:
    """(name, rule) for each rule that a configuration breaks, of a table of them: name, target_total, max_attempts, group_size, groups_per_update,
    max_generation_batches, split_targets and weights (maps)."""
    total = lambda m, zero: F.aggregate(F.map_values(m), zero, lambda a, b: a + b)
    rules = {
        "quota": (total("split_targets", F.lit(0).cast("long")) != F.col("target_total")) | (F.col("max_attempts") < F.col("target_total")),
        "weights": (F.abs(total("weights", F.lit(0.0)) - 1) > 1e-9) | F.exists(F.map_values("weights"), lambda w: w < 0),
        "group_size": (F.col("group_size") < 2) | (F.col("groups_per_update") < 1) | (F.col("max_generation_batches") < 1),
    }
    return configs.select("name", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(r)) for r, bad in rules.items()]))).alias("rule"))


def rollouts(c: Config) -> tuple[int, int]:
    """Rollouts that a training keeps, and those it may generate at most."""
    kept = c.updates * c.groups_per_update * c.group_size
    return kept, kept * c.max_generation_batches


def load(path: str) -> Config:
    """Settings from a JSON file; an unknown key is an error."""
    import json

    with open(path, encoding="utf-8") as f:
        return Config(**json.load(f))
