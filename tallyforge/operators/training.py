"""Training sequences: roles, tokens, masks and padding, on arrays of messages."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
HIDDEN = ("gold_sql", "reward", "correctness")


def rewritten(role: Column, content: Column) -> tuple[Column, Column]:
    """Role and content as the model's interface takes them: a tool's answer comes from the user, in a wrapper."""
    tool = role == "tool"
    wrapped = F.concat(F.lit("<tool_response>\n"), content, F.lit("\n</tool_response>"))
    return F.when(tool, F.lit("user")).otherwise(role), F.when(tool, wrapped).otherwise(content)


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, messages) in the order of turns."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return messages.groupBy("conv_id").agg(m.alias("messages"))


def char_tokens(text: Column) -> Column:
    """Token ids of a text by its characters' codes, a tokenizer for tests."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


def tokenizer(encode: Callable[[str], list[int]]) -> Callable[[Column], Column]:
    """A tokenizer function as a column function, in Arrow batches."""

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([encode(t or "") for t in texts])

    return run


def action_only(conv: DataFrame, tokens: Callable[[Column], Column] = char_tokens, max_length: int = 16_384) -> DataFrame:
    """conv_id, input_ids, labels, attention_mask: only what the assistant says has labels.

    Each message is framed by its role; sequences over ``max_length`` and those without a label are left out.
    """
    m = conv.select("conv_id", F.posexplode("messages").alias("place", "m")).select("conv_id", "place", "m.role", "m.content")
    role, content = rewritten(F.col("role"), F.col("content"))
    m = m.select("conv_id", "place", (F.col("role") == "assistant").alias("own"), tokens(F.concat(F.lit(OPEN), role, F.lit("\n"))).alias("a"), tokens(content).alias("b"), tokens(F.lit(CLOSE)).alias("c"))
    none = lambda x: F.transform(x, lambda _: F.lit(IGNORED))
    ids = F.concat("a", "b", "c")
    labels = F.concat(none("a"), F.when(F.col("own"), F.col("b")).otherwise(none("b")), none("c"))
    parts = F.array_sort(F.collect_list(F.struct("place", ids.alias("ids"), labels.alias("labels"))))
    s = m.groupBy("conv_id").agg(parts.alias("p"))
    s = s.select("conv_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"), F.flatten(F.transform("p", lambda x: x["labels"])).alias("labels"))
    s = s.where((F.size("input_ids") <= max_length) & F.exists("labels", lambda x: x != IGNORED))
    return s.withColumn("attention_mask", F.transform("input_ids", lambda _: F.lit(1)))


def rollout(conv: DataFrame, tokens: Callable[[Column], Column] = char_tokens, limit: int = 16_384) -> DataFrame:
    """conv_id, response_ids, response_mask (1 for actions, 0 for observations), cut at ``limit``."""
    pieces = F.transform("messages", lambda m: F.struct((m["role"] == "assistant").cast("int").alias("own"), tokens(m["content"]).alias("ids")))
    c = conv.select("conv_id", pieces.alias("p"))
    mask = F.flatten(F.transform("p", lambda x: F.transform(x["ids"], lambda _: x["own"])))
    return c.select("conv_id", F.slice(F.flatten(F.transform("p", lambda x: x["ids"])), 1, limit).alias("response_ids"), F.slice(mask, 1, limit).alias("response_mask"))


def collate(batch: DataFrame, key: str, pad_id: int = 0) -> DataFrame:
    """Sequences filled up on the right to the longest of their batch ``key``."""
    from pyspark.sql import Window

    from ..functions.exprs import pad

    b = batch.withColumn("width", F.max(F.size("input_ids")).over(Window.partitionBy(key)))
    fills = {"input_ids": pad_id, "labels": IGNORED, "attention_mask": 0}
    return b.select(*[c for c in batch.columns if c not in fills], *[pad(F.col(c), F.col("width"), f).alias(c) for c, f in fills.items()])


def hidden_fields(df: DataFrame, column: str, keys: tuple[str, ...] = HIDDEN) -> DataFrame:
    """Rows whose JSON text has a field that an actor may not see, with hidden: its names, sorted.

    Fields count at any depth, and inside strings that hold JSON themselves, where quotes are escaped.
    """
    found = F.regexp_extract_all(F.col(column), F.lit(r'"([A-Za-z0-9_]+)\\*"\s*:'), F.lit(1))
    hidden = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isin(*keys))))
    return df.withColumn("hidden", hidden).where(F.size("hidden") > 0)


def inspect(conv: DataFrame) -> DataFrame:
    """(conv_id, problem) of conversations that end with another than the assistant, or start with it, or have an empty turn."""
    m = F.col("messages")
    p = F.when(F.element_at(m, -1)["role"] != "assistant", "last message is not the assistant's").when(m[0]["role"] == "assistant", "first message is the assistant's")
    p = p.when(F.exists(m, lambda x: F.coalesce(F.trim(x["content"]), F.lit("")) == ""), "empty message")
    return conv.select("conv_id", p.alias("problem")).where("problem is not null")


def episode_messages(events: DataFrame) -> DataFrame:
    """(conv_id, messages) of episodes' events (episode_id, step, action, observation): each action is the assistant's, each
    observation a tool's; what follows the last action is left out, since nothing is said after it."""
    from pyspark.sql import Window

    last = F.max("step").over(Window.partitionBy("episode_id"))
    part = lambda turn, role, text: F.struct(turn.alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text"))
    parts = F.array(part(F.col("step") * 2, "assistant", "action"), F.when(F.col("step") < last, part(F.col("step") * 2 + 1, "tool", "observation")))
    e = events.select("episode_id", parts.alias("p")).select(F.col("episode_id").alias("conv_id"), F.explode(F.array_compact("p")).alias("m"))
    return conversations(e.where("m.text is not null").select("conv_id", "m.turn", "m.role", "m.text"))
