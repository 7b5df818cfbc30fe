"""Campaign ledgers on a stream: episodes counted exactly once, limits that stay, spending that never falls.

Records of one campaign are dealt over shards by their episode, so that a campaign that holds most of the stream is no hot task: repeats of an episode
are dropped by Spark's own keyed state, and a stateful processor keeps each shard's totals. Openings and spending reports of a campaign go to
its first shard, which keeps the limits. ``current`` adds the shards up.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHARDS = 32
#: What an opening freezes.
LIMITS = ("target_total", "max_attempts", "cost_limit_micro", "token_limit")
#: What it may leave open and a later one may fill in, but not change.
HASHES = ("sampling_hash", "pricing_hash")
#: Columns of the records; kind is ``open``, ``report`` or ``attempt``.
RECORD = (
    "campaign string, seq long, kind string, episode_id string, migrated boolean, cost_micro long, tokens long, "
    "target_total long, max_attempts long, cost_limit_micro long, token_limit long, sampling_hash string, pricing_hash string, behaviour string, upgrade boolean"
)
_TOTALS = T.StructType([T.StructField(c, T.LongType()) for c in ("attempts", "spent_micro", "used_tokens", "reported_micro", "reported_tokens", "refused")])
_FROZEN = T.StructType(
    [T.StructField(c, T.LongType()) for c in LIMITS] + [T.StructField(c, T.StringType()) for c in HASHES] + [T.StructField("behaviours", T.ArrayType(T.StringType()))]
)
_HEAD = T.StructType([T.StructField(c, k) for c, k in (("campaign", T.StringType()), ("shard", T.IntegerType()), ("kind", T.StringType()), ("seq", T.LongType()), ("refusal", T.StringType()))])
OUT = T.StructType([*_HEAD, *_TOTALS, *_FROZEN])


def refusal(frozen: tuple | None, r: Row) -> str | None:
    """Why an opening is refused: the first field that it may not change, or may not lack."""
    if r.cost_limit_micro is None and r.token_limit is None:
        return "no limit"
    if frozen is None:
        return None
    for i, c in enumerate(LIMITS + HASHES):
        free = c in HASHES and (frozen[i] is None or r[c] is None)
        if not free and frozen[i] != r[c]:
            return c
    behaviours = frozen[-1]
    return "behaviour" if behaviours and r.behaviour is not None and behaviours[-1] != r.behaviour and not r.upgrade else None


class _Ledger(StatefulProcessor):
    """Totals of a shard, and the limits in the first one. State is read and written once for each key and batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", _TOTALS)
        self.frozen = handle.getValueState("frozen", _FROZEN)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        campaign, shard = key
        attempts, spent, used, high, high_tokens, refused = self.totals.get() if self.totals.exists() else (0,) * 6
        frozen = self.frozen.get() if self.frozen.exists() else None
        openings = []
        for r in rows:
            if r.kind == "attempt":
                attempts, spent, used = attempts + r.n, spent + (r.cost_micro or 0), used + (r.tokens or 0)
            elif r.kind == "report":
                high, high_tokens = max(high, r.cost_micro or 0), max(high_tokens, r.tokens or 0)
            else:
                openings.append(r)
        blank = dict.fromkeys([*_TOTALS.names, *_FROZEN.names])
        for r in sorted(openings, key=lambda r: r.seq):
            why = refusal(frozen, r)
            if why:
                refused += 1
                yield Row(**{"campaign": campaign, "shard": shard, "kind": "refused", "seq": r.seq, "refusal": why, **blank})
                continue
            seen = list(frozen[-1]) if frozen else []
            seen += [r.behaviour] if r.behaviour is not None and (not seen or seen[-1] != r.behaviour) else []
            frozen = (*(frozen[i] if frozen and frozen[i] is not None else r[c] for i, c in enumerate(LIMITS + HASHES)), seen)
        if openings and frozen:
            self.frozen.update(frozen)
        now = (attempts, spent, used, high, high_tokens, refused)
        self.totals.update(now)
        kept = frozen or (None,) * len(_FROZEN.names)
        yield Row(**{"campaign": campaign, "shard": shard, "kind": "totals", "seq": None, "refusal": None, **dict(zip(_TOTALS.names, now)), **dict(zip(_FROZEN.names, kept))})

    def close(self) -> None:
        pass


#: What the processor takes: attempts and reports are summed up in their task, openings are as they are.
_TAKEN = f"campaign string, shard int, kind string, n long, cost_micro long, tokens long, seq long, {', '.join(f'{c} long' for c in LIMITS)}, {', '.join(f'{c} string' for c in HASHES)}, behaviour string, upgrade boolean"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Openings, and at the end of the task one row of attempts (sums) and one of reports (the largest) for each campaign and shard."""
    held: list[pa.Table] = []
    schema = None

    def added() -> pa.Table:
        t = pa.concat_tables(held)
        parts = []
        for kind, how in (("attempt", "sum"), ("report", "max")):
            s = t.filter(pc.equal(t["kind"], kind)).group_by(["campaign", "shard", "kind"]).aggregate([("n", "sum"), ("cost_micro", how), ("tokens", how)])
            parts.append(pa.table({f.name: s[f.name] for f in schema if f.name in ("campaign", "shard", "kind")} | {"n": s["n_sum"], "cost_micro": s[f"cost_micro_{how}"], "tokens": s[f"tokens_{how}"]}))
        return pa.concat_tables(parts)

    for batch in batches:
        schema = pa.schema([f.with_nullable(True) for f in batch.schema])
        t = pa.Table.from_arrays(batch.columns, schema=schema)
        opened = pc.equal(t["kind"], "open")
        yield from t.filter(opened).to_batches()
        held.append(t.filter(pc.invert(opened)).select(["campaign", "shard", "kind", "n", "cost_micro", "tokens"]))
        held[:] = [added()]
    if held and held[0].num_rows:
        t = held[0].combine_chunks()
        full = [t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema]
        yield from pa.Table.from_arrays(full, schema=schema).to_batches()


def ledger(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """A stream of ``RECORD`` as updates (``OUT``): after each batch the totals of the shards that it touched, and a row for each refused opening.

    An attempt counts once by campaign and episode_id, whenever it comes again; one without an episode_id, or migrated, does not count. The first opening freezes
    the limits, the others must repeat them; hashes that were left open can be filled in, and a behaviour changes only by an upgrade. A report says what has been
    spent up to now: the largest counts. A batch's openings are taken by seq, batches as they come.
    """
    counted = (F.col("kind") != "attempt") | (F.col("episode_id").isNotNull() & (F.col("episode_id") != "") & ~F.coalesce("migrated", F.lit(False)))
    own = F.when(F.col("kind") == "attempt", F.col("episode_id")).otherwise(F.concat_ws(":", "kind", "seq"))
    r = records.where(counted & F.col("campaign").isNotNull()).withColumn("own", own).dropDuplicates(["campaign", "kind", "own"])
    shard = F.when(F.col("kind") == "attempt", F.pmod(F.xxhash64("episode_id"), F.lit(shards))).otherwise(0).cast("int")
    names = [x.split()[0] for x in _TAKEN.split(", ")]
    r = r.withColumn("shard", shard).withColumn("n", F.lit(1).cast("long")).select(*names).mapInArrow(_summed, _TAKEN)
    return r.groupBy("campaign", "shard").transformWithState(_Ledger(), OUT, "append", "none")


def current(updates: DataFrame) -> DataFrame:
    """One row a campaign of all ``updates`` (with batch): what is counted and frozen, refusals, and which limits are exceeded.

    What is spent is the sum over the counted episodes, or what was reported if that is more.
    """
    t = updates.where("kind = 'totals'")
    last = t.groupBy("campaign", "shard").agg(F.max_by(F.struct(*_TOTALS.names, *_FROZEN.names), "batch").alias("s")).select("campaign", "shard", "s.*")
    sums = [F.sum(c).alias(c) for c in _TOTALS.names]
    frozen = [F.max_by(c, -F.col("shard")).alias(c) for c in _FROZEN.names]  # the first shard has them
    c = last.groupBy("campaign").agg(*sums, *frozen)
    c = c.withColumn("spent_micro", F.greatest("spent_micro", "reported_micro")).withColumn("used_tokens", F.greatest("used_tokens", "reported_tokens"))
    over = lambda x, limit: F.coalesce(F.col(x) > F.col(limit), F.lit(False))
    return c.select(
        "campaign", "attempts", "spent_micro", "used_tokens", "refused", *_FROZEN.names,
        over("attempts", "max_attempts").alias("over_attempts"), over("spent_micro", "cost_limit_micro").alias("over_cost"), over("used_tokens", "token_limit").alias("over_tokens"),
    )
