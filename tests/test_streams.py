"""Streams: what they give does not depend on how rows arrive, nor on restarts and repeated batches."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import diagnostics, groups
from tallyforge.streaming import budget, campaign, count_windows, group_filter, ingest


def files(df, path, parts, order):
    """Rows in ``parts`` files, written one after another."""
    rows = df.orderBy(order).collect()
    for i in range(parts):
        part = rows[i * len(rows) // parts : (i + 1) * len(rows) // parts]
        if part:
            df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(path)


def read(df, path, most=1):
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", most).parquet(path)


@pytest.fixture(scope="module")
def rollouts(spark):
    rng = random.Random(4)
    rows = [(i, i // 4, i // 80, rng.choice([0.0, 1.0, 1.0, 1.0, None])) for i in range(80 * 30 + 36)]
    return spark.createDataFrame(rows, "idx long, uid long, gen long, reward double")


@pytest.mark.parametrize("parts, most", [(1, 1), (7, 3)])
def test_updates_for_any_files(spark, rollouts, tmp_path, parts, most):
    files(rollouts, f"{tmp_path}/in", parts, "idx")
    f = group_filter.Filter(spark, f"{tmp_path}/out", target=25, size=4, generation=80)
    f.fold.drain(read(rollouts, f"{tmp_path}/in", most))
    got = f.finish().orderBy("update").collect()
    judged = groups.analyze(rollouts).where("uniform is not null").withColumn("batch", F.floor(F.col("uid") / 20))
    want = groups.updates(judged, 25, 4, 10**6).orderBy("update").collect()
    assert [tuple(r[c] for c in groups.COUNTERS) for r in got] == [tuple(r[c] for c in groups.COUNTERS) for r in want]
    assert len(got) > 5 and got[-1].status == "data_exhausted"
    d = f.decisions()
    assert d.count() == judged.count() and d.where("state = 'selected'").groupBy("update").count().agg(F.max("count")).first()[0] == 25


def test_filter_stops_and_refuses(spark, rollouts, tmp_path):
    files(rollouts, f"{tmp_path}/in", 8, "idx")
    f = group_filter.Filter(spark, f"{tmp_path}/out", target=25, size=4, generation=80, wanted=2)
    f.fold.drain(read(rollouts, f"{tmp_path}/in"))
    assert [r.status for r in f.finish().collect()] == ["updated"] * 2
    f.fold.drain(read(rollouts, f"{tmp_path}/in"))  # what comes later changes nothing
    assert f.finish().count() == 2 and f.decisions().agg(F.max("update")).first()[0] == 2
    few = group_filter.Filter(spark, f"{tmp_path}/few", target=1000, size=4, generation=80, most=3)
    few.fold.drain(read(rollouts, f"{tmp_path}/in"))
    assert [r.status for r in few.finish().collect()] == ["max_batches_exceeded"]
    with pytest.raises(ValueError, match="finite"):
        group_filter.Filter(spark, f"{tmp_path}/strict", 5, 4, 80, strict=True)._taken(group_filter.gathered(rollouts), group_filter.Filter(spark, f"{tmp_path}/s", 5, 4, 80).fold.held(-1), False)
    again = rollouts.unionByName(rollouts.where("uid = 3"))
    with pytest.raises(ValueError, match="wrong size"):
        group_filter.Filter(spark, f"{tmp_path}/again", 5, 4, 80).fold.take(again, 0)
    same = spark.createDataFrame([(i, i // 4 % 20, i // 80, float(i % 2)) for i in range(240)], "idx long, uid long, gen long, reward double")
    with pytest.raises(ValueError, match="come again"):
        group_filter.Filter(spark, f"{tmp_path}/same", 50, 4, 80).fold.take(same, 0)


def test_a_batch_that_runs_again_replaces_itself(spark, rollouts, tmp_path):
    f = group_filter.Filter(spark, f"{tmp_path}/out", target=25, size=4, generation=80)
    parts = [rollouts.where(F.col("idx") % 3 == i) for i in range(3)]
    for number, part in enumerate(parts):
        f.fold.take(part, number)
        f.fold.take(part, number)
    once = group_filter.Filter(spark, f"{tmp_path}/once", target=25, size=4, generation=80)
    once.fold.take(rollouts, 0)
    assert sorted(f.finish().collect()) == sorted(once.finish().collect())


def test_count_windows_for_any_files(spark, tmp_path):
    rng = random.Random(1)
    words = ["submitted", "loop", "max_actions"]
    rows = [
        (i, rng.random() < 0.6, "s", f"d{i % 3}", "simple", rng.choice(words), rng.random() < 0.1, rng.random() < 0.05, rng.randrange(4), rng.randrange(2), rng.randrange(3), rng.randrange(2), int(rng.random() < 0.05), rng.choice([None, None, None, "api_transport_error"]))
        for i in range(250)
    ]
    kind = "id long, accepted boolean, split string, db_id string, complexity string, terminal_reason string, protocol boolean, invalid_arguments boolean, execute_calls long, execute_timeouts long, schema_calls long, schema_truncated long, schema_without_columns long, infrastructure_code string"
    a = spark.createDataFrame(rows, kind)
    want = {(r.window, r.attempts, r.accepted, r.partial) for r in diagnostics.windows(diagnostics.sequence(a, "id")).collect()}
    reasons = set()
    for w in range(2):
        part = diagnostics.sequence(a.where(f"id div 100 = {w}"), "id")
        reasons |= {(w, r[0]) for r in diagnostics.pause_rules(diagnostics.totals(part)).where("holds").select("reason").collect()}
    for parts, most in ((1, 1), (6, 4)):
        at = f"{tmp_path}/{parts}-{most}"
        files(a, f"{at}/in", parts, "id")
        w = count_windows.CountWindows(spark, f"{at}/out", "id")
        w.fold.drain(read(a, f"{at}/in", most))
        assert {tuple(r) for r in w.windows().select("window", "attempts", "accepted", "partial").collect()} == want
        assert {tuple(r) for r in w.reasons().collect()} == reasons and reasons
        if parts == 6:
            early = w.reasons(closed=False)
            assert early.where("attempts < 20").count() == 0 and early.count()


def attempt(seq, campaign_, episode, cost, tokens=1, migrated=False):
    return (campaign_, seq, "attempt", episode, migrated, cost, tokens, None, None, None, None, None, None, None, None)


def opening(seq, campaign_, most=10, cost=100, tokens=None, pricing=None, behaviour="b", upgrade=False):
    return (campaign_, seq, "open", None, None, None, None, 5, most, cost, tokens, None, pricing, behaviour, upgrade)


def test_campaigns(spark, tmp_path):
    records = [
        opening(0, "x"), attempt(1, "x", "e1", 30), attempt(2, "x", "e1", 30), attempt(3, "x", "e2", 50), attempt(4, "x", "old", 9, migrated=True), attempt(5, "x", None, 9), attempt(6, "x", "", 9),
        opening(7, "x", most=11), opening(8, "x", pricing="p"), opening(9, "x", pricing="q"), opening(10, "x", behaviour="c"), opening(11, "x", behaviour="c", upgrade=True), opening(12, "x", tokens=4),
        ("x", 13, "report", None, None, 70, 1, *[None] * 8), attempt(14, "y", "e1", 7), opening(15, "y", cost=None), ("x", 16, "report", None, None, 170, 1, *[None] * 8), ("x", 17, "report", None, None, 90, 1, *[None] * 8), attempt(18, "x", "e1", 30),
    ]
    df = spark.createDataFrame(records, campaign.RECORD)
    seen = []
    for parts in (1, 4):
        at = f"{tmp_path}/{parts}"
        with ingest.keyed_state(spark):
            for upto in (10, 99):
                files(df.where(f"seq < {upto} AND seq >= {0 if upto == 10 else 10}"), f"{at}/in", parts, "seq")
                ingest.drain(campaign.ledger(read(df, f"{at}/in", 2), shards=4), f"{at}/out", f"{at}/checkpoint", "append", lambda d, n: d)
        updates = spark.read.parquet(f"{at}/out")
        x, y = sorted(campaign.current(updates).collect())
        assert (x.attempts, x.spent_micro, x.used_tokens, x.refused, x.max_attempts, x.pricing_hash, x.behaviours) == (2, 170, 2, 4, 10, "p", ["b", "c"])
        assert (x.over_attempts, x.over_cost, x.over_tokens) == (False, True, False)
        assert (y.attempts, y.refused, y.max_attempts, y.over_cost) == (1, 1, None, False)
        seen.append(sorted((r.campaign, r.seq, r.refusal) for r in updates.where("kind = 'refused'").collect()))
    assert seen[0] == seen[1] == [("x", 7, "max_attempts"), ("x", 9, "pricing_hash"), ("x", 10, "behaviour"), ("x", 12, "token_limit"), ("y", 15, "no limit")]


def plain_budget(rows, limit, lasts, keeps):
    """One account, second by second, in plain Python."""
    spent, open_, early, gone, out = 0, {}, {}, {}, []
    for at, kind, i, amount in rows:
        for t, j in sorted((u, j) for j, (u, _) in open_.items() if u <= at or kind == "close"):
            n = open_.pop(j)[1]
            gone[j] = t + keeps
            out.append((j, "expire", "expired", spent, sum(v for _, v in open_.values())))
        early = {j: v for j, v in early.items() if v[0] > at}
        gone = {j: v for j, v in gone.items() if v > at}
        if kind == "close":
            continue
        over = lambda n, held: "over_limit" if spent > limit else "settled_late" if held is None else "over_reservation" if n > held else "settled"  # noqa: E731, B023
        if kind == "request":
            waits = early.pop(i, None)
            if spent + sum(v for _, v in open_.values()) + amount > limit:
                what = "refused"
            elif waits:
                what = "released"
                if waits[1] is not None:
                    spent += waits[1]
                    what = over(waits[1], amount)
            else:
                open_[i] = (at + lasts, amount)
                what = "reserved"
        elif i in open_ or i in gone:
            held = open_.pop(i)[1] if i in open_ else None
            gone.pop(i, None)
            what = "released"
            if kind == "settle":
                spent += amount
                what = over(amount, held)
        else:
            early[i] = (at + lasts, amount if kind == "settle" else None)
            what = "early"
        out.append((i, kind, what, spent, sum(v for _, v in open_.values())))
    return out


def test_reservations_for_any_files(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for account in (1, 2):
        for i in range(60):
            at = 1000 * i + rng.randrange(900)
            rows.append((account, at, "request", i, 100))
            if i % 7:
                rows.append((account, max(0, at + rng.randrange(-500, 9000)), rng.choice(["settle", "settle", "release"]), i, rng.randrange(20, 160)))
        rows.append((account, 200_000, "close", -1, 0))
    rows = [(a, t, n, k, i, m) for n, (a, t, k, i, m) in enumerate(sorted(rows, key=lambda r: r[1]))]
    df = spark.createDataFrame(rows, "account long, s long, seq long, kind string, id long, amount long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    want = {a: plain_budget([(t, k, i, m) for b, t, _, k, i, m in rows if a == b], 1500, 5000, 30 * 5000) for a in (1, 2)}
    assert {o for rows in want.values() for _, _, o, _, _ in rows} >= {"reserved", "refused", "settled", "released", "expired", "early", "over_reservation", "settled_late"}
    for parts in (1, 5):
        at = f"{tmp_path}/{parts}"
        files(df, f"{at}/in", parts, "seq")
        with ingest.keyed_state(spark):
            ingest.drain(budget.budget(read(df, f"{at}/in"), 1500, 5000), f"{at}/out", f"{at}/checkpoint", "append", lambda d, n: d)
        got = spark.read.parquet(f"{at}/out").drop("batch")
        for a in (1, 2):
            mine = [(r.id, r.kind, r.outcome, r.spent, r.reserved) for r in got.where(f"account = {a}").collect()]
            assert sorted(mine) == sorted(want[a])


def test_timers_end_reservations_of_silent_accounts(spark, tmp_path):
    rows = [(1, 5, 0, "request", 1, 50), (2, 10, 1, "request", 2, 50), (2, 90_000, 2, "request", 3, 50), (2, 100_000, 3, "request", 4, 50)]
    df = spark.createDataFrame(rows, "account long, s long, seq long, kind string, id long, amount long").withColumn("at", F.timestamp_seconds("s")).drop("s")
    files(df, f"{tmp_path}/in", 4, "seq")
    with ingest.keyed_state(spark):
        ingest.drain(budget.budget(read(df, f"{tmp_path}/in"), 1000, 60, late="1 minute"), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "append", lambda d, n: d)
    got = {(r.account, r.id, r.outcome, r.reserved) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert (1, 1, "expired", 0) in got and (2, 2, "expired", 0) in got
