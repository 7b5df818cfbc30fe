"""Stateful operators on streams, over what is there now; their SQL is that of the same rows in one batch.

Where it matters how rows arrive, they are written as several files one after another, and a stream that has read some of them is stopped and started again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from ..sources import adapters
from ..streaming import budget, campaign, count_windows, group_filter, ingest
from . import query
from .episodes import _ATT, _SEQ, WE, _attempts
from .training import _G, H7_SQL


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.source(spark, f"{sf_dir}/events.parquet")


class Arrivals:
    """Rows that arrive in ``parts`` by the value of a column, as files of one folder."""

    def __init__(self, df: DataFrame, by: str, parts: int) -> None:
        self.df, self.by, self.path = df, by, f"{ingest.fresh(df.sparkSession)}/arrivals"
        as_number = df.select(F.col(by).cast("double").alias("x"))
        self.edges = as_number.approxQuantile("x", [i / parts for i in range(1, parts)], 0.01)

    def part(self, i: int) -> None:
        """Let part ``i`` arrive (again)."""
        x, low, high = F.col(self.by).cast("double"), self.edges[i - 1] if i else None, self.edges[i] if i < len(self.edges) else None
        rows = self.df if low is None else self.df.where(x >= low)
        rows = rows if high is None else rows.where(x < high)
        rows.write.mode("append").parquet(self.path)

    def stream(self, files: int = 2) -> DataFrame:
        """All that has arrived, a few files a batch."""
        return self.df.sparkSession.readStream.schema(self.df.schema).option("maxFilesPerTrigger", files).parquet(self.path)


@query("h1_stream_resumed", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0")
def stream_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H2: a stream's records without those that are known."""
    known = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id % 3 = 0")
    return ingest.result(spark, _events(spark, sf_dir), prepare=ingest.resumed(known, ["event_id"])).select("event_id", "event_type")


@query("h2_stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: the first record of each key."""
    return ingest.result(spark, ingest.deduplicated(_events(spark, sf_dir).select("user_id", "event_type"), ["user_id", "event_type"]))


#: Generations of 50 groups of 4 rollouts; updates of 60 groups.
SIZE, GENERATION, TARGET = 4, 200, 60


def _filtered(spark: SparkSession, sf_dir: str, wanted: int | None = None) -> group_filter.Filter:
    """Rollouts in three arrivals; the stream is started again after the first."""
    rows = adapters.rewards(spark, sf_dir).withColumn("gen", F.floor(F.col("uid") / (GENERATION // SIZE)))
    a = Arrivals(rows, "idx", 3)
    f = group_filter.Filter(spark, f"{ingest.fresh(spark)}/filter", TARGET, SIZE, GENERATION, wanted=wanted)
    for i in range(3):
        a.part(i)
        if i in (0, 2):
            f.fold.drain(a.stream(100))
    return f


@query("h6_stream_group_filter", f"WITH {_G} SELECT uid, size, first, uniform FROM g WHERE invalid = 0")
def stream_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: groups judged as their generations become whole; what is left at the end is judged as it is. Groups with a null reward are left out."""
    f = _filtered(spark, sf_dir)
    f.finish()
    return f.decisions("judged").where("invalid = 0").select("uid", "size", "first", "uniform")


@query("h7_stream_updates", H7_SQL)
def stream_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7: the updates of ``h7_updates``, filled from a stream that was started again."""
    from pyspark.sql import Window

    u = _filtered(spark, sf_dir).finish()
    so_far = Window.orderBy("update").rowsBetween(Window.unboundedPreceding, 0)  # updates are no more than generations
    total = [F.sum(c).over(so_far).alias(f"total_{c}") for c in ("generated_groups", "retained_groups")]
    return u.select("*", *total).drop("generated_rollouts", "buffered_diverse_groups", "retained_rollouts")


_WALK = H7_SQL.split("u AS (SELECT update::BIGINT")[0]


@query(
    "h6_stream_selection",
    f"""{_WALK} d AS (SELECT g.uid, g.first, w.update::BIGINT AS update, uniform, row_number() OVER (PARTITION BY w.update, uniform ORDER BY first) AS place,
    FROM g JOIN n ON g.uid // 50 = n.batch JOIN w USING (i) WHERE uniform IS NOT NULL),
x AS (SELECT max(update) AS most FROM (SELECT update FROM d GROUP BY update HAVING count(*) FILTER (NOT uniform) >= 60) WHERE update <= 2)
SELECT uid, update, CASE WHEN uniform THEN 'uniform' WHEN place <= 60 THEN 'selected' ELSE 'surplus' END AS state FROM d, x WHERE update <= 2""",
)
def stream_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each group of the first two updates; the stream is stopped when they are filled."""
    f = _filtered(spark, sf_dir, wanted=2)
    f.finish()
    return f.decisions().select("uid", "update", "state")


@query("h8_stream_windows", f"{WE}, {_ATT}, {_SEQ} SELECT ((seq - 1) // 100)::BIGINT AS \"window\", count(*) AS attempts, count(*) FILTER (accepted) AS accepted, count(*) < 100 AS partial FROM sq GROUP BY 1")
def stream_windows_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 100 attempts that arrive in order, in four parts; the stream is started again after the first."""
    from ..operators import diagnostics

    d = diagnostics.sequence(_attempts(spark, sf_dir), "episode_id").withColumnRenamed("seq", "arrival")
    a = Arrivals(d, "arrival", 4)
    w = count_windows.CountWindows(spark, f"{ingest.fresh(spark)}/windows", "arrival")
    for i in range(4):
        a.part(i)
        if i in (0, 3):
            w.fold.drain(a.stream(10**6))
    return w.windows()


@query("h4_stream_ledger", "SELECT user_id, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY user_id")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: running totals of accounts; the last update of each counts."""
    e = _events(spark, sf_dir).select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    updates = ingest.result(spark, group_filter.ledger(e, "user_id", "k"), "update", lambda df, n: df)
    return updates.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", "n").alias("total"))


_OPENED = "event_type = 'signup' AND event_id % 5 < 3"
_RECORDS = f"""r AS (SELECT concat('c', user_id % 5) AS campaign, event_id AS seq, CASE WHEN {_OPENED} THEN 'open' WHEN event_type = 'signup' THEN 'report' ELSE 'attempt' END AS kind,
    event_type = 'view' AND event_id % 7 = 0 AS migrated, floor(value * 1000)::BIGINT AS cost, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
x AS (SELECT *, CASE WHEN k % 11 = 0 THEN 501 ELSE 500 END AS most, CASE WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'p1' ELSE 'p2' END AS pricing FROM r)"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaigns' records, made from events: signups open a campaign or report what it has spent, other events are attempts."""
    e = table(spark, sf_dir, "events")
    k, opened = F.get_json_object("props", "$.k").cast("long"), F.expr(_OPENED)
    kind = F.when(opened, "open").when(F.col("event_type") == "signup", "report").otherwise("attempt")
    attempt = kind == "attempt"
    cost = F.floor(F.col("value") * 1000)
    return e.select(
        F.concat(F.lit("c"), (F.col("user_id") % 5).cast("string")).alias("campaign"), F.col("event_id").alias("seq"), kind.alias("kind"),
        F.when(attempt, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("episode_id"), ((F.col("event_type") == "view") & (F.col("event_id") % 7 == 0)).alias("migrated"),
        F.when(attempt, cost).when(~opened, F.col("event_id") * 9000).alias("cost_micro"), F.when(attempt, k).alias("tokens"),
        F.lit(1000).cast("long").alias("target_total"), F.when(k % 11 == 0, 501).otherwise(500).cast("long").alias("max_attempts"), F.lit(10**7).cast("long").alias("cost_limit_micro"),
        F.lit(10**5).cast("long").alias("token_limit"), F.lit("s").alias("sampling_hash"), F.when(k % 3 == 1, "p1").when(k % 3 == 2, "p2").alias("pricing_hash"),
        F.when(k % 4 == 0, "b1").otherwise("b2").alias("behaviour"), F.lit(True).alias("upgrade"),
    )


@query(
    "h4_campaign_state",
    f"""WITH RECURSIVE {_RECORDS}, o AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY seq) AS i FROM x WHERE kind = 'open'),
w AS (SELECT campaign, i, most, pricing, 0 AS refused FROM o WHERE i = 1 UNION ALL
    SELECT o.campaign, o.i, w.most, CASE WHEN o.most = w.most AND (w.pricing IS NULL) THEN o.pricing ELSE w.pricing END, w.refused + (o.most <> w.most OR coalesce(o.pricing <> w.pricing, false))::INT
    FROM w JOIN o ON o.campaign = w.campaign AND o.i = w.i + 1),
f AS (SELECT campaign, max(most) AS most, arg_max(coalesce(pricing, ''), i) AS pricing, max(refused)::BIGINT AS refused FROM w GROUP BY campaign),
t AS (SELECT campaign, count(*) FILTER (kind = 'attempt' AND NOT migrated) AS attempts, greatest(coalesce(sum(cost) FILTER (kind = 'attempt' AND NOT migrated), 0), coalesce(max(seq * 9000) FILTER (kind = 'report'), 0))::BIGINT AS spent,
    coalesce(sum(k) FILTER (kind = 'attempt' AND NOT migrated), 0)::BIGINT AS tokens FROM x GROUP BY campaign)
SELECT campaign, attempts, spent AS spent_micro, tokens AS used_tokens, coalesce(refused, 0) AS refused, most::BIGINT AS max_attempts, nullif(pricing, '') AS pricing_hash, coalesce(attempts > most, false) AS over_attempts,
    coalesce(spent > 10000000 AND most IS NOT NULL, false) AS over_cost, coalesce(tokens > 100000 AND most IS NOT NULL, false) AS over_tokens FROM t LEFT JOIN f USING (campaign)""",
)
def campaign_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: ledgers of five campaigns. Their records arrive in four parts, the first two of them twice, and the stream is started again after the second."""
    a = Arrivals(_records(spark, sf_dir), "seq", 4)
    base = ingest.fresh(spark)
    with ingest.keyed_state(spark):
        for parts in ((0, 1), (0, 2, 1, 3)):
            for i in parts:
                a.part(i)
            ingest.drain(campaign.ledger(a.stream(6)), f"{base}/out", f"{base}/checkpoint", "append", lambda df, n: df)
    now = campaign.current(spark.read.parquet(f"{base}/out"))
    return now.select("campaign", "attempts", "spent_micro", "used_tokens", "refused", "max_attempts", "pricing_hash", "over_attempts", "over_cost", "over_tokens")


#: A reservation of 100 lasts a day; an account may spend 2500.
LIMIT, HELD, DAY = 2500, 100, 86400


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event is a request; its answer comes some hours later (sometimes minutes before), but for errors; accounts are closed two days after the last event."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    request = e.select(F.col("user_id").alias("account"), F.col("ts").alias("at"), (2 * F.col("event_id")).alias("seq"), F.lit("request").alias("kind"), F.col("event_id").alias("id"), F.lit(HELD).cast("long").alias("amount"))
    later = F.when(F.col("event_id") % 17 == 0, -300_000_000).otherwise(F.floor(F.col("value") * 3_600_000_000))
    answer = e.where("event_type <> 'error'").select(
        F.col("user_id").alias("account"), F.timestamp_micros(F.unix_micros("ts") + later).alias("at"), (2 * F.col("event_id") + 1).alias("seq"),
        F.when(F.col("event_type") == "signup", "release").otherwise("settle").alias("kind"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "purchase", 2 * k).otherwise(k).alias("amount"),
    )
    both = request.unionByName(answer)
    end = both.agg((F.max(F.unix_micros("at")) + 2 * DAY * 1_000_000).alias("us"))
    closed = e.select(F.col("user_id").alias("account")).distinct().join(end, how="cross")  # one row
    closed = closed.select("account", F.timestamp_micros("us").alias("at"), F.lit(-1).cast("long").alias("seq"), F.lit("close").alias("kind"), F.lit(-1).cast("long").alias("id"), F.lit(0).cast("long").alias("amount"))
    return both.unionByName(closed)


@query(
    "h5_reservations",
    f"""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events),
a AS (SELECT *, us + CASE WHEN event_id % 17 = 0 THEN -300000000 ELSE floor(value * 3600000000)::BIGINT END AS answered FROM e WHERE event_type <> 'error'),
l AS (SELECT user_id AS account, us AS tm, 1 AS ord, 2 * event_id AS seq, 'request' AS kind, event_id AS id, 0 AS amount FROM e
    UNION ALL SELECT user_id, answered, 1, 2 * event_id + 1, CASE event_type WHEN 'signup' THEN 'release' ELSE 'settle' END, event_id, CASE event_type WHEN 'purchase' THEN 2 * k ELSE k END FROM a
    UNION ALL SELECT user_id, us + {DAY * 1_000_000}, 0, event_id, 'expire', event_id, 0 FROM e),
t AS (SELECT l.*, row_number() OVER (PARTITION BY account ORDER BY tm, ord, CASE WHEN ord = 0 THEN id ELSE seq END) AS i, CASE WHEN a.event_type = 'signup' THEN -1 WHEN a.event_type = 'purchase' THEN 2 * a.k ELSE a.k END AS answer
    FROM l LEFT JOIN a ON a.event_id = l.id),
w AS (SELECT account, 0::BIGINT AS i, 0::BIGINT AS id, '' AS kind, '' AS outcome, 0::BIGINT AS tm, 0::BIGINT AS spent, []::BIGINT[] AS open, []::BIGINT[] AS early, []::BIGINT[] AS gone FROM (SELECT DISTINCT account FROM t)
UNION ALL SELECT account, i, id, kind,
    CASE WHEN kind = 'expire' THEN CASE WHEN held THEN 'expired' ELSE '' END
         WHEN kind = 'request' THEN CASE WHEN refused THEN 'refused' WHEN NOT waits THEN 'reserved' WHEN answer < 0 THEN 'released' WHEN spent + answer > {LIMIT} THEN 'over_limit' WHEN answer > {HELD} THEN 'over_reservation' ELSE 'settled' END
         WHEN NOT held AND NOT late THEN 'early' WHEN kind = 'release' THEN 'released' WHEN spent + amount > {LIMIT} THEN 'over_limit' WHEN late THEN 'settled_late' WHEN amount > {HELD} THEN 'over_reservation' ELSE 'settled' END,
    tm,
    spent + CASE WHEN kind = 'request' AND NOT refused AND waits THEN greatest(answer, 0) WHEN kind = 'settle' AND (held OR late) THEN amount ELSE 0 END,
    CASE WHEN kind = 'request' AND NOT refused AND NOT waits THEN list_append(open, id) WHEN held THEN list_filter(open, lambda x: x <> id) ELSE open END,
    CASE WHEN kind = 'request' THEN list_filter(early, lambda x: x <> id) WHEN kind IN ('settle', 'release') AND NOT held AND NOT late THEN list_append(early, id) ELSE early END,
    CASE WHEN kind = 'expire' AND held THEN list_append(gone, id) WHEN late THEN list_filter(gone, lambda x: x <> id) ELSE gone END
FROM (SELECT t.*, w.spent, w.open, w.early, w.gone, list_contains(w.open, t.id) AND t.kind <> 'request' AS held, list_contains(w.gone, t.id) AND t.kind IN ('settle', 'release') AS late,
        list_contains(w.early, t.id) AS waits, w.spent + {HELD} * len(w.open) + {HELD} > {LIMIT} AS refused FROM w JOIN t ON t.account = w.account AND t.i = w.i + 1))
SELECT account, id, kind, outcome, make_timestamp(tm) AS moment, spent, ({HELD} * len(open))::BIGINT AS reserved FROM w WHERE outcome <> ''""",
)
def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H5: what becomes of every request and answer, and which reservations expire. The records arrive in five parts; the stream is started again after the third."""
    a = Arrivals(_requests(spark, sf_dir), "at", 5)
    base = ingest.fresh(spark)
    with ingest.keyed_state(spark):
        for parts in ((0, 1, 2), (3, 4)):
            for i in parts:
                a.part(i)
            ingest.drain(budget.budget(a.stream(10**6), LIMIT, DAY), f"{base}/out", f"{base}/checkpoint", "append", lambda df, n: df)
    return spark.read.parquet(f"{base}/out").select("account", "id", "kind", "outcome", F.col("at").cast("timestamp_ntz").alias("moment"), "spent", "reserved")


@query("x_stream_windows", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events WHERE date_trunc('day', ts) < (SELECT date_trunc('day', max(ts)) FROM events) GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: counts by event-time window, of windows that are closed."""
    e = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    last = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.date_trunc("day", F.max("ts").cast("timestamp")).alias("last"))
    got = ingest.result(spark, ingest.windowed(e, "ts", "0 seconds", "1 day", "event_type"), "append")
    out = got.select(F.col("window.start").alias("day"), "event_type", "n")
    return out.join(F.broadcast(last)).where(F.col("day") < F.col("last")).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")  # last is one row
