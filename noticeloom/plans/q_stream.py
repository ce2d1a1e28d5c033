"""The streaming forms, run to the end of a table and compared with SQL over it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.functions import text as X
from noticeloom.plans.catalog import ORACLES, Tables, query
from noticeloom.plans.q_extract import _NOCOMMENT, _stripped
from noticeloom.sources.snapshots import scratch
from noticeloom.streaming import sinks as K
from noticeloom.streaming import streams as S


def _rows(t: Tables, path: str, schema: str, batches: bool = False) -> DataFrame:
    rows = t.spark.read.schema(schema + (", batch int" if batches else "")).parquet(f"{path}/rows")
    return rows.drop("batch") if batches else rows


@query("stream_page_ingest", f"SELECT page_id, {_stripped(_NOCOMMENT)} AS text FROM pages")
def stream_page_ingest(t: Tables) -> DataFrame:
    path = scratch(t.spark, "ingest")
    S.run_to_end(S.read_table(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", X.strip_tags(F.col("html"), comments=True).alias("text")), path)
    return _rows(t, path, "page_id long, text string")


@query("stream_new_alerts", "SELECT DISTINCT user_id, event_type FROM events")
def stream_new_alerts(t: Tables) -> DataFrame:
    path = scratch(t.spark, "alerts")
    alerts = S.new_alerts(S.read_table(t.spark, f"{t.sf_dir}/events.parquet").select("user_id", "event_type"), "user_id", "event_type")
    S.run_to_end(alerts, path, sink=S.batch_table(path))
    return _rows(t, path, "user_id long, event_type string", True)


@query("stream_first_seen", "SELECT user_id, min(ts) AS first_seen FROM events GROUP BY user_id")
def stream_first_seen(t: Tables) -> DataFrame:
    """Updates go to numbered batches; the least stamp of all is the state's last word."""
    path = scratch(t.spark, "first-seen")
    S.run_to_end(S.first_seen(S.read_table(t.spark, f"{t.sf_dir}/events.parquet"), "user_id", F.col("ts")), path, "update", S.batch_table(path))
    return _rows(t, path, "user_id long, first_seen timestamp_ntz", True).groupBy("user_id").agg(F.min("first_seen").alias("first_seen"))


@query("stream_daily_trend", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, count(*) AS n FROM events GROUP BY 1")
def stream_daily_trend(t: Tables) -> DataFrame:
    path = scratch(t.spark, "trend")
    S.run_to_end(S.windowed_counts(S.read_table(t.spark, f"{t.sf_dir}/events.parquet"), "ts", "1 day"), path, "update", S.batch_table(path))
    return _latest(_rows(t, path, "start timestamp_ntz, n long", True))


@query("stream_new_48h", "SELECT CAST(s AS TIMESTAMP) AS start, count(*) AS n FROM (SELECT unnest(generate_series(date_trunc('hour', ts) - INTERVAL 47 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1")
def stream_new_48h(t: Tables) -> DataFrame:
    path = scratch(t.spark, "new")
    S.run_to_end(S.windowed_counts(S.read_table(t.spark, f"{t.sf_dir}/events.parquet"), "ts", "48 hours", "1 hour"), path, "update", S.batch_table(path))
    return _latest(_rows(t, path, "start timestamp_ntz, n long", True))


def _latest(rows: DataFrame) -> DataFrame:
    """Counts only grow: the largest is the last."""
    return rows.groupBy("start").agg(F.max("n").alias("n"))


@query("stream_lockouts", ORACLES["lockout_detect"].replace(", CASE WHEN decision <> 'allowed' THEN CAST(ceil(date_sub('second', ts, locked_until) / 60) AS BIGINT) END AS minutes_left", ""))
def stream_lockouts(t: Tables) -> DataFrame:
    path = scratch(t.spark, "lockouts")
    events = S.read_table(t.spark, f"{t.sf_dir}/events.parquet").where(F.col("event_type").isin("error", "signup"))
    log = events.select(F.col("user_id").alias("key"), "event_id", "ts", F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"))
    S.run_to_end(S.lockouts(log, lock_minutes=24 * 60), path, sink=S.batch_table(path))
    return _rows(t, path, "key long, event_id long, ts timestamp_ntz, decision string, failures long, locked_until timestamp_ntz", True).drop("ts")


def _in_runs(t: Tables, slices: list[DataFrame], name: str, start: Callable[[DataFrame, str], None]) -> str:
    """Lands one slice after the other and runs the stream to its end each time, so that every slice is a batch and every run but the first a restart."""
    path = scratch(t.spark, name)
    for rows in slices:
        rows.write.mode("append").parquet(f"{path}/landing")
        start(S.read_table(t.spark, f"{path}/landing", files_per_batch=100_000), path)
    return path


def _slice() -> Column:
    day = F.day("ts")
    return F.when(day <= 8, 0).when(day <= 16, 1).when(day <= 24, 2).otherwise(3)


_SLICE_SQL = "CASE WHEN day(ts) <= 8 THEN 0 WHEN day(ts) <= 16 THEN 1 WHEN day(ts) <= 24 THEN 2 ELSE 3 END"


@query("stream_first_seen_snapshot", f"""WITH old AS (SELECT user_id, min(ts) AS seen FROM events WHERE event_type = 'purchase' AND {_SLICE_SQL} = 0 GROUP BY user_id),
s AS (SELECT user_id, ts, {_SLICE_SQL} AS k FROM events WHERE event_type <> 'purchase'), f AS (SELECT user_id, min(k) AS k FROM s GROUP BY user_id)
SELECT user_id, coalesce(any_value(old.seen), min(s.ts)) AS first_seen, any_value(old.seen) IS NOT NULL AS known FROM s JOIN f USING (user_id, k) LEFT JOIN old USING (user_id) GROUP BY user_id""")
def stream_first_seen_snapshot(t: Tables) -> DataFrame:
    """Purchases of the first days are the snapshot, everything else arrives in four runs: known users keep their stamp."""
    old = t.events.where((F.col("event_type") == "purchase") & (_slice() == 0)).groupBy("user_id").agg(F.min("ts").alias("first_seen"))
    rest = t.events.where("event_type <> 'purchase'").select("user_id", "ts")
    before = t.spark.conf.get(S.STATE_STORE[0])
    t.spark.conf.set(*S.STATE_STORE)
    try:
        path = _in_runs(t, [rest.where(_slice() == k) for k in range(4)], "seen-since", lambda rows, path: S.run_to_end(S.first_seen_since(rows, "user_id", "ts", old), path, sink=S.batch_table(path)))
    finally:
        t.spark.conf.set(S.STATE_STORE[0], before)
    rows = _rows(t, path, "key long, first_seen timestamp, known boolean", True)
    return rows.select(F.col("key").alias("user_id"), F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), "known")


# One row in 40 of the first slices arrives with the last.
_ARRIVES_SQL = f"CASE WHEN event_id % 40 = 0 THEN 3 ELSE {_SLICE_SQL} END"


@query("stream_late_rows", f"""WITH e AS (SELECT event_id, ts, {_ARRIVES_SQL} AS k FROM events), m AS (SELECT k, max(max(ts)) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM e GROUP BY k),
r AS (SELECT date_trunc('day', ts) AS start, coalesce(date_trunc('day', ts) + INTERVAL 1 DAY <= mark - INTERVAL 1 HOUR, false) AS late FROM e JOIN m USING (k))
SELECT CAST(start AS TIMESTAMP) AS start, count(*) FILTER (NOT late) AS on_time, count(*) FILTER (late) AS late FROM r GROUP BY start""")
def stream_late_rows(t: Tables) -> DataFrame:
    """Daily counts and, beside them, how many rows of the day came when it was closed; both add up to the input."""
    rows = t.events.select("event_id", "ts", F.when(F.col("event_id") % 40 == 0, 3).otherwise(_slice()).alias("k"))
    path = _in_runs(t, [rows.where(F.col("k") == k) for k in range(4)], "late", lambda stream, path: S.run_to_end(stream, path, sink=K.late_split(path, "ts", "1 day")))
    counts = t.spark.read.schema("start timestamp_ntz, n long, batch int").parquet(f"{path}/counts").select("start", F.col("n").alias("on_time"), F.lit(0).cast("long").alias("late"))
    late = t.spark.read.schema("ts timestamp_ntz, batch int").parquet(f"{path}/late").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("start"), F.lit(0).cast("long").alias("on_time"), F.lit(1).cast("long").alias("late"))
    return counts.unionByName(late).groupBy("start").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))


@query("outbox_tally", f"""WITH e AS (SELECT event_id, ts, {_SLICE_SQL} AS k FROM events WHERE event_type = 'signup' UNION ALL SELECT event_id, ts, 3 FROM events WHERE event_type = 'signup' AND day(ts) <= 8),
f AS (SELECT event_id, ts, min(k) AS k FROM e GROUP BY event_id, ts), r AS (SELECT k, event_id, row_number() OVER (PARTITION BY k ORDER BY ts, event_id) AS place FROM f)
SELECT k AS batch, count(*) FILTER (place <= 20 AND event_id % 3 <> 0) AS sent, count(*) FILTER (place <= 20 AND event_id % 3 = 0) AS failed, count(*) FILTER (place > 20) AS capped, 0 AS unknown FROM r GROUP BY k""")
def outbox_tally(t: Tables) -> DataFrame:
    """New signups of four runs go through the outbox, the first 20 of each; the last run brings the first one's rows again, and is repeated."""
    signups = t.events.where("event_type = 'signup'").select("event_id", "ts", _slice().alias("k"))
    slices = [signups.where(F.col("k") == k) for k in range(3)] + [signups.where("k = 3 or k = 0")]

    def deliver(path: str) -> Callable[[DataFrame, int], None]:
        send = K.outbox(path, lambda row: row.event_id % 3 != 0, "event_id", ["ts"])

        def twice(batch: DataFrame, number: int) -> None:
            send(batch, number)
            send(batch, number)

        return twice

    path = _in_runs(t, slices, "outbox", lambda rows, path: S.run_to_end(rows, path, sink=deliver(path)))
    ledger = t.spark.read.schema("event_id long, place int, status string, batch int").parquet(f"{path}/ledger")
    return K.tally(ledger, "batch")
