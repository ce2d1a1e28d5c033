"""Access logs: lockouts after repeated failures, and the validity of sessions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT, LOCK_MINUTES = 5, 10


def fold(rows: Iterable[tuple], limit: int, lock: pd.Timedelta, count: int = 0, until: pd.Timestamp | None = None) -> tuple[list[tuple], int, pd.Timestamp | None]:
    """Attempts (ts, outcome, id) of one key in order: the decision for each and the state after them.

    The limit-th failure locks and resets the counter; attempts while locked are rejected and don't count; success
    clears it.
    """
    out = []
    for ts, outcome, event in rows:
        if until is not None and ts < until:
            out.append((event, ts, "rejected", count, until))
            continue
        until = None
        count = count + 1 if outcome == "failure" else 0 if outcome == "success" else count
        decision = "allowed"
        if count >= limit:
            until, count, decision = ts + lock, 0, "locked"
        out.append((event, ts, decision, count, until))
    return out, count, until


def lockouts(log: DataFrame, limit: int = LIMIT, lock_minutes: int = LOCK_MINUTES) -> DataFrame:
    """(key, event_id, ts, decision, failures, locked_until, minutes_left) for each attempt (key, ts, outcome, event_id).

    The log is dealt by key and sorted by time; each task folds its keys as they pass and holds the state of one, so a hot
    key needs no more memory than others.
    """
    lock = pd.Timedelta(minutes=lock_minutes)
    columns = ["key", "event_id", "ts", "decision", "failures", "locked_until"]

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, count, until = None, 0, None
        for batch in batches:
            parts = []
            for key, rows in batch.groupby("key", sort=False, dropna=False):
                if key != last:
                    last, count, until = key, 0, None
                out, count, until = fold(zip(rows["ts"], rows["outcome"], rows["event_id"]), limit, lock, count, until)
                parts += [(key, *r) for r in out]
            yield pd.DataFrame(parts, columns=columns).astype({"locked_until": "datetime64[us]", "ts": "datetime64[us]"})

    schema = "key long, event_id long, ts timestamp_ntz, decision string, failures long, locked_until timestamp_ntz"
    rows = log.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(decide, schema)
    return rows.withColumn("minutes_left", F.when(F.col("decision") != "allowed", F.ceil(F.timestamp_diff("SECOND", "ts", "locked_until") / 60)).cast("long"))


def last_before(rows: DataFrame, key: str, ts: str, value: str, tie: str, slice_hours: int) -> DataFrame:
    """The rows with `last`: the latest non-null value of their key up to their place in the order of ts and tie, for values that grow with ts.

    A segmented scan: the time of a key is cut into slices of fixed length, each slice's greatest value is carried to the next ones, and
    then every slice is scanned by itself. A window over a key holds a value a slice, never the key's rows, so one key may have all rows.
    """
    placed = rows.withColumn("_slice", F.timestamp_diff("HOUR", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz")) / slice_hours)
    placed = placed.withColumn("_slice", F.floor("_slice"))
    earlier = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    slices = placed.groupBy(F.col(key).alias("_k"), F.col("_slice").alias("_s")).agg(F.max(value).alias("_m"))
    carried = slices.select("_k", "_s", F.max("_m").over(earlier).alias("_carry")).where("_carry is not null")
    within = Window.partitionBy(key, "_slice").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    scanned = placed.withColumn("_last", F.last(value, ignorenulls=True).over(within))
    both = scanned.join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_slice").eqNullSafe(F.col("_s")), "left")
    return both.withColumn("last", F.coalesce("_last", "_carry")).drop("_slice", "_k", "_s", "_last", "_carry")


def session_valid(requests: DataFrame, logins: DataFrame, key: str, ts: str, hours: int = 24, slice_hours: int = 24) -> DataFrame:
    """Requests with the last login at or before them, and whether the session still runs then. Requests without time have none."""
    both = logins.select(key, ts, F.lit(None).cast("long").alias("event_id"), F.col(ts).alias("login")).unionByName(requests.select(key, ts, "event_id", F.lit(None).cast("timestamp_ntz").alias("login")))
    rows = last_before(both.withColumn("_request", F.col("login").isNull()), key, ts, "login", "_request", slice_hours).where("_request")
    return rows.select("event_id", key, ts, F.col("last").alias("last_login"), F.coalesce(F.col(ts) < F.col("last") + F.expr(f"INTERVAL {hours} HOURS"), F.lit(False)).alias("valid"))
